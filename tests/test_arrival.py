"""Ids in the order of arrival, and batches that are written again."""

import json
import os

import pytest
from pyspark.sql import functions as F
from test_blocks import splits

from lodestitch.operators import mappers, sinks, staging
from lodestitch.sources import blocks, readers


def _drop(where):
    where.mkdir()
    (where / "b.ndjson").write_text("".join(json.dumps({"docket_number": str(n % 5), "court": f"b{n}"}) + "\n" for n in range(20)))
    (where / "a.csv").write_text('docket_number,court\n' + "".join(f'{n % 7},"a\n{n}"\n' for n in range(20)))
    (where / "c.json").write_text(json.dumps([{"docket_number": str(n), "court": f"c{n}"} for n in range(9)]))
    return [{"id": "s", "adapter": "flatfile", "config": {"path": str(where)}}]


def _ids(spark, sources, after=0):
    files = staging.numbered_files(readers.landed_files(spark, sources), after)
    return staging.raw_records(readers.ingest(spark, sources), "b1", "2024-01-01 00:00:00", files=files)


def test_ids_do_not_hang_on_partitions(spark, tmp_path, monkeypatch):
    sources = _drop(tmp_path / "d")
    monkeypatch.setattr(readers, "WHOLE", 0)
    monkeypatch.setattr(blocks, "BLOCK", 40)
    seen = []
    for size in (50, 1 << 27):
        with splits(spark, size):
            seen.append({(r.id, r.raw_data) for r in _ids(spark, sources).collect()})
    assert seen[0] == seen[1] and len({i for i, _ in seen[0]}) == 49 and min(i for i, _ in seen[0]) > 0


def test_the_first_record_in_file_order_is_ready(spark, tmp_path):
    sources = _drop(tmp_path / "d")
    for n, name in enumerate(("c.json", "a.csv", "b.ndjson")):  # the order of their times, not of their names
        os.utime(tmp_path / "d" / name, (1_700_000_000 + n, 1_700_000_000 + n))
    staged = staging.stage(_ids(spark, sources), spark.createDataFrame([("s", "court_case")], "id string, entity_type string"))
    ready = {r.case_number: r.court for r in mappers.map_court_cases(staged).where("status = 'ready'").collect()}
    assert ready == {str(n): f"c{n}" for n in range(9)}
    os.utime(tmp_path / "d" / "c.json", (1_800_000_000, 1_800_000_000))
    staged = staging.stage(_ids(spark, sources), spark.createDataFrame([("s", "court_case")], "id string, entity_type string"))
    ready = {r.case_number: r.court for r in mappers.map_court_cases(staged).where("status = 'ready'").collect()}
    assert ready == {**{str(n): f"a\n{n}" for n in range(7)}, "7": "c7", "8": "c8"}


def test_later_batches_come_later_and_tables_have_places(spark, tmp_path):
    first = _ids(spark, _drop(tmp_path / "d"))
    after = staging.last_slot(first)
    assert after == 3
    spark.range(50).selectExpr("id as n").repartition(3).write.parquet(str(tmp_path / "t"))
    table = [{"id": "t", "adapter": "opd", "config": {"path": str(tmp_path / "t"), "where": "n >= 10"}}]
    second = _ids(spark, table, after)
    assert second.agg(F.min("id")).first()[0] > first.agg(F.max("id")).first()[0]
    assert second.select("id").distinct().count() == 40 and staging.last_slot(second) == 6
    twice = [*table, {**table[0], "id": "u"}]
    assert _ids(spark, twice).select("id").distinct().count() == 80
    assert staging.last_slot(spark.createDataFrame([], "id bigint")) == 0


def test_rows_without_a_file_get_negative_hashes(spark, tmp_path):
    rows = spark.createDataFrame([("s", '{"a":1}', None, None), ("s", '{"a":1}', None, None)], "source_id string, payload string, file_path string, position bigint")
    raw = readers.envelope(rows, F.col("payload")).withColumn("source_id", F.lit("s"))
    files = staging.numbered_files(readers.landed_files(spark, []))
    ids = [r.id for r in staging.raw_records(raw, "b", files=files).collect()]
    assert len(set(ids)) == 2 and max(ids) < 0


def test_a_batch_written_twice_or_broken_off_is_there_once(spark, tmp_path):
    root, sources = str(tmp_path / "tables"), _drop(tmp_path / "d")
    raw = _ids(spark, sources)
    for _ in range(2):
        sinks.write_batch(raw, root, "raw_records", "b1")
    assert sinks.read(spark, root, "raw_records").count() == 49
    two = raw.withColumn("id", F.col("id") + (1 << 60)).withColumn("batch_id", F.lit("b2"))
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def breaks(x):
        calls.add(1)
        if "c3" in x:
            raise RuntimeError("lost")
        return x

    with pytest.raises(Exception, match="lost"):
        sinks.write_batch(two.withColumn("raw_data", breaks("raw_data")), root, "raw_records", "b2")
    assert sinks.read(spark, root, "raw_records").count() == 49, "a half batch is not read"
    sinks.write_batch(two, root, "raw_records", "b2")
    back = sinks.read(spark, root, "raw_records")
    assert {(r.batch_id, r["count"]) for r in back.groupBy("batch_id").count().collect()} == {("b1", 49), ("b2", 49)}
    with pytest.raises(Exception, match="lost"):
        sinks.write_batch(two.withColumn("raw_data", breaks("raw_data")), root, "raw_records", "b2")
    assert sinks.read(spark, root, "raw_records").where("batch_id = 'b1'").count() == 49
    sinks.write_batch(two.where("content_type = 'application/json'"), root, "raw_records", "b2")
    assert sinks.read(spark, root, "raw_records").where("batch_id = 'b2'").count() == 29
    staged = staging.stage(sinks.read(spark, root, "raw_records"), spark.createDataFrame([("s", "court_case")], "id string, entity_type string"))
    sinks.write_batch(staged, root, "staging_records", "b1")
    assert sinks.read(spark, root, "staging_records").columns == staged.columns
