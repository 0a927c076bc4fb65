"""What showed only on larger tables."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestitch.functions import text
from lodestitch.operators import mappers, staging
from lodestitch.plans import drops, fixtures
from lodestitch.sources import readers

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


@needs_tables
def test_lines_of_large_files_have_numbers(spark, monkeypatch):
    monkeypatch.setattr(readers, "WHOLE", 500)
    monkeypatch.setattr(staging, "RANK_BITS", 9)
    rows = __spark_entry__.queries()["arrival_ids"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/events.parquet").count()
    assert all((r.line, r.source_id) == (r.event_id // 2, f"s{r.event_id % 2}") for r in rows)


def test_entities_that_are_cut_off_stay(spark):
    page = spark.createDataFrame([("<title>a&amp</title>b &amp; c&amp;lt; &#39;&notit; &lt",)], "html string")
    row = page.select(text.html_title(F.col("html"), F.lit("u"), closed=True), text.html_text(F.col("html"), closed=True), text.html_title(F.col("html"), F.lit("u"))).first()
    assert tuple(row) == ("a&amp", "a&amp b & c&lt; '&notit; &lt", "a&")


@needs_tables
@pytest.mark.parametrize("columns", [["id", "external_ids"], ["id", "occurred_at"]])
def test_a_filter_on_the_outcome_parses_a_payload_once(spark, columns):
    rows = mappers.entities(mappers.map_incidents(fixtures.incident_staging(spark, SF))).select(*columns)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Few rows of many keys."""
    root = tmp_path_factory.mktemp("wide")
    n = spark.range(0, 25_000, 1, 4)
    n.where("id < 150 or id % 10 = 0").selectExpr("id AS s_suppkey", "concat('S', id) AS s_name", "CAST(id / 10 % 25 AS INT) AS s_nationkey").write.parquet(f"{root}/supplier.parquet")
    n.selectExpr("id * 20 AS l_orderkey", "id AS l_partkey", "CAST(id % 2 AS INT) AS l_linenumber", "1.5D AS l_quantity").write.parquet(f"{root}/lineitem.parquet")
    spark.createDataFrame([("i", "t")], "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def _files(rows):
    return len([f for f in rows.inputFiles() if f.endswith(".json")])


@pytest.mark.parametrize("name, files", [("mixed_drop", 80), ("json_drop", 150)])
def test_files_of_a_drop_are_bounded(spark, wide, name, files):
    suppliers = [r.s_suppkey for r in spark.read.parquet(f"{wide}/supplier.parquet").collect()]
    want = [s for s in suppliers if s % 3 < 2] + [0] if name == "mixed_drop" else [*suppliers, *(s for s in suppliers if s % 5 == 0)]
    rows = __spark_entry__.queries()[name](spark, wide)
    assert rows.count() == len(want) and 20 < _files(rows) <= files


def test_pages_of_datasets_hold_many_rows(spark, wide):
    rows = __spark_entry__.queries()["dataset_rows"](spark, wide)
    assert rows.distinct().count() == 25_000 and _files(rows) == 2 * 20


def test_lists_are_landed_by_several_tasks(spark, wide, monkeypatch):
    monkeypatch.setattr(readers, "WHOLE", 100_000)
    rows = __spark_entry__.queries()["json_large_drop"](spark, wide)
    assert rows.distinct().count() == rows.count() == 25_000
    where = fixtures.table(spark, wide, "lineitem").select((F.col("l_orderkey") / 200_000).cast("int").alias("part"), F.to_json(F.struct("l_orderkey")).alias("value"))
    root = drops.folder(spark, "lists")
    drops.land_lists(where, root)
    texts = [r.value for r in spark.read.text(root, wholetext=True).collect()]
    assert len(texts) == 3 and sorted(len(json.loads(t)) for t in texts) == [5_001, 10_001, 10_001]


def test_items_of_large_lists_are_parsed_once(spark, wide, monkeypatch):
    monkeypatch.setattr(readers, "WHOLE", 100_000)
    plan = __spark_entry__.queries()["json_large_drop"](spark, wide)._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan
    large = [x for x in plan.split("Union") if "doc#" in x and "parquet" in x]
    assert large and not any("parseJson" in x for part in large for x in part.splitlines() if "text#" in x)
    assert not any("StructsToJson" in x for x in plan.splitlines() if "Filter" in x)
