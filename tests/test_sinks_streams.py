import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lodestitch.operators import joins, reads, sinks
from lodestitch.schemas import TABLES
from lodestitch.streaming import streams


def test_sinks_append_and_read_back(spark, tmp_path):
    root = str(tmp_path)
    assert sinks.read(spark, root, "entity_links").count() == 0
    links = spark.createDataFrame([("staging", 1, "incident", 1, "derived_from", 1.0, "k"), ("officer", 2, "incident", 1, "involved_in", 1.0, None)], "source_entity string, source_id bigint, target_entity string, target_id bigint, relation_type string, confidence double, join_key string")
    sinks.append(links, root, "entity_links")
    sinks.append(links, root, "entity_links")
    back = sinks.read(spark, root, "entity_links")
    assert back.count() == 4 and back.columns[0] == "source_entity"
    assert sorted(sinks.create_tables(spark)) == sorted(TABLES)


def test_status_log(spark, tmp_path):
    root = str(tmp_path)
    df = lambda *rows: spark.createDataFrame(rows, "id bigint, status string, reason string")
    sinks.append_status(df((1, "suspended", "r"), (2, "failed", "f")), 1, root)
    sinks.append_status(df((1, "ready", None)), 2, root)
    got = {r.staging_id: (r.status, r.reason) for r in sinks.current_status(sinks.read(spark, root, "status_log")).collect()}
    assert got == {1: ("ready", None), 2: ("failed", "f")}


def test_reads_are_bounded(spark):
    rows = spark.createDataFrame([(1, None), (2, dt.datetime(2024, 1, 1)), (3, dt.datetime(2025, 1, 1))], "id bigint, occurred_at timestamp")
    assert [r.id for r in reads.latest_incidents(rows).collect()] == [1, 3, 2]
    assert [r.id for r in reads.latest_incidents(rows, 1, 1).collect()] == [3]
    for bad in ((501, 0), (-1, 0), (1, -1)):
        with pytest.raises(ValueError):
            reads.latest_incidents(rows, *bad)
    with pytest.raises(ValueError):
        reads.suspended_page(rows, 1001)


def test_navigation_and_external_ids(spark):
    o = spark.createDataFrame([(4, 1, {"code": "x"}), (2, 9, {"code": "x", "n": "y"})], "id bigint, agency_id bigint, external_ids map<string,string>")
    a = spark.createDataFrame([(1, "A")], "id bigint, name string")
    assert {r.id: r.agency_name for r in joins.navigate(o, "agency_id", a, "name").collect()} == {4: "A", 2: None}
    asked = spark.createDataFrame([("code", "x"), ("n", "z")], "k string, v string")
    assert {r.v: r.officer_id for r in joins.find_officers_by_external_id(asked, o, "k", "v").collect()} == {"x": 2, "z": None}


def test_landing_reads_each_file_once(spark, tmp_path):
    land, out, checkpoint = (str(tmp_path / n) for n in ("land", "out", "checkpoint"))
    (tmp_path / "land").mkdir()
    catalog = spark.createDataFrame([("s", "incident")], "id string, entity_type string")
    (tmp_path / "land" / "a.ndjson").write_text('{"row":{"id":1}}\nnot json\n{"row":{"id":2}}\n')
    streams.stage_landing(spark, land, "s", catalog, out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    streams.stage_landing(spark, land, "s", catalog, out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    (tmp_path / "land" / "b.ndjson").write_text('{"row":{"id":3}}\n')
    streams.stage_landing(spark, land, "s", catalog, out, checkpoint).awaitTermination()
    rows = spark.read.parquet(out)
    assert rows.count() == 3 == rows.select("id").distinct().count() and {r.entity_type for r in rows.collect()} == {"incident"}


def test_release_stream_equals_batch(spark, tmp_path):
    keys = "required_entity_type string, required_key string, required_value string"
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    wait = [(1, "o", "b", "A", t(0)), (2, "o", "b", "B", t(0)), (3, "o", "b", "C", t(0)), (4, "o", "b", "A", t(9000)), (5, "o", "b", "UNKNOWN", t(0)), *((n, "o", "b", "A", t(1)) for n in range(10, 60))]
    waiting = spark.createDataFrame(wait, f"staging_id bigint, {keys}, asked_at timestamp")
    came = [("o", "b", "A", t(30)), ("o", "b", "A", t(31)), ("o", "b", "B", t(500)), ("o", "b", "A", t(600)), ("o", "b", "UNKNOWN", t(1)), ("o", "b", "Z", t(99000))]
    arrivals = spark.createDataFrame(came, f"{keys}, seen_at timestamp")
    want = sorted([(1, "released"), (2, "expired"), (3, "expired"), (4, "released"), (5, "expired"), *((n, "released") for n in range(10, 60))])
    assert sorted((r.staging_id, r.status) for r in streams.releases(waiting, arrivals).collect()) == want
    got = []
    for go, cut in enumerate((700, 10_000, 100_000)):  # in event time, in three goes
        since = (0, 700, 10_000)[go]
        waiting.where(F.col("asked_at").between(t(since), t(cut - 0.001))).coalesce(1).write.mode("append").parquet(str(tmp_path / "w"))
        arrivals.where(F.col("seen_at").between(t(since), t(cut - 0.001))).coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
        read = lambda n, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / n))
        found = streams.release_stream(read("w", waiting), read("a", arrivals))
        streams.start_release(found, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = sorted((r.staging_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want


def test_many_records_on_one_key_leave_the_state(spark, tmp_path):
    keys = "required_entity_type string, required_key string, required_value string"
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    one = lambda v: [F.lit("o").alias("required_entity_type"), F.lit("b").alias("required_key"), F.lit(v).alias("required_value")]
    n = 20_000
    waiting = spark.range(n).select(F.col("id").alias("staging_id"), *one("A"), F.lit(t(0)).alias("asked_at")).unionByName(spark.range(n, n + 500).select(F.col("id").alias("staging_id"), *one("never"), F.lit(t(1)).alias("asked_at")))
    last, progress = t(0), []
    for minute, value in ((1, "x"), (100, "A"), (400, "y"), (2_000, "z"), (2_001, "z")):
        if minute == 1:
            waiting.coalesce(2).write.parquet(str(tmp_path / "w"))
        spark.createDataFrame([("o", "b", value, t(minute))], f"{keys}, seen_at timestamp").write.mode("append").parquet(str(tmp_path / "a"))
        read = lambda name, schema: spark.readStream.schema(schema).parquet(str(tmp_path / name))
        found = streams.release_stream(read("w", waiting.schema), read("a", f"{keys}, seen_at timestamp"), remember=300)
        query = streams.start_release(found, str(tmp_path / "out"), str(tmp_path / "c"))
        query.awaitTermination()
        progress.append([p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators][-1])
    got = {r.status: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("status").count().collect()}
    assert got == {"released": n, "expired": 500} and last == t(0)
    assert progress[0] >= n + 500 and progress[1] < 2_000 and progress[-1] <= 8 * 3 * 2, progress


def test_snapshots_change_no_status(spark, tmp_path):
    root = str(tmp_path)
    df = lambda *rows: spark.createDataFrame(list(rows), "id bigint, status string, reason string")
    want = {}
    for run in range(20):
        rows = [(n, "suspended" if run % 2 else "ready", f"r{run}") for n in range(40) if (n * 7 + run) % 5 == 0]
        sinks.append_status(df(*rows), run, root)
        want |= {r[0]: (r[1], r[2], run) for r in rows}
        if run % 6 == 5:
            before = {r.staging_id: tuple(r)[1:] for r in sinks.stored_status(spark, root).collect()}
            sinks.compact_status(spark, root, run - 1)
            assert {r.staging_id: tuple(r)[1:] for r in sinks.stored_status(spark, root).collect()} == before == want
            sinks.compact_status(spark, root, run)
            sinks.retire_status(spark, root)
            assert sinks.written_batches(spark, root, "status_log") == [] and len(sinks.written_batches(spark, root, "status_snapshot")) == 1
        if run == 13:
            sinks.append_status(df(*rows), run, root)  # again
    (tmp_path / "status_snapshot" / "batch_id=99").mkdir()  # one that broke off
    assert {r.staging_id: tuple(r)[1:] for r in sinks.stored_status(spark, root).collect()} == want
    assert sinks.stored_status(spark, str(tmp_path / "none")).count() == 0


def test_incremental_passes_equal_full_ones(spark, tmp_path):
    import random

    from lodestitch.operators import resolver

    rng = random.Random(3)
    columns = "staging_record_id bigint, required_entity_type string, required_key string, required_value string, status string, attempts int"
    run = resolver.Incremental(spark, str(tmp_path), 3)
    full, keys = spark.createDataFrame([], columns), set()
    for n in range(1, 11):
        deps = [(n * 100 + k, "officer", "badge_number", rng.choice(["UNKNOWN", *map(str, range(30))]), "waiting", 0) for k in range(12)]
        new = {("officer", "badge_number", str(rng.randint(0, 29))) for _ in range(3)} | {("officer", "badge_number", "UNKNOWN")}
        keys |= new
        deps_frame, keys_frame = spark.createDataFrame(deps, columns), spark.createDataFrame(sorted(new), columns.split(", ", 1)[1].rsplit(", ", 2)[0])
        before = full.unionByName(deps_frame)
        full = spark.createDataFrame(resolver.resolve(before, spark.createDataFrame(sorted(keys), keys_frame.schema), 3).collect(), columns)
        told = run.run_pass(n, deps_frame, keys_frame)
        if n == 4:
            told = run.run_pass(n, deps_frame, keys_frame)
        rows = lambda df: sorted(map(tuple, df.select(*columns.replace(" bigint", "").replace(" string", "").replace(" int", "").split(", ")).collect()))
        assert rows(run.state(n)) == rows(full), n
        was = {r[0]: r.status for r in before.collect()}
        assert {r[0] for r in told.collect()} == {r[0] for r in full.collect() if r.status == "resolved" and was[r[0]] == "waiting"}
        assert {r[0] for r in run.expired(n).collect()} == {r[0] for r in full.collect() if r.status == "expired" and was[r[0]] == "waiting"}


def test_a_pass_reads_what_is_new(spark, tmp_path):
    from lodestitch.operators import resolver

    run = resolver.Incremental(spark, str(tmp_path), 2)
    frame = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("staging_record_id"), F.lit("o").alias("required_entity_type"), F.lit("k").alias("required_key"), F.col("id").cast("string").alias("required_value"))
    for n in range(1, 9):
        run.run_pass(n, frame(n * 1000, n * 1000 + 50), frame(n * 1000 - 25, n * 1000 + 25), looked_up=True)
    files = {b.rsplit("=", 1)[1] for b in run._read("waiting_deps", 6, 8).inputFiles() for b in [b.rsplit("/", 1)[0]]}
    assert files == {"6", "7", "8"}, "older dependencies are not read"
    assert run.state(8).where("status = 'resolved'").count() == 8 * 25


def test_release_asks_the_state_little():
    class Handle:
        """A state of dicts that counts its calls."""

        def __init__(self):
            self.calls, self.value, self.map, self.timers = [], {}, {}, set()

        def getValueState(self, name, schema):
            return SimpleNamespace(get=lambda: self.note("get") or self.value.get(name), update=lambda v: self.note("update") or self.value.update({name: v}), clear=lambda: self.note("clear") or self.value.pop(name, None))

        def getMapState(self, name, key_schema, schema):
            return SimpleNamespace(
                updateValue=lambda k, v: self.note("put") or self.map.update({k: v}), iterator=lambda: self.note("iterator") or iter(list(self.map.items())), removeKey=lambda k: self.note("remove") or self.map.pop(k), clear=lambda: self.note("clear map") or self.map.clear()
            )

        def registerTimer(self, at):
            self.note("timer")
            self.timers.add(at)

        def deleteTimer(self, at):
            self.note("no timer")
            self.timers.discard(at)

        def note(self, call):
            self.calls.append(call)

    row = lambda staging_id, micros: SimpleNamespace(staging_id=staging_id, micros=micros)
    clock = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    handle, release = Handle(), streams.Release(60_000_000, None)
    release.init(handle)
    key = ("o", "b", "A", 0)
    told = lambda rows: [(r.staging_id, r.status) for r in rows]
    # an arrival alone, and what asks after it: nothing waits, so nothing is asked of what waits
    assert told(release.handleInputRows(key, iter([row(None, 5), row(1, 10), row(2, 11)]), clock(0))) == [(1, "released"), (2, "released")]
    assert handle.calls == ["get", "update"]
    handle, release = Handle(), streams.Release(60_000_000, None)
    release.init(handle)
    assert told(release.handleInputRows(key, iter([row(n, n) for n in range(100)]), clock(0))) == []
    assert handle.calls == ["get", *["put"] * 100, "timer", "update"] and handle.timers == {60_001}
    handle.calls.clear()
    expired = SimpleNamespace(getExpiryTimeInMs=lambda: 60_001)
    assert told(release.handleExpiredTimer(key, clock(70_000), expired)) == [(n, "expired") for n in range(100)]
    assert handle.calls[:3] == ["get", "iterator", "clear map"] and len(handle.calls) <= 5 and not handle.map and not handle.value
