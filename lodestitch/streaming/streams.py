"""Structured Streaming: landing to staging, and release of what waits."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions import jsonx
from ..operators import staging

#: 11 polls, 15 minutes apart: how long a record waits before it is given up.
GIVE_UP_MINUTES = 165
KEYS = ["required_entity_type", "required_key", "required_value"]
TOLD = Row("staging_id", *KEYS, "status")


def landing(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """NDJSON files of a landing folder as raw envelope rows {"row": ...}, each file once; lines that do not parse are left out."""
    lines = spark.readStream.schema("value string").text(path)
    parsed = lines.select(jsonx.parse("value").alias("doc"), F.col("_metadata.file_path").alias("file_path")).where("doc is not null")
    null = F.lit(None).cast("string")
    return parsed.select(F.lit("application/x-ndjson").alias("content_type"), F.to_json(F.struct(F.col("doc").alias("row"))).alias("payload"), "file_path", null.alias("checksum"), F.lit(source_id).alias("source_id"), null.alias("batch_id"), null.alias("metadata"))


def stage_landing(spark: SparkSession, path: str, source_id: str, catalog: DataFrame, out: str, checkpoint: str, batch_id: str = "stream") -> StreamingQuery:
    """Stages what has landed since the last call, then stops. A file that was read before adds nothing; a row's place is drawn, and kept by the sink's log."""
    staged = staging.stage(staging.raw_records(landing(spark, path, source_id), batch_id, place=F.expr("uuid()")), catalog)
    return staged.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def releases(waiting: DataFrame, arrivals: DataFrame, give_up: int = GIVE_UP_MINUTES) -> DataFrame:
    """waiting (staging_id, KEYS, asked_at) and arrivals (KEYS, seen_at, any number of a key) to one row for each waiting record: released or expired.

    The first arrival of a key decides: a record is released if it came before,
    or at most give_up minutes after, it was asked for. UNKNOWN stands for no
    key and never arrives; its rows are dealt out, so they are no hot group.
    """
    first = arrivals.where("required_value != 'UNKNOWN'").groupBy(*KEYS).agg(F.min("seen_at").alias("seen_at"))
    dealt = F.when(F.col("required_value") == "UNKNOWN", F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("staging_id"), F.lit(1024)))).otherwise(F.col("required_value"))
    joined = waiting.withColumn("__value", dealt).join(first.withColumnRenamed("required_value", "__value"), [*KEYS[:2], "__value"], "left")
    status = F.when(F.unix_micros("seen_at") <= F.unix_micros("asked_at") + give_up * 60_000_000, "released").otherwise("expired")
    return joined.select("staging_id", *KEYS, "asked_at", status.alias("status"))


class Release(StatefulProcessor):
    """Of one part of a key: `told`, its first arrival and when the next record expires; `waiting`, a state row for each record that waits.

    Rows of a batch touch their own records only. All that wait are looked at when
    the first arrival changes, or once in a batch when the earliest of them is due.
    Each call of the state is a message to the JVM, so `told` is read and written
    once, and nothing is asked of `waiting` where `told` says that none waits.
    """

    def __init__(self, wait: int, remember: int | None):
        self.wait, self.remember = wait, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "first bigint, due bigint")
        self.waiting = handle.getMapState("waiting", "staging_id bigint", "at bigint")

    def _split(self, records: list[tuple[int, int]], first: int | None, now: int) -> tuple[list[tuple[int, str]], list[tuple[int, int]]]:
        """Records (staging_id, asked at) that can be told now, with their status, and those that wait."""
        done, kept = [], []
        for staging_id, at in records:
            if first is not None and first <= at + self.wait:
                done.append((staging_id, "released"))
            elif at + self.wait < now:
                done.append((staging_id, "expired"))
            else:
                kept.append((staging_id, at))
        return done, kept

    def _settle(self, first: int | None, now: int) -> tuple[list[tuple[int, str]], list[tuple[int, int]]]:
        """_split of all that wait; what can be told leaves the state."""
        done, kept = self._split([(staging_id, at) for (staging_id,), (at,) in self.waiting.iterator()], first, now)
        if not kept:
            self.waiting.clear()
        else:
            for staging_id, _ in done:
                self.waiting.removeKey((staging_id,))
        return done, kept

    def _due(self, kept: list[tuple[int, int]], now: int) -> int | None:
        return max(now // 1000 + 1, (min(at for _, at in kept) + self.wait) // 1000 + 1) if kept else None

    def _store(self, before: tuple[int | None, int | None], first: int | None, due: int | None) -> None:
        if due != before[1]:
            # a timer that has to go may be one that forgets the first arrival too; then it comes and finds nothing due
            if before[1] is not None and self.remember is None:
                self.handle.deleteTimer(before[1])
            if due is not None:
                self.handle.registerTimer(due)
        if first is None and due is None:
            if before != (None, None):
                self.told.clear()
        elif (first, due) != before:
            self.told.update((first, due))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        now = max(0, timerValues.getCurrentWatermarkInMs()) * 1000
        before = first, due = tuple(self.told.get() or (None, None))
        asked: list[tuple[int, int]] = []
        for row in rows:
            if row.staging_id is not None:
                asked.append((row.staging_id, row.micros))
            elif first is None or row.micros < first:
                first = row.micros
        done, kept = self._split(asked, first, now)
        if first != before[0]:
            if self.remember is not None:
                self.handle.registerTimer(max(now // 1000 + 1, (first + self.remember) // 1000 + 1))
            if due is not None:
                told, still = self._settle(first, now)
                done += told
                due = self._due(still, now)
        for staging_id, at in kept:
            self.waiting.updateValue((staging_id,), (at,))
        self._store(before, first, min((x for x in (due, self._due(kept, now)) if x is not None), default=None))
        return (TOLD(staging_id, *key[:3], status) for staging_id, status in done)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        before = first, due = tuple(self.told.get() or (None, None))
        done = []
        if due is not None and due <= expiredTimerInfo.getExpiryTimeInMs():
            done, kept = self._settle(first, now)
            due = self._due(kept, now)
        if self.remember is not None and first is not None and first + self.remember < now:
            first = None
        self._store(before, first, due)
        return (TOLD(staging_id, *key[:3], status) for staging_id, status in done)


def release_stream(waiting: DataFrame, arrivals: DataFrame, give_up: int = GIVE_UP_MINUTES, lateness: str = "15 minutes", salts: int = 8, remember: int | None = None) -> DataFrame:
    """The stream form of releases: staging_id, KEYS and status, once for each waiting record.

    Each record that waits is a state row of its own, which leaves at its release
    or, give_up minutes of event time later, at its expiry. Waiting records are
    dealt to `salts` parts of a key, so that a common one is not a single group; an
    arrival goes to each part. First arrivals are kept, as a record may ask for a
    key long after it came; with `remember`, they go so many minutes of event time
    later, and whoever asks after that is left to the batch resolver (here it
    expires). Rows later than `lateness` are dropped. Needs the RocksDB state store
    (see start_release).
    """
    part = F.pmod(F.xxhash64("staging_id"), F.lit(salts)).cast("int")
    asked = waiting.select(*KEYS, part.alias("part"), F.col("staging_id").cast("bigint").alias("staging_id"), F.col("asked_at").alias("at"))
    seen = arrivals.where("required_value != 'UNKNOWN'").select(*KEYS, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("part"), F.lit(None).cast("bigint").alias("staging_id"), F.col("seen_at").alias("at"))
    both = asked.unionByName(seen).withWatermark("at", lateness).withColumn("micros", F.unix_micros("at"))
    out = "staging_id bigint, required_entity_type string, required_key string, required_value string, status string"
    minute = 60_000_000
    return both.groupBy(*KEYS, "part").transformWithState(Release(give_up * minute, None if remember is None else remember * minute), out, "append", "EventTime")


def start_release(found: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Starts a release stream into Parquet files, for what is there now; the session's own state store setting is as before afterwards."""
    conf, name = found.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
