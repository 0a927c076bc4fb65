"""Waiting dependencies: one join against everything that is there now, then release, retry or expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks

MOST_ATTEMPTS = 10


def available(officers: DataFrame | None = None, incidents: DataFrame | None = None, arrests: DataFrame | None = None, court_cases: DataFrame | None = None) -> DataFrame:
    """required_entity_type, required_key and required_value of all that a record can wait for, each once."""
    parts = []
    for frame, entity, column in ((officers, "officer", "badge_number"), (officers, "officer", "employee_id"), (arrests, "arrest", "booking_number"), (court_cases, "court_case", "case_number")):
        if frame is not None:
            parts.append(frame.select(F.lit(entity).alias("required_entity_type"), F.lit(column).alias("required_key"), F.col(column).cast("string").alias("required_value")))
    if incidents is not None:
        parts.append(incidents.select(F.lit("incident").alias("required_entity_type"), F.explode("external_ids").alias("required_key", "required_value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("required_value is not null").distinct()


def resolve(deps: DataFrame, there: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """Waiting dependencies with their new status and attempts; others stay as they are.

    The value UNKNOWN stands for no key at all and is matched to nothing, so a
    hot value meets no join.
    """
    keys = ["required_entity_type", "required_key", "required_value"]
    can = (F.col("status") == "waiting") & (F.col("required_value") != "UNKNOWN")
    asked = deps.withColumn("__value", F.when(can, F.col("required_value")).otherwise(F.concat(F.lit("\u0000"), (F.xxhash64("staging_record_id") % 1024).cast("string"))))
    found = there.where("required_value != 'UNKNOWN'").withColumnRenamed("required_value", "__value").withColumn("__found", F.lit(True))
    joined = asked.join(found, [*keys[:2], "__value"], "left")
    waiting, hit = F.col("status") == "waiting", F.col("__found").isNotNull()
    misses = F.col("attempts") + 1
    status = F.when(waiting & hit, "resolved").when(waiting & (misses > most), "expired").otherwise(F.col("status"))
    attempts = F.when(waiting & ~hit, misses).otherwise(F.col("attempts"))
    return joined.withColumns({"attempts": attempts.cast(deps.schema["attempts"].dataType), "status": status}).select(*deps.columns)


def released(staging: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Staging after a pass: suspended records with a newly resolved dependency are pending again, without a reason."""
    keys = ["staging_record_id", "required_entity_type", "required_key", "required_value"]
    new = after.where("status = 'resolved'").join(before.where("status = 'waiting'").select(*keys), keys, "left_semi").select(F.col("staging_record_id").alias("id")).distinct().withColumn("__hit", F.lit(True))
    joined = staging.join(new, "id", "left")
    free = F.col("__hit").isNotNull() & (F.col("status") == "suspended")
    changed = {"suspension_reason": F.when(free, F.lit(None)).otherwise(F.col("suspension_reason")), "status": F.when(free, "pending").otherwise(F.col("status"))}
    return joined.withColumns(changed).select(*staging.columns)


def resolved_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """Dependencies that a pass resolved."""
    keys = ["staging_record_id", "required_entity_type", "required_key", "required_value"]
    new = after.where("status = 'resolved'").join(before.where("status = 'waiting'").select(*keys), keys, "left_semi")
    return new.agg(F.count(F.lit(1)).alias("n_resolved"))


#: What a dependency waits for.
KEYS = ["required_entity_type", "required_key", "required_value"]

class Incremental:
    """The resolver over stored tables, of which a pass reads what is new.

    Dependencies, keys and what was resolved are stored by the pass that they came
    in, each pass in a folder of its own (sinks.write_batch). A pass joins its new
    keys with what came in the last MOST_ATTEMPTS passes, and its new dependencies
    with the keys that are there; with `looked_up`, with the new ones only, as the
    mapper that made them has found none of the others. Nothing is rewritten: the
    number of misses is that of the passes since a dependency came, and of those
    that came MOST_ATTEMPTS passes before, the undecided ones expire.
    """

    def __init__(self, spark: SparkSession, root: str, most: int = MOST_ATTEMPTS):
        self.spark, self.root, self.most = spark, root, most

    def _read(self, name: str, since: int, upto: int) -> DataFrame:
        return sinks.read_numbered(self.spark, self.root, name, since, upto)

    def _write(self, rows: DataFrame, name: str, number: int) -> None:
        sinks.write_batch(rows, self.root, name, str(number))

    def run_pass(self, number: int, new_deps: DataFrame, new_keys: DataFrame, looked_up: bool = False) -> DataFrame:
        """Pass `number` (1 and up): dependencies (staging_record_id, KEYS) and keys (KEYS) that came since the last one, to staging_record_id and KEYS of what is resolved now. The same pass may be run again."""
        fresh = new_deps.select("staging_record_id", *KEYS).distinct()
        keys = new_keys.select(*KEYS).where("required_value is not null and required_value != 'UNKNOWN'").distinct()
        self._write(fresh, "waiting_deps", number)
        self._write(keys, "arrived_keys", number)
        able = F.col("required_value") != "UNKNOWN"
        first = max(1, number - self.most)
        old = self._read("waiting_deps", first, number - 1).where(able)
        mine, arrived = self._read("waiting_deps", number, number).where(able), self._read("arrived_keys", number, number)
        there = arrived if looked_up else self._read("arrived_keys", 1, number)
        hits = old.join(arrived, KEYS, "left_semi").unionByName(mine.join(there, KEYS, "left_semi"))
        done = self._read("decided_deps", first, number - 1).select("staging_record_id", *KEYS)
        new = hits.select("staging_record_id", *KEYS).distinct().join(done, ["staging_record_id", *KEYS], "left_anti")
        self._write(new, "decided_deps", number)
        return self._read("decided_deps", number, number).select("staging_record_id", *KEYS)

    def expired(self, number: int) -> DataFrame:
        """Dependencies that pass `number` gives up: those that have been asked for in vain in more than `most` passes."""
        came = number - self.most
        if came < 1:
            return self._read("waiting_deps", 1, 0).select("staging_record_id", *KEYS)
        done = self._read("decided_deps", came, number).select("staging_record_id", *KEYS)
        return self._read("waiting_deps", came, came).select("staging_record_id", *KEYS).join(done, ["staging_record_id", *KEYS], "left_anti")

    def state(self, number: int) -> DataFrame:
        """All dependencies after pass `number`, as the full resolver has them: staging_record_id, KEYS, status and attempts."""
        deps = self._read("waiting_deps", 1, number).withColumn("came", F.col("batch_id").cast("int"))
        done = self._read("decided_deps", 1, number).select("staging_record_id", *KEYS, F.col("batch_id").cast("int").alias("at"))
        joined = deps.join(done, ["staging_record_id", *KEYS], "left")
        misses = F.lit(number) - F.col("came") + 1
        status = F.when(F.col("at").isNotNull(), "resolved").when(misses > self.most, "expired").otherwise("waiting")
        attempts = F.when(F.col("at").isNotNull(), F.col("at") - F.col("came")).otherwise(F.least(misses, F.lit(self.most + 1)))
        return joined.select("staging_record_id", *KEYS, status.alias("status"), attempts.cast("int").alias("attempts"))
