"""Raw envelope to staging: hashes, entity types, uniqueness, counts and source metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonx


def with_checksum(raw: DataFrame) -> DataFrame:
    """checksum of the canonical payload; a preset one wins."""
    return raw.withColumn("checksum", jsonx.content_hash("payload", F.col("checksum")))


#: Bits of an id that tell a row's place in its slot; the others number slots in the order of arrival.
SLOT_BITS = 37
#: Files of so many are broadcast to their rows; beyond that they are joined by a shuffle.
BROADCAST_FILES = 200_000


def numbered_files(files: DataFrame, after: int = 0) -> DataFrame:
    """source_id, file_path and slot of landed files (source_id, file, length, changed), in the order of their time and name, after the slots that are taken.

    A file takes a slot for each 2 ** 37 bytes. The running sum is over one row a
    file, which the driver's own list of files holds too.
    """
    order = Window.orderBy("changed", "file", "source_id").rowsBetween(Window.unboundedPreceding, -1)
    takes = F.shiftright("length", SLOT_BITS) + 1
    return files.select("source_id", F.col("file").alias("file_path"), (F.lit(after) + 1 + F.coalesce(F.sum(takes).over(order), F.lit(0))).cast("bigint").alias("slot"))


def last_slot(raw: DataFrame) -> int:
    """The last slot that the stored raw records have taken; the next batch's files come after it."""
    return raw.agg(F.coalesce(F.max(F.shiftright("id", SLOT_BITS)), F.lit(0)).alias("n")).first().n


def raw_records(raw: DataFrame, batch_id: str, ingested_at: str | None = None, place: Column | None = None, files: DataFrame | None = None) -> DataFrame:
    """Envelope rows as raw records of one batch: one for each source row, repeated rows too.

    `files` (numbered_files) gives ids in the order of arrival: slot of the file,
    then place in it. They are the same however a scan is split. Rows without a
    place in a numbered file, or without `files`, get a hash of source, checksum,
    file, batch and `place` (by default the row's place in this reading: append
    such records to their table before they are used twice). Where there are files
    hashes are negative, so that they never meet a number.
    """
    told = with_checksum(raw.withColumns({"batch_id": F.lit(batch_id), "__place": F.monotonically_increasing_id() if place is None else place}))
    at = F.lit(ingested_at).cast("timestamp") if ingested_at else F.current_timestamp()
    key = F.xxhash64("source_id", "checksum", F.coalesce("file_path", F.lit("")), "batch_id", "__place")
    if files is not None:
        own = F.broadcast(files) if files.count() <= BROADCAST_FILES else files
        told = told.join(own, ["source_id", "file_path"], "left")
        key = F.coalesce(F.shiftleft("slot", SLOT_BITS) + F.col("position"), -F.shiftrightunsigned(key, 1) - 1)
    return told.select(key.alias("id"), "source_id", "batch_id", "content_type", jsonx.wrap_list("payload").alias("raw_data"), "file_path", "checksum", at.alias("ingested_at"))


#: Bits of an id below which ranked() orders rows within a task; the parts above are counted.
RANK_BITS = 20


def ranked(raw: DataFrame) -> DataFrame:
    """Raw records of numbered files with `rank`, their number in their file, from 0, in the order of their ids (which number rows of small files, and first bytes of large ones).

    Ids are cut into parts of 2 ** RANK_BITS, so a sort holds a part at most, and
    a running sum over one row a part tells how many rows come before it.
    """
    part = F.shiftright("id", RANK_BITS)
    before = Window.partitionBy(F.shiftright("__part", SLOT_BITS - RANK_BITS)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counted = raw.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    starts = counted.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = raw.withColumn("__part", part).withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy("id")) - 1)
    return own.join(starts, "__part").withColumn("rank", F.col("__before") + F.col("__in")).drop("__part", "__in", "__before")


def dealt(scan: DataFrame) -> DataFrame:
    """A scan's rows, dealt to all cores where it has fewer tasks than these: a file of one row group is one task, and mapping a payload costs far more than moving it. For scans alone, as other plans would run to be asked for their tasks."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def stage(raw: DataFrame, catalog: DataFrame) -> DataFrame:
    """Raw records as pending staging records; the catalog (a row per source) gives the entity type, "unknown" by default."""
    types = catalog.select(F.col("id").alias("source_id"), F.col("entity_type").alias("__type"))
    joined = raw.join(types, "source_id", "left")
    return joined.select(
        F.col("id"),
        F.col("id").alias("raw_record_id"),
        "source_id",
        F.coalesce("__type", F.lit("unknown")).alias("entity_type"),
        F.col("raw_data").alias("payload"),
        F.col("checksum").alias("record_hash"),
        F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("suspension_reason"),
    )


def unique_records(staging: DataFrame) -> DataFrame:
    """One row for each (raw_record_id, record_hash), that of the least id."""
    return _least(staging, "raw_record_id", "record_hash")


def content_dedup(staging: DataFrame) -> DataFrame:
    """Opt-in: one row for each content of a source, that of the least id."""
    return _least(staging, "source_id", "record_hash")


def _least(df: DataFrame, *keys: str) -> DataFrame:
    # an aggregate and a join back: the ids are pre-aggregated, so a hot key is no single task
    kept = df.groupBy(*keys).agg(F.min("id").alias("id"))
    return df.join(kept.select("id").distinct(), "id", "left_semi").dropDuplicates([*keys, "id"])


def source_counts(catalog: DataFrame, staging: DataFrame) -> DataFrame:
    """Rows by enabled source; one without rows counts 0."""
    counted = staging.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_rows"))
    enabled = catalog.where(F.coalesce("enabled", F.lit(True))).select(F.col("id").alias("source_id"))
    return enabled.join(counted, "source_id", "left").select("source_id", F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"))


_CATALOG_COLUMNS = ("name", "category", "adapter", "access_mode", "schedule", "availability_window", "config")


def upsert_sources(catalog: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored sources with the catalog's columns where it names them; defaults "unknown" and "manual" for new ones."""
    new = catalog.select("id", *(F.col(c).alias(f"__{c}") for c in _CATALOG_COLUMNS if c in catalog.columns), F.lit(True).alias("__new"))
    joined = stored.join(new, "id", "full")
    defaults = {"category": "unknown", "adapter": "unknown", "access_mode": "manual", "name": None}
    columns = []
    for c in stored.columns:
        if f"__{c}" in new.columns:
            own = F.coalesce(F.col(f"__{c}"), F.lit(defaults.get(c)) if c != "name" else F.col("id"))
            columns.append(F.when(F.col("__new"), own).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return joined.select(*columns)


def source_outcomes(log: DataFrame) -> DataFrame:
    """Of an ingest log (source_id, ts, error): the last run of each source and its error, null after a good run."""
    return log.groupBy("source_id").agg(F.max("ts").alias("last_run_at"), F.max_by("error", "ts").alias("last_error"))


def list_payloads(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """One list payload for each key, in order, wrapped as {"items": [...]}: a group is a record, as long as its items."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*columns).alias("item")))), lambda x: x["item"])
    return rows.groupBy(key).agg(F.concat(F.lit('{"items":'), F.to_json(items), F.lit("}")).alias("payload"), F.count(F.lit(1)).alias("n_items"))
