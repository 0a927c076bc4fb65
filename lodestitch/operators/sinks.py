"""Parquet sinks: batches that can be written again, appended tables, and a status log in the place of updates.

A batch has a folder of its own in its table. Writing it again overwrites that
folder, and Spark's _SUCCESS file, which comes last, is what makes it be read: a
batch that broke off half way is not there until it is written again. A table is
written either by batches or by append. A frame that was read before a batch was
written again has to be read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES, conform, empty
from ..sources.readers import exists

#: The column that names a batch's folder.
BATCH = "batch_id"
PARTITIONS = {"raw_records": ["source_id", "batch_id"], "staging_records": ["source_id"], "entity_links": ["source_entity"]}


def append(df: DataFrame, root: str, name: str) -> None:
    """Appends rows in the table's columns; tables appear with their first rows.

    Rows are dealt to their partitions first where the table has some, so that
    a task does not write a small file into each; adaptive execution splits large ones.
    """
    out = conform(df, name)
    keys = PARTITIONS.get(name, [])
    if keys:
        out = out.hint("rebalance", *keys)
    writer = out.write.mode("append")
    (writer.partitionBy(*keys) if keys else writer).parquet(f"{root}/{name}")


def write_batch(df: DataFrame, root: str, name: str, batch: str) -> None:
    """Writes the rows of one batch in the table's columns, in the place of those of an earlier run of the batch."""
    keys = [k for k in PARTITIONS.get(name, []) if k != "batch_id"]
    out = conform(df, name).drop("batch_id")
    if keys:
        out = out.hint("rebalance", *keys)
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*keys) if keys else writer).parquet(f"{root}/{name}/{BATCH}={batch}")


def written_batches(spark: SparkSession, root: str, name: str) -> list[str]:
    """Folders of the batches that were written whole."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/{BATCH}=*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(f.getPath().getParent().toString() for f in found or [])


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table, empty if nothing was written yet."""
    path = f"{root}/{name}"
    if not exists(spark, path):
        return empty(spark, name)
    schema = empty(spark, name).schema
    if not exists(spark, f"{path}/{BATCH}=*"):
        return conform(spark.read.schema(schema).parquet(path), name)
    return _of_batches(spark, root, name, written_batches(spark, root, name))


def _of_batches(spark: SparkSession, root: str, name: str, folders: list[str]) -> DataFrame:
    if not folders:
        return empty(spark, name)
    schema = empty(spark, name).schema
    if BATCH not in schema.names:
        schema = schema.add(BATCH, "string")
    return conform(spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(*folders), name)


def read_numbered(spark: SparkSession, root: str, name: str, since: int, upto: int) -> DataFrame:
    """The batches of a table whose names are numbers from since to upto; no other is read."""
    return _of_batches(spark, root, name, [f"{root}/{name}/{BATCH}={n}" for n in _numbers(spark, root, name) if since <= n <= upto])


def append_status(outcome: DataFrame, run_id: int, root: str) -> None:
    """Writes a run's outcome to the log; the same run may be written again."""
    write_batch(outcome.select(F.col("id").alias("staging_id"), F.lit(run_id).alias("run_id"), "status", "reason"), root, "status_log", str(run_id))


def current_status(log: DataFrame) -> DataFrame:
    """The status of each record in its latest run."""
    last = F.max_by(F.struct("status", "reason", "run_id"), "run_id").alias("x")
    return log.groupBy("staging_id").agg(last).select("staging_id", "x.status", "x.reason", "x.run_id")


def _numbers(spark: SparkSession, root: str, name: str) -> list[int]:
    return sorted(int(b.rsplit("=", 1)[1]) for b in written_batches(spark, root, name))


def stored_status(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """current_status of the log, from the last whole snapshot and the runs after it.

    Only these runs are grouped; a snapshot has each record once, and a row of it
    stays unless a later run has its record, so that it meets no shuffle where the
    runs are few enough to be broadcast.
    """
    snapshots = [n for n in _numbers(spark, root, "status_snapshot") if upto is None or n <= upto]
    last = snapshots[-1:]
    runs = [n for n in _numbers(spark, root, "status_log") if (not last or n > last[0]) and (upto is None or n <= upto)]
    of = lambda name, numbers: _of_batches(spark, root, name, [f"{root}/{name}/{BATCH}={n}" for n in numbers])
    later = current_status(of("status_log", runs))
    kept = of("status_snapshot", last).join(later.select("staging_id"), "staging_id", "left_anti")
    return kept.select("staging_id", "status", "reason", "run_id").unionByName(later)


def compact_status(spark: SparkSession, root: str, upto: int) -> None:
    """Writes the status after run `upto` as a snapshot. It is read from the moment it is whole; before that, and if it breaks off, the log is read as before. Runs that come late with a number up to `upto` must be written before."""
    write_batch(stored_status(spark, root, upto), root, "status_snapshot", str(upto))


def retire_status(spark: SparkSession, root: str) -> list[str]:
    """Deletes what the last whole snapshot stands for: the runs up to it, and older snapshots. Frames that were made before have to be made again."""
    snapshots = _numbers(spark, root, "status_snapshot")
    gone = []
    if snapshots:
        gone = [f"{root}/status_snapshot/{BATCH}={n}" for n in snapshots[:-1]] + [f"{root}/status_log/{BATCH}={n}" for n in _numbers(spark, root, "status_log") if n <= snapshots[-1]]
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return gone


def create_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: empty(spark, name) for name in TABLES}
