"""What jobs need of their session: the folder that all executors share, and cutting lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local session (as in tests) gets a folder of its own; on a cluster that is an error, as executors share no local folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            return kept.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file:///tmp/spark-shared-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cuts a frame's lineage by checkpoint(). Spark deletes the files with the frame where spark.cleaner.referenceTracking.cleanCheckpoints is true; else they stay in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def kept_table(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder and reads them again."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
