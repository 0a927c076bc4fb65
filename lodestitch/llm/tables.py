"""Reading the given tables and small helpers that all operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, kept_table, shared_dir

__all__ = ["crc_mod", "cut", "kept_table", "packed", "shared_dir", "small_batches", "table", "text_key"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Rows of long texts must not fill a Python worker; a session keeps a smaller setting of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) <= 0 or int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def crc_mod(key: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id gives null."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % n


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """Each row as one struct `row` beside the given columns, so that no name of the input can clash with one of ours; select("row.*") gives it back."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in columns.items()))


def text_key(c: str = "text") -> list[Column]:
    """128 bits that stand for a row's text, t1 and t2."""
    return [F.xxhash64(c).alias("t1"), F.xxhash64(F.lit("text"), c).alias("t2")]
