"""Slices of the given tables, landed as the files of a drop, so that queries read them back through the readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch


def folder(spark: SparkSession, what: str) -> str:
    return scratch(spark, f"drop-{what}")


def _moved(spark: SparkSession, written: str, where: str, suffix: str) -> None:
    """Names the files that Spark wrote by their place and a suffix; only names pass the driver."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    source = paths(written)
    system = source.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(paths(where))
    files = system.listFiles(source, True)
    n = 0
    while files.hasNext():
        file = files.next().getPath()
        if file.getName().startswith("part-"):
            system.rename(file, paths(f"{where}/{written.rsplit('-', 1)[-1][:8]}-{n:05d}{suffix}"))
            n += 1


def land_lines(rows: DataFrame, where: str, suffix: str) -> None:
    """Rows (value) as the lines of files."""
    written = scratch(rows.sparkSession, "written")
    rows.select("value").write.text(written)
    _moved(rows.sparkSession, written, where, suffix)


#: Keys below this are landed as a single object each, the others as lists of SLICE keys: a file costs far more than a row.
SINGLE, SLICE = 100, 10_000


def land_objects(rows: DataFrame, key: str, by: Column, item: Column, where: str) -> None:
    """JSON items of rows: a file for each row where the key is below SINGLE, else a file for each `by` and slice of the keys."""
    of = F.when(F.col(key) < SINGLE, F.concat(F.lit("o"), F.monotonically_increasing_id())).otherwise(F.concat_ws("-", F.lit("l"), by, F.floor(F.col(key) / SLICE)))
    single, listed = (rows.withColumn("of", of).where(F.col("of").startswith(x)) for x in "ol")
    land_files(single, "of", F.to_json(item), where, ".json")
    land_files(listed.groupBy("of").agg(F.collect_list(item).alias("v")), "of", F.to_json("v"), where, ".json")


def land_files(rows: DataFrame, key: str, value: Column, where: str, suffix: str) -> None:
    """One file for each key, which is a row of its own."""
    written = scratch(rows.sparkSession, "written")
    rows.select(F.col(key).alias("part"), value.alias("value")).write.partitionBy("part").text(written)
    _moved(rows.sparkSession, written, where, suffix)


def land_lists(rows: DataFrame, where: str) -> None:
    """Rows (part, value) as the items of a list for each part, after a null; each is a file, written by one task."""
    items = rows.select("part", F.lit(1).alias("at"), F.concat(F.lit(","), "value").alias("value"))
    end = lambda n, x: rows.select("part").distinct().select("part", F.lit(n).alias("at"), F.lit(x).alias("value"))
    written = scratch(rows.sparkSession, "written")
    ordered = items.unionByName(end(0, "[null")).unionByName(end(2, "]")).repartition("part").sortWithinPartitions("part", "at")
    ordered.select("part", "value").write.partitionBy("part").text(written)
    _moved(rows.sparkSession, written, where, ".json")


def land_csv(rows: DataFrame, where: str, **options: str | bool) -> None:
    written = scratch(rows.sparkSession, "written")
    rows.write.options(header=True, **options).csv(written)
    _moved(rows.sparkSession, written, where, ".csv")
