"""Large files as blocks: raw bytes, in the order of the file, that are read by many tasks.

A text scan cuts a file at a separator wherever its splits fall. Pieces of one
split come in order, so a task joins them to blocks of some BLOCK bytes, each
with the split's start and its number within it, and a block's state at its start
comes from a prefix sum over small summaries (one row a block) of those before it
in the file. Neither needs the file's bytes to move, and blocks are worked on in
any order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import kept_table

BLOCK = 1 << 20
#: States of so many blocks are broadcast to them; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 200_000
KEYS = ["h", "start", "seq"]
Batches = Iterator[pa.RecordBatch]


def file_key(path: Column) -> Column:
    """A number for a file, so that rows need not carry its path."""
    return F.xxhash64(path)


def listing(spark: SparkSession, paths: list[str], options: dict) -> DataFrame:
    """file, h, length and changed (its time of modification) of each file; contents are not read."""
    meta = F.col("_metadata")
    files = spark.read.format("binaryFile").options(**options).load(paths)
    return files.select(meta.file_path.alias("file"), file_key(meta.file_path).alias("h"), meta.file_size.alias("length"), meta.file_modification_time.alias("changed"))


def blocks(spark: SparkSession, paths: list[str], options: dict, separator: str, larger: int, size: int | None = None, longest: int | None = None, only: DataFrame | None = None, then: tuple[Callable[[Batches], Batches], str] | None = None) -> DataFrame:
    """h, start, seq and raw of all files of more than `larger` bytes; the separator after a block's last piece is left out.

    longest: pieces of so many bytes and more are missing or cut, so that a file
    with one has fewer bytes in blocks than in all. only: the files' h. then: what
    is made of the blocks where they are gathered, and its schema.
    """
    size = size or BLOCK
    meta, sep = F.col("_metadata"), pa.scalar(separator.encode(), pa.binary())
    if longest:
        options = {**options, "mapreduce.input.linerecordreader.line.maxlength": str(longest)}
    pieces = spark.read.options(**options).text(paths, lineSep=separator).where(meta.file_size > larger)
    pieces = pieces.select(file_key(meta.file_path).alias("h"), meta.file_block_start.alias("start"), F.col("value").cast("binary").alias("value"))
    if only is not None:
        pieces = pieces.join(F.broadcast(only), "h", "left_semi")  # no shuffle: pieces stay in order

    def gather(batches: Batches) -> Batches:
        key, seq, held, n = None, 0, [], 0

        def block() -> pa.RecordBatch:
            raw = separator.encode().join(held)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((key[0], pa.int64()), (key[1], pa.int64()), (seq, pa.int64()), (raw, pa.binary()))], names=[*KEYS, "raw"])

        for batch in batches:
            if not batch.num_rows:
                continue
            h, start = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            value = batch.column(2)
            bytes_ = np.cumsum(pc.binary_length(value).to_numpy() + 1)
            edges = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (start[1:] != start[:-1]))).tolist() + [batch.num_rows]
            for at, end in zip(edges[:-1], edges[1:]):
                if key != (h[at], start[at]):
                    if held:
                        yield block()
                    key, seq, held, n = (h[at], start[at]), 0, [], 0
                while at < end:
                    before = bytes_[at - 1] if at else 0
                    to = min(end, max(at + 1, int(np.searchsorted(bytes_, before + size - n, "right"))))
                    own = value.slice(at, to - at)
                    held.append(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), sep)[0].as_py())
                    n += int(bytes_[to - 1] - before)
                    at = to
                    if n >= size:
                        yield block()
                        seq, held, n = seq + 1, [], 0
        if held:
            yield block()

    if then:
        made, schema = then
        return pieces.mapInArrow(lambda batches: made(gather(batches)), schema)
    return pieces.mapInArrow(gather, "h bigint, start bigint, seq bigint, raw binary")


def in_order() -> tuple[object, object]:
    """Windows over the blocks of a file: those before one, and all."""
    order = Window.partitionBy("h").orderBy("start", "seq")
    return order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def settled(states: DataFrame) -> DataFrame:
    """The states of blocks, stored, and broadcast where there are few enough."""
    states = kept_table(states, "states")
    return F.broadcast(states) if states.count() <= BROADCAST_ROWS else states


def rows(work: Callable[..., Iterator[tuple]], schema: pa.Schema, most: int = 8 << 20) -> Callable[[Batches], Batches]:
    """Turns a function from a row's values to rows into one from Arrow batches to Arrow batches of at most some `most` bytes."""

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    def run(batches: Batches) -> Batches:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                for row in work(*(c[k].as_py() for c in batch.columns)):
                    held.append(row)
                    size += 64 + sum(len(x) for x in row if isinstance(x, (str, bytes)))
                    if size >= most:
                        yield batch_of(held)
                        held, size = [], 0
        if held:
            yield batch_of(held)

    return run
