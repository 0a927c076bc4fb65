"""CSV records as RFC 4180 has them: quoted commas, doubled quotes and line breaks within quotes, in files of any size.

A line takes a reader that stands outside quotes, or inside, to outside or inside:
a function of two states. Lines without a quote change neither. A block's function
is that of its lines in turn; the state at its start comes from those before it by
a prefix scan (see blocks). A record that crosses blocks is put together from its
lines. A quote within a field that does not begin with one is an ordinary sign.

All values stay text; an empty one is null, missing ones at the end too, blank
lines are skipped, and a repeated column name gets .1, .2 and so on. A record with
more fields than the header, or whose quote is never closed, gives no row and is
told.
"""

from __future__ import annotations

import csv
import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import kept_table
from . import blocks as bl

SEPARATOR = "\n"
WHOLE, BEGIN, BETWEEN, END = range(4)
_QUOTED = rb'"(?:[^"]++|"")*+'
_OPEN = re.compile(rb"(?:(?:" + _QUOTED + rb'"[^,]*+|[^",][^,]*+|),)*+' + _QUOTED)
_CLOSING = re.compile(rb'(?:[^"]++|"")*+"[^,]*+(?:,|\Z)')


def after(line: bytes, inside: bool) -> bool:
    """Whether a line that begins outside or inside quotes ends inside them."""
    if b'"' not in line:
        return inside
    if inside:
        closed = _CLOSING.match(line)
        if closed is None:
            return True
        line = line[closed.end() :]
    return _OPEN.fullmatch(line) is not None


def records(raw: bytes, inside: bool = False) -> Iterator[tuple[int, int, bytes]]:
    """Position, kind and bytes of the records and parts of records in a block."""
    at = begin = 0
    state = inside
    for line in raw.split(b"\n"):
        state, at = after(line, state), at + len(line) + 1
        if not state:
            yield begin, END if inside else WHOLE, raw[begin : at - 1]
            begin, inside = at, False
    if state:
        yield begin, BETWEEN if inside else BEGIN, raw[begin:] + b"\n"


def fields(record: bytes) -> list[str]:
    text = record.removesuffix(b"\r").decode("utf-8", "replace")
    if '"' not in text:
        return text.split(",")
    csv.field_size_limit(sys.maxsize)
    return next(csv.reader([text]))


def header(names: list[str]) -> list[str]:
    """Column names, each once."""
    out: list[str] = []
    for name in names:
        n, own = 0, name
        while own in out:
            n += 1
            own = f"{name}.{n}"
        out.append(own)
    return out


def payload(record: bytes, names: list[str]) -> tuple[str | None, str | None]:
    """The row as JSON {"row": {...}}, or what is wrong with it."""
    try:
        values = fields(record)
    except csv.Error as error:
        return None, str(error)
    if len(values) > len(names):
        return None, f"{len(names)} fields expected, {len(values)} found"
    row = dict.fromkeys(names) | {k: v or None for k, v in zip(names, values)}
    return json.dumps({"row": row}, ensure_ascii=False, separators=(",", ":")), None


def whole_file(file: str, raw: bytes | None) -> Iterator[tuple]:
    """file, position, payload and error of each record of a file."""
    names = None
    for at, kind, record in records(raw or b""):
        if kind == BEGIN:
            yield file, at, None, "a quote is not closed"
        elif record.strip():
            if names is None:
                names = header(fields(record))
            else:
                yield file, at, *payload(record, names)


_FILE_ROWS = pa.schema([("file", pa.string()), ("position", pa.int64()), ("payload", pa.string()), ("error", pa.string())])
_SUMMARY = pa.schema([("h", pa.int64()), ("start", pa.int64()), ("seq", pa.int64()), ("n", pa.int64()), ("from0", pa.int32()), ("from1", pa.int32()), ("names", pa.list_(pa.string())), ("skip", pa.int64())])
_CUT = pa.schema([("h", pa.int64()), ("position", pa.int64()), ("kind", pa.int32()), ("payload", pa.string()), ("error", pa.string()), ("text", pa.binary())])
_CUT_SQL = "h bigint, position bigint, kind int, payload string, error string, text binary"


def small_rows(files: DataFrame) -> DataFrame:
    """file, position, payload and error of all records of whole files (file, value)."""
    return files.select("file", F.col("value").cast("binary")).mapInArrow(bl.rows(whole_file, _FILE_ROWS), "file string, position bigint, payload string, error string")


def summary(h: int, start: int, seq: int, raw: bytes) -> Iterator[tuple]:
    from0, from1 = False, True
    for line in raw.split(b"\n") if b'"' in raw else ():
        from0, from1 = after(line, from0), after(line, from1)
    names, skip = None, 0
    if start == 0 and seq == 0:  # a header is no longer than a block, and begins outside quotes
        for at, kind, record in records(raw):
            if kind == WHOLE and record.strip():
                names, skip = header(fields(record)), at + len(record) + 1
                break
    yield h, start, seq, len(raw) + 1, int(from0), int(from1), names, skip


def states(parts: DataFrame) -> DataFrame:
    """Of each block: inside (quotes, at its start), place (bytes before it), names (of its file's columns), skip (bytes of the header in it) and crossing (a record goes on from the block before it, or into the next)."""
    told = parts.mapInArrow(bl.rows(summary, _SUMMARY), "h bigint, start bigint, seq bigint, n bigint, from0 int, from1 int, names array<string>, skip bigint")
    before, all_ = bl.in_order()
    none = F.lit(0).cast("bigint")
    fixed, turns = F.col("from0") == F.col("from1"), (F.col("from0") > F.col("from1")).cast("bigint")
    told = told.withColumns({"turned": F.coalesce(F.sum(turns).over(before), none), "place": F.coalesce(F.sum("n").over(before), none), "names": F.first("names", True).over(all_)})
    told = told.withColumn("known", F.last(F.when(fixed, F.struct("from0", "turned")), True).over(before))
    inside = (F.coalesce("known.from0", F.lit(0)) + F.col("turned") - F.coalesce("known.turned", none)) % 2
    told = told.withColumn("inside", inside == 1)
    ends = F.when(F.col("inside"), F.col("from1")).otherwise(F.col("from0")) == 1
    return told.select(*bl.KEYS, "inside", "place", "names", "skip", (F.col("inside") | ends).alias("crossing"))


def cut(h: int, raw: bytes, inside: bool, place: int, names: list[str] | None, skip: int) -> Iterator[tuple]:
    for at, kind, record in records(raw, inside):
        if kind != WHOLE:
            yield h, place + at, kind, None, None, record
        elif at >= skip and record.strip() and names is not None:
            yield h, place + at, kind, *payload(record, names), None


def large_rows(spark: SparkSession, paths: list[str], options: dict, larger: int) -> DataFrame:
    """h, position, payload and error of all records of the files of more than `larger` bytes. One scan comes first, for the states, and another where records cross blocks."""
    state = bl.settled(states(bl.blocks(spark, paths, options, SEPARATOR, larger)))

    def parts(own: DataFrame) -> DataFrame:
        joined = bl.blocks(spark, paths, options, SEPARATOR, larger).join(own, bl.KEYS)
        return joined.select("h", "raw", "inside", "place", "names", "skip").mapInArrow(bl.rows(cut, _CUT), _CUT_SQL)

    rows = parts(state).where(F.col("kind") == WHOLE).select("h", "position", "payload", "error")
    crossing = state.where("crossing")
    if crossing.isEmpty():
        return rows
    upto = Window.partitionBy("h").orderBy("position", "kind").rowsBetween(Window.unboundedPreceding, 0)
    numbered = parts(crossing).where(F.col("kind") != WHOLE).withColumn("record", F.sum((F.col("kind") == BEGIN).cast("bigint")).over(upto))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "kind", F.col("text").cast("string").alias("text")))), lambda x: x["text"]), "")
    joined = numbered.groupBy("h", "record").agg(F.min("position").alias("position"), text.alias("text"), (F.max("kind") == END).alias("closed"))
    named = joined.join(state.groupBy("h").agg(F.first("names").alias("names")), "h").where("names is not null")

    def parse(h: int, position: int, text: bytes, closed: bool, names: list[str]) -> Iterator[tuple]:
        yield h, position, END, *(payload(text, names) if closed else (None, "a quote is not closed")), None

    crossed = named.select("h", "position", F.col("text").cast("binary"), "closed", "names").mapInArrow(bl.rows(parse, _CUT), _CUT_SQL)
    return rows.unionByName(kept_table(crossed.select("h", "position", "payload", "error"), "crossed"))


def large_lines(spark: SparkSession, paths: list[str], options: dict, larger: int) -> DataFrame:
    """h, position (in bytes) and value of all lines of the files of more than `larger` bytes."""
    before, _ = bl.in_order()
    found = bl.blocks(spark, paths, options, SEPARATOR, larger)
    sizes = found.select(*bl.KEYS, (F.octet_length("raw") + 1).alias("n"))
    places = bl.settled(sizes.select(*bl.KEYS, F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("place")))

    def lines(h: int, raw: bytes, place: int) -> Iterator[tuple]:
        for line in raw.split(b"\n"):
            if line.strip():
                yield h, place, line
            place += len(line) + 1

    schema = pa.schema([("h", pa.int64()), ("position", pa.int64()), ("value", pa.binary())])
    out = found.join(places, bl.KEYS).select("h", "raw", "place").mapInArrow(bl.rows(lines, schema), "h bigint, position bigint, value binary")
    return out.withColumn("value", F.col("value").cast("string"))
