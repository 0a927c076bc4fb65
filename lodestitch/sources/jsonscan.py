"""Elements of JSON files of any size, found in parallel.

A block's effect on the scanner is a transition function: whether the number of
its quotes is odd, and by how much it deepens the nesting, for either case of
beginning inside a string or not. A prefix sum over these gives each block its
state at the start; then the commas and brackets at the array's own depth are
boundaries, and what lies between two of them is an element. Elements that cross
blocks are put together from their parts. The array is the file's value itself or
that of one of the named keys of the file's object; a file with neither is one
value.

As with a file that is parsed whole, one bad element makes the file no JSON: it
gives no rows and is told. A file that ends within a string or a bracket is told
before any of it is cut. What follows a whole value is not looked at, as Spark's own
parser does not look at it.

A scan cuts files at commas, between which no element is longer than a piece. Where
a line feed serves as well (no key is looked for, and no line has LONGEST bytes) it
cuts there, which gives fewer pieces by the commas of an element.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jsonx
from ..session import kept_table
from . import blocks as bl

SEPARATOR, LINE = ",", "\n"
LONGEST = 1 << 20
QUOTE, ESCAPE, COMMA = 34, 92, 44
_STEP = np.zeros(256, np.int8)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1
_SIGNS = _STEP != 0
_SIGNS[QUOTE] = True
_SIGNS_AND_COMMAS = _SIGNS.copy()
_SIGNS_AND_COMMAS[COMMA] = True
WHOLE, BEGIN, BETWEEN, END = range(4)


def quotes(data: np.ndarray) -> np.ndarray:
    """Marks quotes that no backslash escapes."""
    out = data == QUOTE
    slash = data == ESCAPE
    if slash.any():
        at = np.flatnonzero(out)
        index = np.arange(data.size)
        last = np.maximum.accumulate(np.where(slash, -1, index))  # the last place that is no backslash
        before = np.where(at > 0, last[np.maximum(at, 1) - 1], -1)
        out[at[(at - 1 - before) % 2 == 1]] = False
    return out


class Scan:
    """Nesting of a block's bytes, for a start inside (1) or outside (0) a string. It changes at signs only: quotes and brackets; commas are kept for those who cut there."""

    def __init__(self, raw: bytes, commas: bool = False):
        data = np.frombuffer(raw, np.uint8)
        self.at = np.flatnonzero((_SIGNS_AND_COMMAS if commas else _SIGNS)[data])
        self.sign = data[self.at]
        quote = quotes(data)[self.at] if b"\\" in raw else self.sign == QUOTE
        self.odd = (np.cumsum(quote) & 1).astype(np.int8)
        self.step = _STEP[self.sign]

    def depth(self, inside: int) -> np.ndarray:
        """Depth after each sign, relative to the start."""
        return np.cumsum(np.where(self.odd == inside, self.step, 0), dtype=np.int64)

    def before(self, place: int, of: np.ndarray) -> int:
        """What `of`, a number for each sign, is before a byte."""
        k = int(np.searchsorted(self.at, place))
        return int(of[k - 1]) if k else 0


def summary(keys: tuple[str, ...]):
    pattern = re.compile(rb'"(' + b"|".join(re.escape(k.encode()) for k in keys) + rb')"\s*:\s*') if keys else None

    def work(h: int, start: int, seq: int, raw: bytes) -> Iterator[tuple]:
        scan = Scan(raw)
        by = [scan.depth(0), scan.depth(1)]
        first = raw.lstrip()[:1].decode("latin-1") or None
        hits = []
        for m in pattern.finditer(raw) if pattern else ():
            inside = scan.before(m.start(), scan.odd)  # the start that makes this quote the first of a string
            own, at = by[inside], m.end()
            rel = scan.before(m.start(), own)
            value = raw[at : at + 1].decode("latin-1")
            later = int(np.searchsorted(scan.at, at + 1))
            closed = np.flatnonzero(own[later:] <= rel) if value == "[" else ()
            hits.append({"inside": inside, "rel": rel, "name": m[1].decode(), "at": at, "value": value, "end": int(scan.at[later + closed[0]]) if len(closed) else -1})
        end = len(raw)
        yield h, start, seq, end + 1, first, scan.before(end, scan.odd), *(scan.before(end, x) for x in by), *(int(x.min(initial=0)) for x in by), hits

    return work


_HIT = pa.struct([("inside", pa.int32()), ("rel", pa.int64()), ("name", pa.string()), ("at", pa.int64()), ("value", pa.string()), ("end", pa.int64())])
_SUMMARY = pa.schema([("h", pa.int64()), ("start", pa.int64()), ("seq", pa.int64()), ("n", pa.int64()), ("first", pa.string()), ("odd", pa.int32()), ("deeper0", pa.int64()), ("deeper1", pa.int64()), ("least0", pa.int64()), ("least1", pa.int64()), ("hits", pa.list_(_HIT))])
_SUMMARY_SQL = "h bigint, start bigint, seq bigint, n bigint, first string, odd int, deeper0 bigint, deeper1 bigint, least0 bigint, least1 bigint, hits array<struct<inside: int, rel: bigint, name: string, at: bigint, value: string, end: bigint>>"


def summaries(key: str | None = None, error: str | None = None) -> tuple:
    """What is made of blocks for their states, and its schema."""
    return bl.rows(summary(tuple(k for k in (key, error) if k)), _SUMMARY), _SUMMARY_SQL


def states(told: DataFrame, key: str | None = None, error: str | None = None) -> DataFrame:
    """From the summaries: each block's state at its start, and what is known of its file: one row a block.

    n (its bytes and its separator), inside, depth and place (bytes before it); root (the file's first sign) and
    good (it ends outside strings and brackets); hit (a named key of the file's
    object in this block) and running (whether the array of one began before and
    goes on); error (the key of errors is there); last (the file's last block).
    """
    before, all_ = bl.in_order()
    none = F.lit(0).cast("bigint")
    told = told.withColumns({"inside": F.coalesce(F.sum("odd").over(before), none) % 2, "place": F.coalesce(F.sum("n").over(before), none)})
    deeper = F.when(F.col("inside") == 0, F.col("deeper0")).otherwise(F.col("deeper1"))
    told = told.withColumns({"deeper": deeper, "least": F.when(F.col("inside") == 0, F.col("least0")).otherwise(F.col("least1"))})
    told = told.withColumn("depth", F.coalesce(F.sum("deeper").over(before), none))
    told = told.withColumns({"good": (F.sum("odd").over(all_) % 2 == 0) & (F.sum("deeper").over(all_) == 0), "root": F.first("first", True).over(all_), "last": F.struct("start", "seq") == F.last(F.struct("start", "seq")).over(all_)})
    own = F.filter("hits", lambda x: (x["inside"] == F.col("inside")) & (x["rel"] + F.col("depth") == 1))
    told = told.withColumn("own", F.when(F.col("root") == "{", own))
    told = told.withColumn("hit", F.get(F.filter("own", lambda x: x["name"] == F.lit(key)), 0))
    event = F.when(F.col("hit.value") == "[", F.when(F.col("hit.end") < 0, True).otherwise(False)).when(F.col("depth") + F.col("least") <= 1, False)
    told = told.withColumns({"running": F.coalesce(F.last(event, True).over(before), F.lit(False)), "target": F.max(F.col("hit.value") == "[").over(all_), "error": F.coalesce(F.max(F.exists("own", lambda x: x["name"] == F.lit(error))).over(all_), F.lit(False))})
    return told.select(*bl.KEYS, "n", "inside", "depth", "place", "root", "good", F.col("hit.at").alias("at"), F.col("hit.value").alias("value"), "running", F.coalesce("target", F.lit(False)).alias("target"), "error", "last")


def cut(h: int, raw: bytes, inside: int, depth: int, place: int, root: str, at: int | None, value: str | None, running: bool, target: bool, last: bool, separator: str) -> Iterator[tuple]:
    """h, position in the file, kind and text of the elements and parts of elements in a block."""
    whole = raw if last else raw + separator.encode()
    level = 1 if root == "[" else 2 if target else 0
    if level == 0:
        yield h, place, BETWEEN, whole
        return
    begins = at if level == 2 and value == "[" else None
    if level == 2 and begins is None and not running:
        return
    scan = Scan(whole, commas=True)
    deep = depth + scan.depth(inside)
    outside = scan.odd == inside
    edge = outside & (((scan.sign == COMMA) & (deep == level)) | ((scan.step == 1) & (deep == level)) | ((scan.step == -1) & (deep == level - 1)))
    edges, steps = scan.at[edge], scan.step[edge]
    if begins is not None:
        edges, steps = edges[edges >= begins], steps[edges >= begins]
        opened = False
    else:
        opened = depth >= level
    start = 0
    for e, step in zip(edges.tolist(), steps.tolist()):
        if opened:
            yield h, place + start, END if start == 0 else WHOLE, whole[start:e]
        opened, start = step >= 0, e + 1
        if not opened:
            break  # the array's own end
    if opened:
        yield h, place + start, BEGIN if start else BETWEEN, whole[start:]


_CUT = pa.schema([("h", pa.int64()), ("position", pa.int64()), ("kind", pa.int32()), ("text", pa.binary())])
_CUT_SQL = "h bigint, position bigint, kind int, text binary"


def all_states(spark: SparkSession, paths: list[str], options: dict, larger: int, key: str | None, error: str | None) -> DataFrame:
    """states() of all files of more than `larger` bytes, stored, and `separator`, at which a file is cut."""
    with_separator = lambda rows, x: rows.withColumn("separator", F.lit(x))
    if key or error:
        return with_separator(bl.settled(states(bl.blocks(spark, paths, options, SEPARATOR, larger, then=summaries(key, error)), key, error)), SEPARATOR)
    by_line = kept_table(states(bl.blocks(spark, paths, options, LINE, larger, longest=LONGEST, then=summaries())), "by-line")
    files = bl.listing(spark, paths, options).where(F.col("length") > larger)
    # a last piece may have no separator
    fits = files.join(by_line.groupBy("h").agg(F.sum("n").alias("n")), "h", "left").select("h", F.coalesce(F.col("n") >= F.col("length"), F.lit(False)).alias("fits"))
    fits = bl.settled(fits)
    out, rest = with_separator(by_line.join(fits.where("fits"), "h", "left_semi"), LINE), fits.where("not fits").select("h")
    if rest.isEmpty():
        return bl.settled(out)
    by_comma = states(bl.blocks(spark, paths, options, SEPARATOR, larger, only=rest, then=summaries()))
    return bl.settled(out.unionByName(with_separator(by_comma, SEPARATOR)))


def parts_of(spark: SparkSession, paths: list[str], options: dict, larger: int, state: DataFrame) -> DataFrame:
    """h, position, kind, text and doc (Variant) of all that is cut from the good files without an error key; a whole element that parses has no text, all else no doc."""
    found = None
    separators = sorted(r.separator for r in state.where("good and not error").select("separator").distinct().collect())
    for separator in separators:
        good = state.where((F.col("separator") == separator) & F.expr("good and not error"))
        longest, only = (LONGEST, None) if separator == LINE else (None, good.select("h").distinct() if len(separators) > 1 else None)
        joined = bl.blocks(spark, paths, options, separator, larger, longest=longest, only=only).join(good, bl.KEYS)
        own = joined.select("h", "raw", "inside", "depth", "place", "root", "at", "value", "running", "target", "last", "separator").mapInArrow(bl.rows(cut, _CUT), _CUT_SQL)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = spark.createDataFrame([], _CUT_SQL)
    parsed = found.withColumn("text", F.col("text").cast("string")).withColumn("doc", jsonx.parse("text"))
    whole = (F.col("kind") == WHOLE) & F.col("doc").isNotNull()
    return parsed.select("h", "position", "kind", F.when(~whole, F.col("text")).alias("text"), F.when(whole, F.col("doc")).alias("doc"))


def stitched(found: DataFrame) -> DataFrame:
    """h, position and text of the elements that cross blocks; a part is as long as a block at most, an element as long as it is."""
    upto = Window.partitionBy("h").orderBy("position", "kind").rowsBetween(Window.unboundedPreceding, 0)
    numbered = found.where(F.col("kind") != WHOLE).withColumn("element", F.sum((F.col("kind") == BEGIN).cast("bigint")).over(upto))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "kind", "text"))), lambda x: x["text"]), "")
    return numbered.groupBy("h", "element").agg(F.min("position").alias("position"), joined.alias("text")).select("h", "position", "text")


def large_elements(spark: SparkSession, paths: list[str], options: dict, larger: int, key: str | None = None, error: str | None = None) -> tuple[DataFrame, DataFrame]:
    """h, position, doc (Variant) and shape (list, named or single) of all elements of the files of more than `larger` bytes; and h and error of the files that give none.

    Two scans come first: one for the states, and one that cuts the elements, parses
    and stores them, so that those that cross blocks and bad ones are known before
    any is given. Files with longer lines take another for the states.
    """
    state = all_states(spark, paths, options, larger, key, error)
    parts = kept_table(parts_of(spark, paths, options, larger, state), "parts")
    filled = F.col("text").rlike(r"\S")
    odd = kept_table(parts.where((F.col("kind") != WHOLE) | filled).select("h", "position", "kind", "text"), "odd")
    joined = kept_table(stitched(odd).where(filled).select("h", "position", jsonx.parse("text").alias("doc")), "stitched")
    bad = odd.where(F.col("kind") == WHOLE).select("h").unionByName(joined.where("doc is null").select("h")).distinct()
    broken = state.where("error or not good").groupBy("h").agg(F.when(F.max("error"), "error reported").otherwise("not valid JSON").alias("error"))
    errors = kept_table(broken.unionByName(bad.withColumn("error", F.lit("not valid JSON"))), "errors")
    shape = F.when(F.first("root") == "[", "list").when(F.first("target"), "named").otherwise("single")
    files = state.groupBy("h").agg(shape.alias("shape")).join(errors, "h", "left_anti")
    files = kept_table(files, "files")
    files = F.broadcast(files) if files.count() <= bl.BROADCAST_ROWS else files
    rows = parts.where((F.col("kind") == WHOLE) & F.col("doc").isNotNull()).select("h", "position", "doc").unionByName(joined).join(files, "h")
    return rows.select("h", "position", "doc", "shape"), errors
