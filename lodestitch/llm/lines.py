"""Operator 1, line dedup: a segment-partition edit join over lines, in DataFrame functions only.

A line goes when it stands earlier in the corpus (by doc_id, null last, then
position), or when a near line does. Two lines are near when they differ by at
most `edits` edits and at most one for each `per` characters of the shorter
one: lines of fewer than `per` characters by none, of fewer than 2 * per by one.

Method. Distinct lines that may differ by k edits are split into k + 1
segments; each segment is indexed under its text, number and the line's
length. A line probes the indexes of its own and the `edits` shorter lengths
with those substrings whose places can still lead to the allowed edits. What
shares a key is a candidate.

Keys of more than HOT lines are never compared pair by pair. Their lines are keyed
as a whole: code points fall into 2 * edits + 3 classes, an edit touches two at
most, so the characters of some three classes stand alike in both lines; each
three are a key, which parts lines that share a phrase or differ by words. What
then still shares a key of more than MANY lines comes from templates that differ
in few places: within each common segment, what is left of the line without it is
halved, level by level. Of two edits,
either one half has none (its text is a key, the other half is left), or each
half has one (the texts of a half without one character are keys, of the half
whose keys are common to fewer lines; a common one leaves the other half with
one edit). Ends of at most SHORT characters are keyed by what remains without
any one or two characters. So each line gets some hundred keys at worst,
whatever the number of lines alike, and what meets is nearly always a link. Where
such keys meet, a signature of letter counts is compared at once.
Candidates are compared by letter counts, then verified by a banded
bit-parallel automaton: one BIGINT holds, for each number of edits, the
reachable diagonals of the band.

Skew: equal lines are joined before any key is made, so a common line is one
row; key sizes are partial aggregates, no window holds a key's lines; joins
back to the occurrences are equi-joins that adaptive execution can split.

Rows: a null text has no lines and stays null; an empty text is one empty line.
Lines are parted by \\n alone. doc_id may be of any type that sorts. Rows of
different text that repeat a doc_id (or have none) come in the order of their
texts' hashes, and each loses its own lines. Of rows that repeat both, one
stays. Any other columns, whatever their names, are left alone. The query
op1_lines counts by its SQL, where places are doc_id and position alone.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import cut, kept_table, packed, table, text_key

EDITS = 2
#: Characters of the shorter line for each edit.
PER = 5
#: Lines under one key from which on they are not compared directly.
HOT = 8
#: Lines under one key of classes from which on they are not compared directly.
MANY = 512
#: Length of what is left from which on it is no longer halved.
SHORT = 8
#: Ids that may be broadcast, some 64 MB; beyond, a shuffled join takes their place.
BROADCAST_ROWS = 2_000_000


def split_lines(text: str | Column) -> Column:
    return F.split(text, "\n", -1)


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, pos and line of every line; a null text gives one row without pos."""
    return docs.select("doc_id", F.posexplode_outer(split_lines("text")).alias("pos", "line"))


def allowed(n: str, edits: int, per: int) -> str:
    """Edits that a line of n characters allows."""
    return f"cast(least({edits}, {n} div {per}) as int)"


def _cuts(k: int, less: int) -> dict[str, str]:
    """Starts (from 1) and sizes of the k + 1 segments of length n - less: equal parts, the longer ones last."""
    m, out = k + 1, {}
    size, rest = f"((n - {less}) div {m})", f"((n - {less}) % {m})"
    for i in range(1, m + 1):
        out[f"start_{k}_{less}_{i}"] = f"cast(1 + {i - 1} * {size} + greatest(0, {i - 1 - m} + {rest}) as int)"
        out[f"size_{k}_{less}_{i}"] = f"cast({size} + if({rest} > {m - i}, 1, 0) as int)"
    return out


def _segment_keys(side: str, edits: int) -> list[tuple[int, int, int, int]]:
    """(k, less, segment, shift) of every key of an indexed line ("index") or of a probing one."""
    out = []
    for k in range(1, edits + 1):
        for less in range((0 if side == "index" else k) + 1):
            for i in range(1, k + 2):
                low, high = (0, 0) if side == "index" else (max(-(i - 1), less - (k + 1 - i)), min(i - 1, less + k + 1 - i))
                out += [(k, less, i, shift) for shift in range(low, high + 1)]
    return out


def _with_cuts(rows: DataFrame, side: str, edits: int) -> DataFrame:
    return rows.withColumns({name: F.expr(x) for k in range(1, edits + 1) for less in range((0 if side == "index" else k) + 1) for name, x in _cuts(k, less).items()})


def _by_length(side: str, edits: int, one: Callable[[str, str, int, int, int], str], when: Callable[[int, int], str]) -> str:
    """Array of `one` (of place, size, segment, less and k) for each key; those of k edits and a length less by `less` only `when` it holds."""
    arrays = []
    for k in range(1, edits + 1):
        for less in range((0 if side == "index" else k) + 1):
            own = [one(f"(start_{k}_{less}_{i} + {shift})", f"size_{k}_{less}_{i}", i, less, k) for kk, ll, i, shift in _segment_keys(side, edits) if (kk, ll) == (k, less)]
            arrays.append(f"if({when(k, less)}, array({', '.join(own)}), array())")
    return f"concat({', '.join(arrays)})"


def _first_key(at: str, size: str, i: int, less: int) -> str:
    return f"xxhash64(substring(line, {at}, {size}), {i}, n - {less})"


def _key_rows(lines: DataFrame, side: str, edits: int, per: int) -> DataFrame:
    """lines (line, id, n) to id and key: of each segment of a line ("index"), or of each substring that can be one of a line as long or up to `edits` shorter ("probe")."""
    keys = _by_length(side, edits, lambda at, size, i, less, k: _first_key(at, size, i, less), lambda k, less: f"{allowed(f'(n - {less})', edits, per)} = {k}")
    return _with_cuts(lines, side, edits).select("id", F.explode(F.expr(keys)).alias("key"))


def within_edits(x: str, y: str, edits: int) -> Column:
    """Whether two strings are within `edits` edits, by a banded bit-parallel automaton.

    After each character of y, field d of the state has bit p set if some
    number i of x's characters, on diagonal i - j = p - edits, can be reached
    with d edits. The state is kept before its deletions are added.
    """
    band, width = 2 * edits + 1, 3 * edits + 2
    mask = sum(((1 << band) - 1) << (d * width) for d in range(edits + 1))
    ones = sum(1 << (d * width) for d in range(edits + 1))
    start = sum(1 << (edits + d * width) for d in range(edits + 1))
    closed = lambda s: " | ".join([s, *(f"(shiftleft({s}, {m * (width + 1)}) & {mask}L)" for m in range(1, edits + 1))])
    s = f"({closed('s')})"
    same = " + ".join(f"if(get(pair.cx, j + {p - edits - 1}) <=> get(pair.cy, j - 1), {1 << p}L, 0L)" for p in range(band))
    step = f"case when s = 0L then 0L else (({s} & (({same}) * {ones}L)) | ((shiftleft({s}, {width}) | shiftleft({s}, {width - 1})) & {mask}L)) end"
    run = f"aggregate(sequence(1, length({y})), {start}L, (s, j) -> {step})"
    chars = f"transform(array(named_struct('cx', split({x}, ''), 'cy', split({y}, ''))), pair -> {run})[0]"
    final = f"transform(array({chars}), s -> shiftright({closed('s')}, {edits * width} + {edits} + length({x}) - length({y})) & 1L)[0]"
    return F.expr(f"abs(length({x}) - length({y})) <= {edits} and ({x} = {y} or length({y}) = 0 or {final} = 1L)")


def _letter_counts() -> Column:
    return F.expr("transform(split('abcdefghijklmnopqrstuvwxyz', ''), c -> length(line) - length(replace(line, c, '')))")


def _signature() -> Column:
    """The counts of 32 digits and letters modulo 4, as two bits of which one changes with each step: lines within k edits differ in 2 * k bits at most."""
    steps = "get(array(0L, 1L, 3L, 2L), (length(line) - length(replace(line, c, ''))) % 4)"
    return F.expr(f"aggregate(split('0123456789abcdefghilmnoprstuvwyz', ''), 0L, (s, c) -> shiftleft(s, 2) | {steps})")


def _alike(x: str, y: str, edits: int) -> str:
    """Whether letter counts allow `edits` edits: a replacement changes two, an insertion or deletion one."""
    return " + ".join(f"abs({x}[{k}] - {y}[{k}])" for k in range(26)) + f" <= {2 * edits}"


def _only(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct lines whose id is among ids."""
    many = ids.count() > BROADCAST_ROWS
    return lines.join(ids if many else F.broadcast(ids), "id", "left_semi").distinct()


def _left_without(text: str, at: str, size: str, i: int, last: int) -> str:
    """What is left of a text without its segment; \\n, which no line holds, stands for a middle one."""
    if i == 1:
        return f"substring({text}, {size} + 1)"
    return f"left({text}, {at} - 1)" if i == last else f"concat(left({text}, {at} - 1), '\\n', substring({text}, {at} + {size}))"


def _without_one(p: str, j: str) -> str:
    """The texts without any one character (j names a variable)."""
    return f"array_distinct(transform(sequence(1, greatest(1, length({p}))), {j} -> concat(left({p}, {j} - 1), substring({p}, {j} + 1))))"


def _first_rows(lines: DataFrame, side: str, edits: int, per: int) -> DataFrame:
    """id, sig, g (the key) and, of what is left without the segment, l (its length on the indexed side), b (edits) and rem."""

    def one(at: str, size: str, i: int, less: int, k: int) -> str:
        return f"named_struct('g', {_first_key(at, size, i, less)}, 'l', n - {less} - {size} + {int(1 < i <= k)}, 'b', {k}, 'rem', {_left_without('line', at, size, i, k + 1)})"

    rests = _by_length(side, edits, one, lambda k, less: f"{allowed(f'(n - {less})', edits, per)} = {k}")
    return _with_cuts(lines, side, edits).select("id", "sig", F.explode(F.expr(rests)).alias("x")).select("id", "sig", "x.*")


def _halves(rows: DataFrame, side: str) -> DataFrame:
    """rows with h (the middle of the indexed text) and x: kind (0 and 1: the head and the tail without an edit; 2 and 3: with one), key, and of what is left its place, size, length on the indexed side and edits."""
    one = lambda kind, text, at, size, l, b: f"named_struct('kind', {kind}, 'key', xxhash64(g, {kind}, {text}), 'at', {at}, 'size', {size}, 'l', {l}, 'b', {b})"
    each = lambda texts, *rest: f"transform({texts}, v -> {one(rest[0], 'v', *rest[1:])})"
    if side == "index":
        head, tail = "left(rem, h)", "substring(rem, h + 1)"
        exact = [one(0, head, "h + 1", "n - h", "l - h", "b"), one(1, tail, "1", "h", "h", "b")]
        with_one = lambda p: f"concat(array({p}), {_without_one(p, 'j')})"
        edited = [each(with_one(head), 2, "h + 1", "n - h", "l - h", 1), each(with_one(tail), 3, "1", "h", "h", 1)]
    else:
        head, tail = (lambda d: f"left(rem, h + {d})"), (lambda d: f"right(rem, l - h + {d})")
        exact = [one(0, head(0), "h + 1", "n - h", "l - h", "b"), one(1, tail(0), "1", "n - l + h", "h", "b")]
        edited = [f"array({one(2, head(-1), 'h', 'n - h + 1', 'l - h', 1)}, {one(3, tail(-1), '1', 'n - l + h + 1', 'h', 1)})"]
        for d in (0, 1):
            edited.append(each(_without_one(head(d), "j"), 2, f"h + 1 + {d}", f"n - h - {d}", "l - h", 1))
            edited.append(each(_without_one(tail(d), "j"), 3, "1", f"n - l + h - {d}", "h", 1))
    told = rows.withColumns({"n": F.length("rem"), "h": F.expr("cast(l div 2 as int)")})
    return told.withColumn("x", F.explode(F.expr(f"concat(array({', '.join(exact)}), if(b = 2, concat({', '.join(edited)}), array()))"))).select("id", "sig", "g", "rem", "x.*")


def _short_keys(rows: DataFrame) -> DataFrame:
    """id, sig and key: the short rest without any b characters or fewer."""
    one = f"concat(array(rem), {_without_one('rem', 'j')})"
    two = f"array_distinct(flatten(transform({one}, v -> concat(array(v), {_without_one('v', 'k')}))))"
    return rows.select("id", "sig", F.explode(F.expr(f"transform(if(b = 1, {one}, {two}), v -> xxhash64(g, 9, v))")).alias("key")).distinct()


def _small(df: DataFrame) -> DataFrame:
    """A cut frame, to be broadcast if it has few rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _hot_keys(index: DataFrame, hot: int) -> DataFrame:
    """Keys of more than `hot` rows and at least two lines; index may hold a line more than once."""
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("a"), F.max("id").alias("b"))
    return _small(sizes.where((F.col("size") > hot) & (F.col("a") != F.col("b"))).select("key"))


def _met(index: DataFrame, probe: DataFrame, edits: int) -> DataFrame:
    """id and other of what shares a key and whose letter counts allow `edits` edits."""
    theirs = index.select(F.col("id").alias("other"), F.col("sig").alias("theirs"), "key")
    return probe.select("id", "sig", "key").join(theirs, "key").where(f"id != other and bit_count(sig ^ theirs) <= {2 * edits}").select("id", "other")


def _only(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct lines whose id is among ids."""
    return lines.join(_small(ids), "id", "left_semi").distinct()


def _class_keys(edits: int) -> str:
    """Array of a key for each three classes of code points: what a line holds of them, in its order."""
    m = 2 * edits + 3
    others = []
    for c in range(m):
        own = "".join(f"\\\\x{{{n:x}}}" for n in range(128) if n % m == c) + ("\\\\x{80}-\\\\x{10ffff}" if c == 0 else "")
        others.append(f"xxhash64(regexp_replace(line, '[^{own}]+', ''))")
    keys = ", ".join(f"xxhash64({a}, {b}, {c}, h[{a}], h[{b}], h[{c}])" for a, b, c in combinations(range(m), 3))
    return f"transform(array(array({', '.join(others)})), h -> array({keys}))[0]"


def _by_classes(rows: DataFrame, lines: DataFrame, edits: int, many: int) -> tuple[DataFrame, DataFrame]:
    """Candidates by the whole lines' classes; and the rows of indexed lines that have a key of many, with all that may probe them."""
    keyed = lambda side: lines.join(_small(rows.where(F.col("side") == side).select("id").distinct()), "id", "left_semi").select("id", "sig", F.explode(F.expr(_class_keys(edits))).alias("key"))
    index = kept_table(keyed("index"), "line-classes")
    crowded = _small(index.join(_hot_keys(index, many), "key", "left_semi").select("id").distinct())
    found = kept_table(_met(index.join(crowded, "id", "left_anti"), keyed("probe"), edits), "line-candidates")
    still = rows.where("side = 'index'").join(crowded, "id", "left_semi")
    groups = _small(still.select("g").distinct())
    return found, kept_table(still.select(rows.columns).unionByName(rows.where("side = 'probe'").join(groups, "g", "left_semi").select(rows.columns)), "line-rests")


def _by_halves(rows: DataFrame, edits: int, hot: int) -> list[DataFrame]:
    """Candidates (id, other) among rows (side, id, sig, g, l, b, rem) that share g, level by level."""
    found = []
    sides = lambda df: [df.where(F.col("side") == s).drop("side") for s in ("index", "probe")]
    while not rows.isEmpty():
        x, y = sides(rows.where(F.col("l") <= SHORT))
        found.append(kept_table(_met(_short_keys(x), _short_keys(y), edits), "line-candidates"))
        x, y = sides(rows.where(F.col("l") > SHORT))
        keys, probes = _halves(x, "index"), _halves(y, "probe")
        common = _hot_keys(keys, hot)
        told = keys.drop("rem").join(common.withColumn("hot", F.lit(True)), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        flags = told.where("hot and kind > 1").groupBy("g", "id").agg(F.max(F.col("kind") == 2).alias("head"), F.max(F.col("kind") == 3).alias("tail"))
        # of the halves with one edit each, the one without common keys serves; else the head
        kept = told.join(flags, ["g", "id"], "left").where("kind < 2 or (kind = 2 and not (coalesce(head, false) and not coalesce(tail, false))) or (kind = 3 and coalesce(head, false) and not coalesce(tail, false))")
        kept = kept_table(kept.drop("head", "tail"), "line-halves")
        found.append(kept_table(_met(kept.where("not hot"), probes, edits), "line-candidates"))
        on = _small(kept.where("hot").select("key").distinct())
        rest = F.expr("substring(rem, at, size)").alias("rem")
        ours = kept.where("hot").join(x.select("id", "g", "rem"), ["id", "g"])
        children = [df.select(F.lit(s).alias("side"), "id", "sig", F.col("key").alias("g"), "l", "b", rest) for s, df in (("index", ours), ("probe", probes.join(on, "key", "left_semi")))]
        rows = kept_table(children[0].unionByName(children[1]).distinct(), "line-rests")
    return found


def candidate_pairs(docs: DataFrame, edits: int = EDITS, per: int = PER, hot: int = HOT, many: int = MANY) -> DataFrame:
    """a and b: ids of lines that may be near, each pair once."""
    if per < 2 or not 1 <= edits <= 2:
        raise ValueError("edits must be 1 or 2, per 2 or more")
    texts = docs.select(F.explode(split_lines("text")).alias("line")).where(F.length("line") >= per)
    told = lambda df: df.select("line", F.xxhash64("line").alias("id"), F.length("line").alias("n"))
    # sizes are counted before the texts are shuffled: a line that stands more than `hot` times has common keys too
    common = _hot_keys(_key_rows(told(texts), "index", edits, per), hot)
    lines = told(texts.distinct())
    index = _key_rows(lines, "index", edits, per)
    # a hot key is met once, so that probes are read and sorted once for both kinds of key
    targets = index.join(common, "key", "left_anti").select("key", F.col("id").alias("other")).unionByName(common.select("key", F.lit(None).cast("bigint").alias("other")))
    met = kept_table(_key_rows(lines, "probe", edits, per).join(targets, "key").where("other is null or id != other").select("id", "other"), "line-candidates")
    found = [met.where("other is not null")]
    asking = _only(texts.select("line", F.xxhash64("line").alias("id")), met.where("other is null").select("id").distinct())
    asking = cut(asking.withColumns({"n": F.length("line"), "sig": _signature()}))
    sides = [_first_rows(asking, s, edits, per).join(common.withColumnRenamed("key", "g"), "g", "left_semi").select(F.lit(s).alias("side"), "id", "sig", "g", "l", "b", "rem") for s in ("index", "probe")]
    by_classes, rows = _by_classes(sides[0].unionByName(sides[1]), asking, edits, many)
    found += [by_classes, *_by_halves(rows, edits, hot)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return cut(out.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())


def near_pairs(docs: DataFrame, edits: int = EDITS, per: int = PER, hot: int = HOT, many: int = MANY) -> DataFrame:
    """All pairs of different near lines: x and y, each pair once in some order."""
    pairs = candidate_pairs(docs, edits, per, hot, many)
    named = docs.select(F.explode(split_lines("text")).alias("line")).where(F.length("line") >= per).select("line", F.xxhash64("line").alias("id"))
    chosen = cut(_only(named, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()).withColumn("counts", _letter_counts()))
    x = chosen.select(F.col("id").alias("a"), F.col("line").alias("x"), F.col("counts").alias("x_counts"))
    y = chosen.select(F.col("id").alias("b"), F.col("line").alias("y"), F.col("counts").alias("y_counts"))
    # two steps, so that the letter counts are compared before any line is split
    alike = pairs.join(x, "a").join(y, "b").where(_alike("x_counts", "y_counts", edits))
    least = allowed("least(length(x), length(y))", edits, per)
    near = F.lit(False)
    for k in range(1, edits + 1):
        near = F.when(F.expr(f"{least} = {k}"), within_edits("x", "y", k)).otherwise(near)
    return alike.where(near).select("x", "y")


def _line_key(c: str) -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit("line"), c).alias("h2")]


def _ranks(rows: DataFrame) -> DataFrame | None:
    """doc_id, t1, t2 and nth (0, 1, ... by text hash) of the different texts of each id that has several; None without such ids."""
    texts = rows.groupBy("doc_id", "t1", "t2").count().drop("count")
    several = cut(texts.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__id")))
    if several.isEmpty():
        return None
    # places within parts of the hash, and the texts of the parts before: an id of many rows is not one task
    parted = cut(texts.join(several, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").withColumn("part", F.shiftright("t1", 52)))
    before = F.sum("count").over(Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parted.groupBy("doc_id", "part").count().select(F.col("doc_id").alias("__id"), F.col("part").alias("__part"), F.coalesce(before, F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("t1", "t2"))
    joined = parted.withColumn("own", own).join(starts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("part") == F.col("__part")))
    return cut(joined.select("doc_id", "t1", "t2", (F.col("start") + F.col("own") - 1).cast("bigint").alias("nth")))


def _ranked(rows: DataFrame, ranks: DataFrame | None) -> DataFrame:
    """rows (doc_id, t1, t2, ...) with nth: 0 for an id of one text."""
    if ranks is None:
        return rows.withColumn("nth", F.lit(0).cast("bigint"))
    # the text is part of the key, so that no id is one task
    theirs = ranks.select(F.col("doc_id").alias("__id"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), "nth")
    met = rows.join(theirs, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("t1") == F.col("__t1")) & (F.col("t2") == F.col("__t2")), "left")
    return met.withColumn("nth", F.coalesce("nth", F.lit(0).cast("bigint"))).drop("__id", "__t1", "__t2")


def row_decisions(docs: DataFrame, edits: int = EDITS, per: int = PER, by_row: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Per line doc_id, nth (the row's place among the texts of its id), pos, exact (the line stands earlier), near (a near line stands earlier than its first), links (near lines); and the ranks. Without by_row, rows of one id share their places."""
    ranks = _ranks(docs.where("text is not null").select("doc_id", *text_key())) if by_row else None
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "nth", "pos")
    told = _ranked(docs.select("doc_id", "text", *text_key()), ranks)
    lines = told.select("doc_id", "nth", F.posexplode_outer(split_lines("text")).alias("pos", "line"))
    seen = kept_table(lines.select("doc_id", "nth", "pos", *_line_key("line")), "line-places").withColumn("place", place)
    firsts = seen.where("pos is not null").groupBy("h1", "h2").agg(F.min("place").alias("first"))
    pairs = cut(near_pairs(docs, edits, per).select(F.struct(*_line_key("x")).alias("a"), F.struct(*_line_key("y")).alias("b")))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).select("a.h1", "a.h2", "b")
    other = firsts.select(F.struct("h1", "h2").alias("b"), F.col("first").alias("theirs"))
    near = both.join(other, "b").groupBy("h1", "h2").agg(F.min("theirs").alias("theirs"), F.count(F.lit(1)).alias("links"))
    known = firsts.join(near, ["h1", "h2"], "left")
    found = seen.join(known, ["h1", "h2"], "left").select(
        "doc_id",
        "nth",
        "pos",
        (F.col("pos").isNotNull() & (F.col("place") > F.col("first"))).alias("exact"),
        F.coalesce(F.col("theirs") < F.col("first"), F.lit(False)).alias("near"),
        F.coalesce("links", F.lit(0)).alias("links"),
    )
    return found, ranks


def line_decisions(docs: DataFrame, edits: int = EDITS, per: int = PER) -> DataFrame:
    """doc_id, pos, exact, near and links as op1's SQL has them: by doc_id and position alone."""
    return row_decisions(docs, edits, per, by_row=False)[0].drop("nth")


def _without_repeats(rows: DataFrame) -> DataFrame:
    """Rows (row, doc_id, text) without all but one (by the hash of its columns) of those that repeat a doc_id and its text."""
    keyed = rows.where("text is not null").select("doc_id", *text_key())
    repeated = cut(keyed.groupBy("doc_id", "t1", "t2").count().where("count > 1").select(F.col("doc_id").alias("__id"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2")))
    if repeated.isEmpty():
        return rows
    t1, t2 = text_key()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (t1 == F.col("__t1")) & (t2 == F.col("__t2")) & F.col("text").isNotNull()
    json = F.to_json("row")
    one = rows.join(repeated, same, "left_semi").groupBy("doc_id", *text_key()).agg(F.min_by(F.struct("row", "text"), F.struct(F.xxhash64(json), json)).alias("x"))
    return rows.join(repeated, same, "left_anti").unionByName(one.select("x.row", "doc_id", "x.text"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, per: int = PER) -> DataFrame:
    """The rows without the lines that go, n_chars (if there is one) counted anew; rows of which no line is left go."""
    rows = _without_repeats(packed(docs, doc_id=F.col("doc_id"), text=F.col("text")))
    found, ranks = row_decisions(rows, edits, per)
    gone = found.where("exact or near").groupBy("doc_id", "nth").agg(F.collect_set("pos").alias("gone"))
    gone = gone.withColumnsRenamed({"doc_id": "__id", "nth": "__nth"})
    of_text = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("text").isNotNull()
    if ranks is None:
        joined = rows.join(gone, of_text, "left")
    else:
        # from the place back to the text, which no two rows of an id share
        theirs = ranks.select(F.col("doc_id").alias("__doc"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), F.col("nth").alias("__n"))
        keyed = gone.join(theirs, F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__nth") == F.col("__n")), "left").select("__id", "__t1", "__t2", "gone")
        t1, t2 = text_key()
        single = rows.join(keyed.where("__t1 is null").select("__id", F.col("gone").alias("single")), of_text, "left").drop("__id")
        several = keyed.where("__t1 is not null").withColumnRenamed("gone", "several")
        joined = single.join(several, of_text & (t1 == F.col("__t1")) & (t2 == F.col("__t2")), "left").withColumn("gone", F.coalesce("single", "several"))
    lines = split_lines("text")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    changed = F.col("gone").isNotNull() & F.col("text").isNotNull()
    out = joined.where(~changed | (F.size(kept) > 0)).select("row", F.when(changed, F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")).alias("new"))
    new = F.col("new").isNotNull()
    row = F.col("row").withField("text", F.when(new, F.col("new").cast(docs.schema["text"].dataType)).otherwise(F.col("row.text")))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(new, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return out.select(row.alias("row")).select("row.*")


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, those that go as repeated or near, those that stay, and the links of its lines."""
    found = line_decisions(table(spark, sf_dir, "documents"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return found.groupBy("doc_id").agg(
        F.count("pos").alias("n_lines"),
        count(F.col("exact")).alias("n_exact"),
        count(~F.col("exact") & F.col("near")).alias("n_near"),
        count(F.col("pos").isNotNull() & ~F.col("exact") & ~F.col("near")).alias("n_kept"),
        F.sum("links").cast("bigint").alias("n_links"),
    )


#: Non-ASCII letters of the tables, each mapped to an own control character: DuckDB's levenshtein counts bytes.
_LETTERS = "äöüßñáéíóúèêçàâîôûëïœùÄÖÜÑÁÉÍÓÚÈÊÇÀÂÎÔÛËÏŒÙẞ"
_CODES = " || ".join(f"chr({n})" for n in [*range(1, 9), *range(14, 32), 127, *range(34, 36), *range(60, 63), *range(91, 97), 123, 124, 125, 126][: len(_LETTERS)])

#: Letters whose counts are compared first, to spare DuckDB most distances: no pair within EDITS differs by more than 2 * EDITS in all.
_COUNTED = "aenirtso"
_COUNTS = ", ".join(f"length(line) - length(replace(line, '{c}', '')) AS k_{c}" for c in _COUNTED)
_NEAR_COUNTS = " + ".join(f"abs(a.k_{c} - b.k_{c})" for c in _COUNTED) + f" <= {2 * EDITS}"

OP1_SQL = f"""
WITH o AS (SELECT doc_id, i - 1 AS pos, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
f AS (SELECT line, min((doc_id::HUGEINT) * 2147483648 + pos) AS first FROM o GROUP BY line),
c AS (SELECT line, first, length(line) AS n, translate(line, '{_LETTERS}', {_CODES}) AS t, {_COUNTS} FROM f WHERE length(line) >= {PER}),
p AS (SELECT a.line, b.first AS theirs FROM c a JOIN c b ON b.n BETWEEN a.n - {EDITS} AND a.n + {EDITS} AND a.line <> b.line AND CASE WHEN {_NEAR_COUNTS} THEN levenshtein(a.t, b.t) <= least({EDITS}, least(a.n, b.n) // {PER}) ELSE false END),
n AS (SELECT line, min(theirs) AS theirs, count(*) AS links FROM p GROUP BY line),
j AS (SELECT o.doc_id, (o.doc_id::HUGEINT) * 2147483648 + o.pos > f.first AS exact, coalesce(n.theirs < f.first, false) AS near, coalesce(n.links, 0) AS links
  FROM o JOIN f USING (line) LEFT JOIN n USING (line)),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (exact) AS n_exact, count(*) FILTER (NOT exact AND near) AS n_near,
  count(*) FILTER (NOT exact AND NOT near) AS n_kept, CAST(sum(links) AS BIGINT) AS n_links FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near, coalesce(n_kept, 0) AS n_kept, coalesce(n_links, 0) AS n_links
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN g USING (doc_id)
"""
