"""Operator 12, fill-in-middle transformation by repeated-capture matching.

Method. One full match of (unit)*+ over a text keeps every repetition of its
group: the number of ends(1) is n, and the k-th of them is where k units end, so
both cut offsets are looked up and nothing is counted or scanned again. Units are
code points, words or lines (UNITS), or any pattern that tiles a text from left to
right. A match holds some 100 bytes a unit, so a text of more than WINDOW code
points is matched window by window: the last unit of a window, which the window's
end may have cut, starts the next one. Results are the same (a test).

The cut offsets are all that Python gives; hashes, pieces, outputs and the way
back are column expressions, and a text is read by no other row: no shuffle.

Rows: a null text counts as an empty one, which is plain, as are texts that hold
one of the three marks, and texts that the pattern does not tile (n is null). A
null doc_id is hashed as an empty one; equal ids and texts give equal rows, and
every row gets one. Any other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import packed, small_batches, table

UNITS = {"char": r"(?s:.)", "word": r"\S+\s*|\s+", "line": r"[^\n]*\n|[^\n]+"}
WINDOW = 1 << 20
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
SEED = 1
#: Of 100 texts, so many are transformed, and of 100 of these so many have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
_HEX = 8


def unit_ends(pattern: regex.Pattern, text: str, window: int = WINDOW) -> Iterator[list[int] | None]:
    """Ends of the units of a text, in order, in one list for each window; None where the pattern does not tile it."""
    if len(text) <= window:
        whole = pattern.fullmatch(text)
        yield None if whole is None else whole.ends(1)
        return
    at, size = 0, window
    while at < len(text):
        last = at + size >= len(text)
        ends = pattern.match(text, at, at + size).ends(1)
        if last:
            yield ends if ends and ends[-1] == len(text) else None
            return
        if len(ends) > 1:
            yield ends[:-1]
            at, size = ends[-2], window
        else:
            size *= 2  # one unit, or none, in a whole window: it may be a long one


def cuts(pattern: regex.Pattern, text: str, h1: int, h2: int, window: int = WINDOW) -> tuple[int | None, int | None, int | None]:
    """n, and where the prefix and the middle end: after the smaller and the larger of h1 % (n + 1) and h2 % (n + 1) units."""
    ends: list[list[int]] = []
    for part in unit_ends(pattern, text, window):
        if part is None:
            return None, None, None
        ends.append(part)
    n = sum(map(len, ends))

    def offset(k: int) -> int:
        for part in ends:
            if k <= len(part):
                return part[k - 1] if k else 0
            k -= len(part)
        return 0

    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, offset(first), offset(second)


def _number(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 1 + _HEX * k, _HEX), 16, 10).cast("bigint")


def transformed(docs: DataFrame, unit: str = "char", seed: int = SEED, share: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """row (the input row), n, form, prefix_chars, middle_chars and output of every row."""
    small_batches(docs.sparkSession)
    pattern = rf"({UNITS.get(unit, unit)})*+"

    @F.pandas_udf("n bigint, first bigint, second bigint")
    def cut_places(text: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        compiled = regex.compile(pattern)
        return pd.DataFrame([cuts(compiled, *x) for x in zip(text, h1, h2)], columns=["n", "first", "second"], dtype="Int64")

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    told = packed(docs, text=F.coalesce("text", F.lit("")), digest=digest)
    told = told.select("row", "text", *(_number(F.col("digest"), k).alias(f"h{k + 1}") for k in range(4)))
    told = told.withColumn("cut", cut_places("text", "h1", "h2"))
    n, first, second = (F.col(f"cut.{x}") for x in ("n", "first", "second"))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | marked | n.isNull() | (F.col("h3") % 100 >= share), "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    told = told.withColumns({"n": n, "form": form, "prefix_chars": F.when(form != "plain", first), "middle_chars": F.when(form != "plain", second - first)})
    return told.select("row", "n", "form", "prefix_chars", "middle_chars", arranged("text", "form", "prefix_chars", "middle_chars").alias("output"))


def arranged(text: str, form: str, prefix_chars: str, middle_chars: str) -> Column:
    """The output of a form: prefix, suffix, middle (psm) or suffix, prefix, middle (spm), each after its mark; a plain text as it is."""
    whole, first, more = F.col(text), F.col(prefix_chars).cast("int"), F.col(middle_chars).cast("int")
    one = F.lit(1)
    prefix = F.concat(F.lit(PREFIX), F.substr(whole, one, first))
    middle = F.concat(F.lit(MIDDLE), F.substr(whole, first + 1, more))
    suffix = F.concat(F.lit(SUFFIX), F.substr(whole, first + more + 1))
    return F.when(F.col(form) == "psm", F.concat(prefix, suffix, middle)).when(F.col(form) == "spm", F.concat(suffix, prefix, middle)).otherwise(whole)


def restored(output: str | Column, form: str | Column) -> Column:
    """The text again, from output and form alone: no mark stands in a transformed text, and none can arise at a seam, as a mark starts with < and ends with >."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    after = lambda mark: F.split_part(output, F.lit(mark), F.lit(2))
    until = lambda part, mark: F.split_part(part, F.lit(mark), F.lit(1))
    psm = F.concat(until(after(PREFIX), SUFFIX), after(MIDDLE), until(after(SUFFIX), MIDDLE))
    spm = F.concat(until(after(PREFIX), MIDDLE), after(MIDDLE), until(after(SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, unit: str = "char", seed: int = SEED) -> DataFrame:
    """The rows with `text` transformed and its `fim_form` (which takes the place of one of the input)."""
    out = transformed(docs, unit, seed)
    kept = (F.col("output").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c != "fim_form")
    return out.select(*kept, F.col("form").alias("fim_form"))


def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))


OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
h AS (SELECT doc_id, text, length(text) AS n, {", ".join(f"CAST('0x' || substr(digest, {1 + _HEX * k}, {_HEX}) AS BIGINT) AS h{k + 1}" for k in range(4))} FROM d),
c AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR {" OR ".join(f"contains(text, '{m}')" for m in MARKS)} OR h3 % 100 >= {TRANSFORMED} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (SELECT *, '{PREFIX}' || substring(text, 1, a) AS prefix, '{MIDDLE}' || substring(text, a + 1, b - a) AS middle, '{SUFFIX}' || substring(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN prefix || suffix || middle WHEN 'spm' THEN suffix || prefix || middle ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
