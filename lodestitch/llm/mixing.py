"""Operator 7, mixing sources to target weights: iterative proportional fitting, in DataFrame functions only.

Tokens are counted per cell of (source, lang, topic). Each margin's targets are
shares of what is kept (`keep` of all tokens): by default its token counts to the
power `alpha` (tempered), and never more than the margin has. Raking multiplies
the cells' weights by target / current tokens, for source, then language, then
topic; a cell counts with its tokens at most, so that the bound of a probability,
1, is part of the fit. Sweeps go on until no margin is off its target by more than
`tolerance` of what is kept, or `most` sweeps are done (margins can contradict
each other); what is then left is returned as residual. Documents are sampled
with their cell's probability, weight / tokens.

Topics come from a column that the caller names, or else from the shape of a
text: the shares of capitals, signs, digits and line breaks in it.

Skew: only cells are raked, a table of partial sums that is never collected. A
margin's tokens are summed by a grouping, so that the cells of a common topic are
pre-aggregated where they lie, and the sums are joined back to the cells. Sums,
like fitted cells to the documents, are broadcast where they have at most
BROADCAST_ROWS rows, else joined by a shuffle, which adaptive execution splits.
Grand totals and residuals come to the driver as one number each.

Rows: a null source, lang or topic counts as an empty one; a null text has no
tokens and its cell's probability; cells without tokens get probability 1. Each
row has a draw of its own: it hashes doc_id (a null one as an empty one) and text,
and, for rows of which there are others of the same id and text, the row's place
in the scan, too. Any other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import kept_table, packed, table

ALPHA = 0.5
KEEP = 0.6
TOLERANCE = 0.002
CHECK = 5
MOST = 20
#: Rounds in which targets beyond what a margin has are dealt to the others.
ROUNDS = 6
#: A cell's weight goes this far beyond its tokens at most.
BEYOND = 1000.0
BROADCAST_ROWS = 100_000
MARGINS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"

#: Topics by shape, the first that fits: the characters counted, the topic, and how many characters of a text there may be for each.
SHAPES = (("[A-Z]", "capitals", 2), (r"[!-/:-@\[-`{-~]", "symbols", 10), ("[0-9]", "figures", 10), (r"\n", "listing", 40))


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for pattern, topic, each in reversed(SHAPES):
        out = F.when(F.regexp_count(text, F.lit(pattern)) * each > F.length(text), topic).otherwise(out)
    return F.coalesce(out, F.lit("prose"))


def described(docs: DataFrame, topic: str | None = None) -> DataFrame:
    """row, doc_id, source, lang, topic, n_tokens, digest (of id and text) and place of every row."""
    text = F.sha2(F.coalesce("text", F.lit("")), 256)
    return packed(
        docs,
        doc_id=F.col("doc_id"),
        digest=F.sha2(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text), 256),
        place=F.monotonically_increasing_id(),
        source=F.coalesce("source", F.lit("")),
        lang=F.coalesce("lang", F.lit("")),
        topic=topic_of(F.col("text")) if topic is None else F.coalesce(F.col(topic).cast("string"), F.lit("")),
        n_tokens=F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint"),
    )


def _number(df: DataFrame, value: Column) -> float:
    """One number of a whole frame."""
    return df.agg(F.coalesce(value, F.lit(0.0)).cast("double").alias("x")).first().x


def _targets(cells: DataFrame, alpha: float, kept: float) -> tuple[dict[str, DataFrame], dict[str, bool]]:
    """By margin: its values with target_<margin>, tokens that each should give and no more than it has; and whether they are few enough to be broadcast."""
    of = lambda m: cells.groupBy(F.col(m).alias("value")).agg(F.sum("tokens").alias("has")).withColumn("margin", F.lit(m))
    own = kept_table(of(MARGINS[0]).unionByName(of(MARGINS[1])).unionByName(of(MARGINS[2])), "margins")
    target = F.pow("has", F.lit(alpha))
    for _ in range(ROUNDS):
        totals = {r.margin: r.total for r in own.groupBy("margin").agg(F.sum(target).alias("total")).collect()}
        share = F.element_at(F.create_map(*(F.lit(x) for m in MARGINS for x in (m, kept / totals[m] if totals.get(m) else 0.0))), F.col("margin"))
        target = F.least("has", target * share)
    counts = {r.margin: r.n for r in own.groupBy("margin").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = {m: counts.get(m, 0) <= BROADCAST_ROWS for m in MARGINS}
    return {m: own.where(F.col("margin") == m).select(F.col("value").alias(m), target.alias(f"target_{m}")) for m in MARGINS}, few


def rake(cells: DataFrame, alpha: float = ALPHA, keep: float = KEEP, tolerance: float = TOLERANCE, most: int = MOST) -> DataFrame:
    """cells (source, lang, topic, tokens) with probability and residual: expected tokens meet the targets of all three margins to the residual."""
    cells = kept_table(cells.withColumn("tokens", F.col("tokens").cast("double")), "cells")
    kept = _number(cells, F.sum("tokens")) * keep
    out = cells.withColumn("weight", F.col("tokens") * keep)
    targets, few = _targets(cells, alpha, kept)
    for m in MARGINS:
        out = out.join(F.broadcast(targets[m]) if few[m] else targets[m], m)
    out, residual = kept_table(out, "cells"), 0.0
    for sweep in range(1, most + 1):
        for m in MARGINS:
            sums = out.groupBy(m).agg(F.sum(F.least("tokens", "weight")).alias("now"))
            out = out.join(F.broadcast(sums) if few[m] else sums, m)
            out = out.withColumn("weight", F.when(F.col("now") > 0, F.least(F.col("weight") * F.col(f"target_{m}") / F.col("now"), F.col("tokens") * BEYOND)).otherwise(F.col("weight"))).drop("now")
        out = kept_table(out, "sweep")  # after each sweep: plans of many sweeps fill the driver
        if sweep % CHECK == 0 or sweep == most:
            offs = [out.groupBy(m).agg(F.abs(F.sum(F.least("tokens", "weight")) - F.first(f"target_{m}")).alias("off")).select("off") for m in MARGINS]
            residual = _number(offs[0].unionByName(offs[1]).unionByName(offs[2]), F.max("off")) / kept if kept else 0.0
            if residual <= tolerance:
                break
    probability = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") / F.col("tokens"))).otherwise(1.0)
    return out.select(*MARGINS, F.col("tokens").cast("bigint").alias("tokens"), probability.alias("probability"), F.lit(residual).alias("residual"))


def draw(digest: Column) -> Column:
    """A number in [0, 1): 52 bits of a sha256."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mixture(docs: DataFrame, alpha: float = ALPHA, keep: float = KEEP, topic: str | None = None, tolerance: float = TOLERANCE, most: int = MOST, rows: bool = True) -> DataFrame:
    """row (the input row; without `rows` it is left out), doc_id, source, lang, topic, n_tokens, probability, residual and sampled of every row."""
    told = described(docs, topic)
    narrow = kept_table(told.drop("row"), "described")
    cells = narrow.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    fitted = rake(cells, alpha, keep, tolerance, most).drop("tokens")
    repeated = kept_table(narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", F.lit(True).alias("repeated")), "repeated")
    checked = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    joined = (told if rows else narrow).join(checked(fitted), list(MARGINS)).join(checked(repeated), "digest", "left")
    own = F.when(F.col("repeated"), F.sha2(F.concat("digest", F.lit(":"), F.col("place").cast("string")), 256)).otherwise(F.col("digest"))
    return joined.withColumn("sampled", draw(own) < F.col("probability")).drop("digest", "place", "repeated")


def sample_documents(docs: DataFrame, alpha: float = ALPHA, keep: float = KEEP, topic: str | None = None, probability: str | None = None) -> DataFrame:
    """The sampled rows; with a column of that name for their probability (which takes the place of one of the input)."""
    out = mixture(docs, alpha, keep, topic).where("sampled")
    if probability is None:
        return out.select("row.*")
    return out.select(*(F.col(f"row.`{c}`") for c in docs.columns if c != probability), F.round("probability", 6).alias(probability))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixture(table(spark, sf_dir, "documents"), rows=False)
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "sampled", F.round("residual", 4).alias("residual"))


def _sql() -> str:
    topic = "CASE " + " ".join(f"WHEN len(regexp_extract_all(text, '{pattern}')) * {each} > length(text) THEN '{t}'" for pattern, t, each in SHAPES) + " ELSE 'prose' END"
    out = [
        f"d AS (SELECT doc_id, sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || sha256(coalesce(text, ''))) AS digest, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS n_tokens FROM documents)",
        f"c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST(sum(n_tokens) AS DOUBLE) * {KEEP} AS weight, sum(CAST(sum(n_tokens) AS DOUBLE)) OVER () * {KEEP} AS kept FROM d GROUP BY source, lang, topic)",
    ]
    for m in MARGINS:
        out.append(f"t_{m}_0 AS (SELECT {m}, sum(tokens) AS has, any_value(kept) AS kept, pow(sum(tokens), {ALPHA}) AS t FROM c GROUP BY {m})")
        for k in range(ROUNDS):
            out.append(f"t_{m}_{k + 1} AS MATERIALIZED (SELECT {m}, has, kept, CASE WHEN sum(t) OVER () > 0 THEN least(has, t * kept / sum(t) OVER ()) ELSE 0 END AS t FROM t_{m}_{k})")
    joins = " ".join(f"JOIN (SELECT {m}, t AS target_{m} FROM t_{m}_{ROUNDS}) USING ({m})" for m in MARGINS)
    out.append(f"r0 AS MATERIALIZED (SELECT c.*, {', '.join(f'target_{m}' for m in MARGINS)}, CAST('inf' AS DOUBLE) AS residual FROM c {joins})")
    n = 0
    for sweep in range(1, MOST + 1):
        for m in MARGINS:
            now = f"sum(least(tokens, weight)) OVER (PARTITION BY {m})"
            out.append(f"r{n + 1} AS MATERIALIZED (SELECT * EXCLUDE (weight), CASE WHEN residual > {TOLERANCE} AND {now} > 0 THEN least(weight * target_{m} / {now}, tokens * {BEYOND}) ELSE weight END AS weight FROM r{n})")
            n += 1
        if sweep % CHECK == 0 or sweep == MOST:
            off = ", ".join(f"abs(sum(least(tokens, weight)) OVER (PARTITION BY {m}) - target_{m})" for m in MARGINS)
            out.append(f"o{n} AS MATERIALIZED (SELECT *, CASE WHEN kept > 0 THEN greatest({off}) / kept ELSE 0 END AS off FROM r{n})")
            out.append(f"r{n + 1} AS MATERIALIZED (SELECT * EXCLUDE (off, residual), max(off) OVER () AS residual FROM o{n})")
            n += 1
    p = "CASE WHEN tokens > 0 THEN least(1.0::DOUBLE, weight / tokens) ELSE 1.0 END"
    return (
        "WITH " + ",\n".join(out) + f"\nSELECT doc_id, d.source, d.lang, d.topic, n_tokens, round({p}, 6) AS probability,\n"
        f"  CAST(('0x' || substr(digest, 1, 13)) AS BIGINT) / {float(1 << 52)} < {p} AS sampled, round(residual, 4) AS residual\n"
        f"FROM d JOIN r{n} USING (source, lang, topic)"
    )


OP7_SQL = _sql()
