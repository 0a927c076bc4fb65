"""Operator 10, language identification with language-bitmask n-gram filters.

One array of bitmasks for each 64 languages is a bit-sliced Bloom filter: bit l
of a slot belongs to language l. Looking an n-gram up (HASHES slots, joined by AND) returns all
languages that may contain it at once. A text's score of a language is the
popcount of its bit over the text's n-grams less the false positives expected
from that language's own fill, and the greatest decides (ties: the first
language in sorted order).

N-grams are of 2 to 4 bytes of the lower-cased (A-Z) UTF-8 text. A language's
filter holds those of its `profile` most frequent n-grams that are more
frequent in it than in the mean of the languages. It is fitted on at most `sample` rows of each
language, those with the least hash of doc_id (documented bound); every row is
judged by its whole text.

Rows: a text that is null or has no letter is `und` with score 0; rows of a
null lang or a null doc_id are not learned from. Without any learnable row all
texts are `und`. Any other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrowtext as at
from .tables import crc_mod, cut, kept_table, small_batches, table

SAMPLE = 600
PROFILE = 3_000
SLOT_BITS = 20
HASHES = 2
LENGTHS = (2, 3, 4)
PIECE_BYTES = 1 << 20
UNKNOWN = "und"


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length the 64-bit codes of the n-grams and where they start; none crosses a text's end."""
    data = at.LOWER[data].astype(np.uint64)
    for n in LENGTHS:
        if data.size < n:
            continue
        code = np.full(data.size - n + 1, n, np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | data[k : data.size - n + 1 + k]
        whole = np.ones(code.size, bool)
        for k in range(1, n):
            edge = offsets[1:-1] - k
            whole[edge[(edge >= 0) & (edge < code.size)]] = False
        at_ = np.flatnonzero(whole)
        yield code[at_], at_


def _slots(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    x = at.mixed(codes * np.uint64(0x9E3779B97F4A7C15))
    return [((x >> np.uint64(5 + 29 * k)) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in range(HASHES)]


class LanguageFilter:
    def __init__(self, profiles: dict[str, np.ndarray], bits: int = SLOT_BITS):
        self.languages, self.bits = sorted(profiles), bits
        kind = np.uint64 if len(profiles) > 8 else np.uint8
        self.words = [np.zeros(1 << bits, kind) for _ in range(max(1, -(-len(profiles) // 64)))]
        for n, name in enumerate(self.languages):
            for slot in _slots(profiles[name], bits):
                self.words[n // 64][slot] |= kind(1 << n % 64)
        fill = [(self.words[n // 64] >> kind(n % 64) & kind(1)).mean() for n in range(len(profiles))]
        self.false = np.array(fill) ** HASHES

    def containing(self, codes: np.ndarray, word: int = 0) -> np.ndarray:
        """The bitmask of all languages, from number 64 * word on, that may contain each n-gram."""
        first, *more = _slots(codes, self.bits)
        mask = self.words[word][first]
        for slot in more:
            mask = mask & self.words[word][slot]
        return mask

    def shares(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts by languages: share of the n-grams in each, corrected for false positives."""
        n = len(offsets) - 1
        total, hits = np.zeros(n), np.zeros((n, len(self.languages)))
        for codes, at_ in grams(data, offsets):
            edges = np.searchsorted(at_, offsets)
            total += np.diff(edges)
            for n_th in range(len(self.languages)):
                b = n_th % 64
                mask = self.containing(codes, n_th // 64) if b == 0 else mask
                count = np.concatenate([[0], np.cumsum((mask >> mask.dtype.type(b)) & mask.dtype.type(1), dtype=np.int64)])
                hits[:, n_th] += count[edges[1:]] - count[edges[:-1]]
        return np.clip((hits - total[:, None] * self.false) / (np.maximum(total, 1)[:, None] * (1 - self.false)), 0, 1)


def train(docs: DataFrame, sample: int = SAMPLE, profile: int = PROFILE) -> LanguageFilter:
    """Learns from rows with a lang whose crc32(doc_id) modulo 4 is not 2: of each language those of at most `sample` ids, by the least hash.

    N-grams are counted by language in Spark. A language's profile is those of
    its n-grams that are more frequent in it than on the mean of all
    languages, the `profile` most frequent; only profiles come to the driver.
    """
    small_batches(docs.sparkSession)
    ids = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & (crc_mod("doc_id", 4) != 2))
    nth = F.row_number().over(Window.partitionBy("lang", "part").orderBy("h", "doc_id"))
    # the least hashes of each part first, so that a frequent language is not one task
    near = ids.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("part", F.pmod("h", F.lit(64))).withColumn("n", nth).where(F.col("n") <= sample)
    least = cut(near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("n") <= sample).select("doc_id", "lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for name in rows.column(0).unique().to_pylist():
                data, offsets = at.text_bytes(rows.column(1).filter(pa.compute.equal(rows.column(0), name)))
                codes, counts = np.unique(np.concatenate([c for c, _ in grams(data, offsets)] or [np.zeros(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * codes.size, pa.string()), pa.array(codes.view(np.int64)), pa.array(counts, pa.int64())], names=["lang", "code", "n"])

    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(least), ["doc_id", "lang"], "left_semi").select("lang", "text")
    counted = kept_table(texts.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")), "language-counts")
    names = sorted(r.lang for r in least.select("lang").distinct().collect())
    rates = counted.join(F.broadcast(counted.groupBy("lang").agg(F.sum("n").alias("total"))), "lang").withColumn("rate", F.col("n") / F.col("total"))
    typical = rates.join(rates.groupBy("code").agg((F.sum("rate") / max(1, len(names))).alias("mean")), "code").where((F.col("rate") > F.col("mean")) | F.lit(len(names) == 1))
    first = typical.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("rate"), "code"))).where(F.col("nth") <= profile)
    found = first.select("lang", "code").toArrow()
    of, codes = np.array(found.column("lang").to_pylist(), dtype=object), found.column("code").to_numpy().view(np.uint64)
    return LanguageFilter({name: codes[of == name] for name in names})


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """doc_id, lang_pred and score (the decided language's share of all shares) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*sent.value.languages, UNKNOWN], dtype=object)
        for rows, data, offsets in at.pieces(batches, "text", PIECE_BYTES):
            letters = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if len(names) == 1:
                best, sure = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows)
            else:
                shares = sent.value.shares(data, offsets)
                best = np.where(letters, shares.argmax(1), len(names) - 1)
                sure = np.where(letters, shares.max(1) / np.maximum(shares.sum(1), 1e-12), 0.0)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "lang_pred", "score"])

    narrow = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
