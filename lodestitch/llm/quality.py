"""Operator 6, a quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates.

Tokens are runs of word bytes and runs of other non-blank bytes, as they are
written; features are their unigrams, bigrams and "the same token again"
n-grams in 2**BITS buckets, each counted and divided by the square root of the number of features. A score is
the sparse dot product of a whole text's features with the weights.

The model is fitted on at most `sample` labelled rows, those with the least
hash of doc_id (documented bound; default SAMPLE); every row is scored.

Rows: a null or empty text has no feature and gets the score of the bias.
Labels that are null or of a null doc_id are not learned from. A doc_id that is
labelled twice is learned with both labels. Without any labelled row all scores
are 0.5. Any other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as at
from .tables import crc_mod, small_batches, table

BITS = 18
SAMPLE = 6_000
THRESHOLD = 0.3
PIECE_BYTES = 2 << 20
#: Distance of two equal tokens and the code of the n-gram that stands for any such pair.
REPEATS = {1: 0x5851F42D4C957F2D, 2: 0xD1342543DE82EF95}


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the unigrams and bigrams of all texts, and the text of each."""
    word = at.WORD[data]
    solid = ~at.BLANK[data] & ~word
    parts = [at.runs(word, offsets), at.runs(solid, offsets)]
    starts, ends = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(starts)
    starts, ends = starts[order], ends[order]
    codes = at.span_codes(data, starts, ends)
    text = np.searchsorted(offsets, starts, "right") - 1
    pair = text[1:] == text[:-1]
    two = at.mixed(codes[:-1] * np.uint64(3) + codes[1:] + np.uint64(1))[pair] if codes.size else codes
    found, owners = [codes, two], [text, text[1:][pair] if codes.size else text]
    for k, code in REPEATS.items():  # a token that comes again one or two places on
        again = np.flatnonzero((codes[k:] == codes[:-k]) & (text[k:] == text[:-k]))
        found.append(np.full(again.size, code, np.uint64))
        owners.append(text[again])
    return (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owners)


class FTRL:
    """Follow the regularised leader, per coordinate, for logistic loss."""

    def __init__(self, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at_: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at_], self.n[at_]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, buckets: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(buckets)
        p = 1 / (1 + np.exp(-np.clip(w @ values, -30, 30)))
        g = (p - label) * values
        n = self.n[buckets]
        self.z[buckets] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[buckets] = n + g * g


def fit(texts: pa.Array | pa.ChunkedArray, labels: list[int], bits: int = BITS, epochs: int = 3) -> np.ndarray:
    """Weights of all buckets; the last is the bias. Texts stay in their chunks, as one array holds 2 GB at most."""
    model = FTRL(bits)
    rows = []
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        data, offsets = at.text_bytes(chunk)
        for i in range(len(chunk)):
            own, _ = features(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]), bits)
            buckets, counts = np.unique(own, return_counts=True)
            rows.append((np.append(buckets, 1 << bits).astype(np.int32), np.append(counts / np.sqrt(max(1, own.size)), 1.0).astype(np.float32)))
    for _ in range(epochs):
        for (buckets, values), label in zip(rows, labels):
            model.learn(buckets, values, label)
    return model.weights()


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """At most `sample` labelled texts (text, y), chosen and ordered by a hash of doc_id."""
    picked = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("y").isNotNull() & (crc_mod("doc_id", 5) != 0))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(sample)
    )
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return joined.orderBy(F.xxhash64("doc_id"), "doc_id", "y", F.xxhash64("text")).limit(sample).select("text", "y")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Fits the model in one task over the bounded sample; only the weights come to the driver."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held)
            weights = fit(rows.column(0), rows.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary())], names=["weights"])

    found = training_rows(docs, labels, label, sample).mapInArrow(run, "weights binary").collect()
    return np.frombuffer(found[0].weights, np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def text_scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    buckets, text = features(data, offsets, bits)
    n = np.bincount(text, minlength=len(offsets) - 1)
    dot = np.bincount(text, weights[buckets], minlength=len(offsets) - 1)
    return 1 / (1 + np.exp(-np.clip(dot / np.sqrt(np.maximum(n, 1)) + weights[-1], -30, 30)))


def score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """doc_id and the score of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in at.pieces(batches, "text", PIECE_BYTES):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(text_scores(data, offsets, sent.value), pa.float64())], names=["doc_id", name])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, {name} double")


def keep_quality(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score is at least the threshold."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in at.pieces(batches, "text", PIECE_BYTES):
            yield rows.filter(pa.array(text_scores(data, offsets, sent.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
