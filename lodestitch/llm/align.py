"""Operator 11, cross-tokenizer alignment by merge-path partitioning.

Two tokenizers cut the same bytes at different places. Where both cut, a group of
tokens of A stands for a group of tokens of B; tokens whose bytes overlap are
linked.

Method. The token ends of A and of B are two sorted lists. A binary search on each
diagonal of their merge grid, for all diagonals at once, tells how many ends of
either list come before it, which divides the merge into pieces of PIECE ends
each, however the tokens fall: pieces know nothing of each other. A piece merges
its part and emits its overlaps, one for each place where a token of either list
ends, and the places where both end. A group may begin in a piece and end in a
later one; the pieces' common ends, put in order, stitch such groups together.

Links are counted corpus-wide by id pair, in documents: a grouping with partial
sums over each document's different pairs, so that a pair of nearly all documents
is no hot group. The table of pairs is broadcast to the documents' pairs where it
has at most BROADCAST_ROWS rows, else joined by a shuffle, where adaptive
execution splits common pairs.

Texts are cut before single blanks between word characters, every CHUNK characters
or so: neither tokenizer has a token across such a place (A's pattern starts a new
word there, B's vocabulary is asked), so both end there and a chunk is worked on
alone. Memory is bounded but for a text without such places. The tokenizers'
files are read by the driver and sent to the workers (some 2 MB).

Rows: null and empty texts, and texts whose bytes either tokenizer does not give
back, have no tokens: zeros, and '' as digest. Every row counts as a document,
repeated ones too, and gets a row. Ids may be null or repeated. Any other
columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import kept_table, small_batches, table

#: Where the public tokenizers' files lie.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK = 1 << 18
SLAB = 1 << 20
PIECE = 1 << 14
BROADCAST_ROWS = 1_000_000
_SAFE = re.compile(r"(?<=\w) (?=\w)")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level tokenizers write bytes: printable ones stand for themselves, the others are numbered from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(odd)}


class Strings:
    """Numbered byte strings, laid end to end so that many are joined at once."""

    def __init__(self, strings: list[bytes]):
        self.length = np.array([len(x) for x in strings], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.length[ids]
        before = np.cumsum(size) - size
        return self.flat[np.repeat(self.start[ids] - before, size) + np.arange(size.sum())]


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and texts to ids."""

    def __init__(self, byte_bpe: str, piece_bpe: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        letters = byte_letters()
        self.n_a, self.n_b = self.a.get_vocab_size(), self.b.vocab_size()
        self.a_bytes = [b""] * self.n_a
        for token, n in self.a.get_vocab().items():
            self.a_bytes[n] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(n) for n in range(self.n_b)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(n) else p.replace("▁", " ").encode() for n, p in enumerate(pieces)]
        self.a_joined, self.b_joined = Strings(self.a_bytes), Strings(self.b_bytes)
        #: No piece goes on over a blank, so that texts can be cut before one.
        self.divisible = not any("▁" in p.lstrip("▁") for p in pieces)
        # decimal ids with what follows them: "," within a side, "|" after A's last, ";" after B's last of a group
        self.written = Strings([f"{n},".encode() for n in range(self.n_a)] + [f"{n}|".encode() for n in range(self.n_a)] + [f"{n},".encode() for n in range(self.n_b)] + [f"{n};".encode() for n in range(self.n_b)])

    def chunks(self, text: str, size: int = CHUNK) -> list[str]:
        """The text without the blank before each chunk but the first; a blank goes before every chunk when it is read."""
        out, start = [], 0
        while self.divisible and len(text) - start > size and (place := _SAFE.search(text, start + size)):
            out.append(text[start : place.start()])
            start = place.end()
        return [*out, text[start:]]

    def ids(self, chunks: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[bool]]:
        """Ids by A and by B of each chunk, and whether both give the chunk's bytes back."""
        with_blank = [f" {c}" for c in chunks]
        a = [np.array(x.ids, np.int64) for x in self.a.encode_batch_fast(with_blank, add_special_tokens=False)]
        b = [np.array(x, np.int64) for x in self.b.encode(chunks, num_threads=1)]
        same = []
        for w, x, y in zip(with_blank, a, b):
            raw = np.frombuffer(w.encode(), np.uint8)
            same.append(all(own.length[ids].sum() == raw.size and np.array_equal(own.joined(ids), raw) for own, ids in ((self.a_joined, x), (self.b_joined, y))))
        return a, b, same


def diagonals(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many of a and of b come before each piece's first end, by binary search on every piece-th diagonal of the merge; equal ends take a's first."""
    d = np.append(np.arange(0, a.size + b.size, piece), a.size + b.size)
    low, high = np.maximum(0, d - b.size), np.minimum(d, a.size)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        first = np.zeros(d.size, bool)
        first[open_] = a[mid[open_]] <= b[d[open_] - mid[open_] - 1]
        low, high = np.where(open_ & first, mid + 1, low), np.where(open_ & ~first, mid, high)
    return low, d - low


def merged_piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one piece: overlaps as indexes of a and b, and common ends as indexes of a and b."""
    own_a, own_b = a[i0:i1], b[j0:j1]
    over = j0 + np.searchsorted(own_b, own_a, "left")
    under = i0 + np.searchsorted(own_a, own_b, "right")
    common = (under > 0) & (a[np.maximum(under, 1) - 1] == own_b)
    at = np.arange(j0, j1)
    return np.concatenate([np.arange(i0, i1), under[~common]]), np.concatenate([over, at[~common]]), under[common] - 1, at[common]


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pieces' overlaps, in any order, and their common ends in order; a and b end at the same place."""
    i, j = diagonals(a, b, piece)
    found = [merged_piece(a, b, *x) for x in zip(i[:-1], i[1:], j[:-1], j[1:])]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4


def grouped_ids(t: Tokenizers, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Numbers of the written ids in the order of groups, A's tokens of a group before B's; ends_a and ends_b are the groups' last tokens."""
    group_a, group_b = np.searchsorted(ends_a, np.arange(a.size)), np.searchsorted(ends_b, np.arange(b.size))
    before = np.concatenate([[0], ends_b + 1])[group_a]
    codes = np.empty(a.size + b.size, np.int64)
    last_a, last_b = np.zeros(a.size, np.int64), np.zeros(b.size, np.int64)
    last_a[ends_a], last_b[ends_b] = t.n_a, t.n_b
    codes[np.arange(a.size) + before] = a + last_a
    codes[np.arange(b.size) + ends_a[group_b] + 1] = b + last_b + 2 * t.n_a
    return codes


@dataclass
class Aligned:
    """What is known of one text so far."""

    good: bool = True
    counts: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))
    digest: object = field(default_factory=hashlib.sha256)
    held: bytes = b""
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def add(self, counts: np.ndarray, groups: bytes, pairs: np.ndarray, n: np.ndarray) -> None:
        self.counts += counts
        self.digest.update(self.held + groups[:-1])
        self.held = groups[-1:]
        self.pairs.append((pairs, n))

    def row(self) -> tuple[list[int], str, np.ndarray, np.ndarray]:
        if not self.good or not self.counts.any():
            return [0, 0, 0, 0], "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs, n = self.pairs[0]
        if len(self.pairs) > 1:
            pairs, where = np.unique(np.concatenate([p for p, _ in self.pairs]), return_inverse=True)
            n = np.bincount(where, np.concatenate([x for _, x in self.pairs])).astype(np.int64)
        return self.counts.tolist(), self.digest.hexdigest(), pairs, n


def align_slab(t: Tokenizers, slab: list[tuple[Aligned, str]], piece: int = PIECE) -> None:
    """Aligns chunks of texts, as one merge."""
    ids_a, ids_b, same = t.ids([c for _, c in slab])
    for (text, _), good in zip(slab, same):
        text.good &= good
    kept = [(text, x, y) for (text, _), x, y, good in zip(slab, ids_a, ids_b, same) if good]
    if not kept:
        return
    n_a, n_b = (np.array([len(x[k]) for x in kept]) for k in (1, 2))
    a, b = (np.concatenate([x[k] for x in kept]) for k in (1, 2))
    firsts_a, firsts_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
    over_a, over_b, common_a, common_b = overlaps(np.cumsum(t.a_joined.length[a]), np.cumsum(t.b_joined.length[b]), piece)
    written = grouped_ids(t, a, b, common_a, common_b)
    chunk = np.searchsorted(firsts_a, over_a, "right") - 1
    n_links, n_groups = np.bincount(chunk, minlength=len(kept)), np.diff(np.searchsorted(common_a, firsts_a))
    codes, n = np.unique(chunk * (t.n_a * t.n_b) + a[over_a] * t.n_b + b[over_b], return_counts=True)
    edges = np.searchsorted(codes, np.arange(len(kept) + 1) * (t.n_a * t.n_b))
    places = np.append(0, np.cumsum(t.written.length[written]))[firsts_a + firsts_b]
    groups = t.written.joined(written).tobytes()
    for k, (text, _, _) in enumerate(kept):
        own = slice(edges[k], edges[k + 1])
        text.add(np.array([n_a[k], n_b[k], n_groups[k], n_links[k]]), groups[places[k] : places[k + 1]], codes[own] - k * (t.n_a * t.n_b), n[own])


def align_texts(t: Tokenizers, texts: list[str | None], chunk: int = CHUNK, slab: int = SLAB, piece: int = PIECE) -> list[Aligned]:
    out, held, size = [], [], 0
    for text in texts:
        out.append(Aligned())
        for c in t.chunks(text, chunk) if text else []:
            held.append((out[-1], c))
            size += len(c)
            if size >= slab:
                align_slab(t, held, piece)
                held, size = [], 0
    if held:
        align_slab(t, held, piece)
    return out


_SCHEMA = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<struct<pair: bigint, n: bigint>>"
_loaded: dict[int, Tokenizers] = {}


def _ready(files: tuple[str, bytes]) -> Tokenizers:
    """A worker's tokenizers, loaded once."""
    key = zlib.crc32(files[1], zlib.crc32(files[0].encode()))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizers(*files)
    return _loaded[key]


def aligned(docs: DataFrame, tokenizers: str = TOKENIZERS, columns: list[str] | None = None) -> tuple[DataFrame, int]:
    """row (the input row, or its `columns`), key (of the row), n_a, n_b, n_groups, n_links, groups_sha256 and pairs (a * m + b, occurrences) of every row; and m, the size of B's vocabulary."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(f"{tokenizers}/{BYTE_BPE}", encoding="utf-8") as one, open(f"{tokenizers}/{PIECE_BPE}", "rb") as two:
        files = one.read(), two.read()
    sent = spark.sparkContext.broadcast(files)
    told = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns or docs.columns)).alias("row"), F.col("text").alias("text"), F.monotonically_increasing_id().alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _ready(sent.value)
        for batch in batches:
            rows = [x.row() for x in align_texts(t, batch.column(1).to_pylist())]
            counts = np.array([r[0] for r in rows], np.int64).reshape(-1, 4)
            sizes = np.array([r[2].size for r in rows], np.int64)
            flat = [np.concatenate([np.zeros(0, np.int64), *(r[k] for r in rows)]) for k in (2, 3)]
            pairs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in flat], ["pair", "n"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(counts[:, k]) for k in range(4)), pa.array([r[1] for r in rows], pa.string()), pairs], names=["row", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    row = told.schema["row"].dataType.simpleString()
    return told.mapInArrow(run, f"row {row}, key bigint, {_SCHEMA}"), _ready(files).n_b


def pair_counts(found: DataFrame, m: int) -> DataFrame:
    """pair, docs (documents that hold it linked) and best (no pair of its A id is in more) of every linked pair."""
    counted = found.select(F.explode("pairs.pair").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    counted = kept_table(counted.withColumn("a", F.floor(F.col("pair") / m)), "pairs")
    most = counted.groupBy("a").agg(F.max("docs").alias("most"))
    return counted.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, tokenizers: str = TOKENIZERS, columns: list[str] | None = None) -> DataFrame:
    """row (the input row, or its `columns`), n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and pairs of every row."""
    found, m = aligned(docs, tokenizers, columns)
    found = kept_table(found, "aligned")
    counts = kept_table(pair_counts(found, m), "pair-counts")
    links = found.select("key", F.explode("pairs").alias("x")).select("key", "x.pair", "x.n")
    joined = links.join(F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts, "pair")
    sums = joined.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    none = F.lit(0).cast("bigint")
    return found.join(sums, "key", "left").select("row", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256", "pairs")


def group_lists(t: Tokenizers, text: str) -> list[tuple[list[int], list[int]]]:
    """The groups of one text, as ids of A and of B: what groups_sha256 is a digest of."""
    (ids_a,), (ids_b,), (good,) = t.ids([text]) if text else ([None], [None], [False])
    if not good:
        return []
    _, _, common_a, common_b = overlaps(np.cumsum(t.a_joined.length[ids_a]), np.cumsum(t.b_joined.length[ids_b]))
    edges = pairwise(zip(np.append(0, common_a + 1), np.append(0, common_b + 1)))
    return [(ids_a[i:k].tolist(), ids_b[j:l].tolist()) for (i, j), (k, l) in edges]


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return found.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
