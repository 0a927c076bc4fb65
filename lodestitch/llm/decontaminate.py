"""Operator 5, benchmark decontamination with suffix arrays.

Rows are cut into shards of whole documents, in the tasks that read them. A
shard's words are numbered by an exact dictionary of their bytes, and a suffix
array over all its words is built by prefix doubling. The shards are stored
once in the folder that all executors share: dictionary, word numbers, suffix
array and the rows' keys. Every suffix of every benchmark item is then looked up
in every shard: a window is absent where one of its runs of GRAM words is not in
the bit table of the shard's runs (codes of words do not depend on a shard, so
the benchmark's are computed once). The others' words are found by the
dictionary, their windows by binary search, which gives all places where the
window stands. Places along one diagonal are one longest verbatim match, with
its location in the document and in the item.

Benchmark items are searched in blocks of at most `block_bytes` of text (or of
one item), BLOCKS of them in one reading of the shards; the driver holds two
blocks at a time, a worker BLOCKS. Hits of all blocks, be it one or many, are merged
per row by the shard and the row's place in it, so that every input row gives one
row, whatever ids repeat or are missing.

Rows: a null or empty text has no words and is clean. Words are the lower-cased
(A-Z) runs of digits, letters and non-ASCII characters. An item of fewer words
than a window is one window, an item of none is none. Repeated documents each
get a row, items with the same id count once, an item without an id counts
under the empty id. Any other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as at
from .tables import cut, kept_table, packed, small_batches, table, text_key

WINDOW = 10
#: Text of a shard; what is stored of it takes about twice that.
SHARD_BYTES = 1 << 20
BLOCK_BYTES = 8 << 20
#: Blocks that are searched in one reading of the shards, and the words of the runs that rule windows out.
BLOCKS = 4
GRAM = 3


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words as an Arrow array of their bytes, and where each text's words begin."""
    data = at.LOWER[data]
    inside = at.WORD[data]
    starts, ends = at.runs(inside, offsets)
    to = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), starts.size, [None, pa.py_buffer(to), pa.py_buffer(data[inside])]), at.per_text(offsets, starts)


def _tokens(numbers: np.ndarray, firsts: np.ndarray, vocabulary: int) -> np.ndarray:
    """Word numbers with an end of its own after each text, greater than any word."""
    n = np.diff(firsts)
    out = np.empty(numbers.size + n.size, np.int64)
    text = np.repeat(np.arange(n.size), n)
    out[np.arange(numbers.size) + text] = numbers
    out[firsts[1:] + np.arange(n.size)] = vocabulary + np.arange(n.size)
    return out


def _gram_codes(codes: np.ndarray) -> np.ndarray:
    """A code of the GRAM words that begin at each place, but for the last ones."""
    n = max(0, codes.size - GRAM + 1)
    out = codes[:n]
    for k in range(1, GRAM):
        out = at.mixed(out * np.uint64(0x9E3779B97F4A7C15) + codes[k : n + k])
    return out


def _word_codes(words: pa.Array) -> np.ndarray:
    data, offsets = at.text_bytes(words)
    return at.span_codes(data, offsets[:-1], offsets[1:])


class Grams:
    """A bit table of a shard's runs of GRAM words, of at most 16 MB: what is not in it does not stand in the shard."""

    def __init__(self, words: pa.Array, tokens: np.ndarray):
        codes = np.concatenate([_word_codes(words), np.zeros(1, np.uint64)])  # all ends have the last code
        self.shift = np.uint64(64 - min(24, max(16, int(8 * tokens.size).bit_length())))
        self.there = np.zeros(1 << (64 - int(self.shift)), bool)
        self.there[_gram_codes(codes[np.minimum(tokens, len(words))]) >> self.shift] = True

    def absent(self, grams: np.ndarray) -> np.ndarray:
        return ~self.there[grams >> self.shift]


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """The places of all suffixes in their order, by prefix doubling: places whose order is settled are not sorted again."""
    n = tokens.size
    order = np.argsort(tokens, kind="stable")
    head = np.searchsorted(tokens[order], tokens)  # the rank of a suffix: the first place of those like it so far
    rank, h = head.astype(np.int64), 1
    while True:
        sorted_ranks = rank[order]
        same = np.zeros(n + 1, bool)
        same[1:-1] = sorted_ranks[1:] == sorted_ranks[:-1]
        open_ = np.flatnonzero(same[1:] | same[:-1])
        if not open_.size:
            return order
        place = order[open_]
        following = np.where(place + h < n, rank[np.minimum(place + h, n - 1)], -1)
        key = rank[place] * (n + 1) + following + 1
        by = np.argsort(key, kind="stable")
        place, key = place[by], key[by]
        order[open_] = place
        new = np.ones(key.size, bool)
        new[1:] = key[1:] != key[:-1]
        rank[place] = open_[np.maximum.accumulate(np.where(new, np.arange(key.size), 0))]
        h *= 2


def shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored suffix arrays: shard, the key (doc_id, t1, t2) and the number of words of each of its rows, and words, word_ends, tokens and suffixes as bytes."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.struct(F.col(doc_id).alias("doc_id"), *text_key(text)).alias("key"), F.col(text).alias("text"))
    key = narrow.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in at.pieces(batches, "text", SHARD_BYTES):
            words, firsts = _words(data, offsets)
            coded = words.dictionary_encode()
            tokens = _tokens(coded.indices.to_numpy().astype(np.int64), firsts, len(coded.dictionary))
            bytes_, ends = at.text_bytes(coded.dictionary)
            keys = rows.column(0)
            columns = {
                "shard": pa.array([uuid.uuid4().hex]),
                "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                "n_words": pa.array([np.diff(firsts).tolist()], pa.list_(pa.int64())),
                "words": pa.array([bytes_.tobytes()], pa.binary()),
                "word_ends": pa.array([ends.astype(np.int32).tobytes()], pa.binary()),
                "tokens": pa.array([tokens.astype(np.int32).tobytes()], pa.binary()),
                "suffixes": pa.array([suffix_array(tokens).astype(np.int32).tobytes()], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = f"shard string, keys array<{key}>, n_words array<bigint>, words binary, word_ends binary, tokens binary, suffixes binary"
    return kept_table(narrow.mapInArrow(run, schema), "suffix-arrays")


class Suffixes:
    """The suffixes of a block of benchmark items, as far as they are windows."""

    def __init__(self, ids: list, texts: list, window: int = WINDOW):
        if window < 1:
            raise ValueError("window must be 1 or more")
        data, offsets = at.text_bytes(pa.array(texts, pa.string()))
        words, firsts = _words(data, offsets)
        coded = words.dictionary_encode()
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy().astype(np.int32)
        n = np.diff(firsts)
        width = np.repeat(np.minimum(n, window), n)
        keep = np.arange(self.codes.size) + width <= np.repeat(firsts[1:], n)
        self.at, self.width = np.flatnonzero(keep).astype(np.int32), width[keep].astype(np.int32)
        self.item = np.repeat(np.arange(len(ids), dtype=np.int32), n)[keep]
        self.first = np.repeat(firsts[:-1].astype(np.int32), n)[keep]
        self.grams = _gram_codes(_word_codes(self.words)[self.codes])
        self.ids = np.array(["" if x is None else str(x) for x in ids], dtype=object)

    def occurrences(self, words: pa.Array, tokens: np.ndarray, order: np.ndarray, grams: Grams | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Every place where a window's words stand in the shard: token place and window."""
        none = np.zeros(0, np.int64)
        if not tokens.size or not self.at.size:
            return none, none
        # windows of which no run of words is ruled out; those shorter than a run hold none
        absent = np.zeros(self.codes.size + 1, np.int32)
        np.cumsum((grams or Grams(words, tokens)).absent(self.grams), out=absent[1 : self.grams.size + 1])
        open_ = np.flatnonzero(absent[self.at + np.maximum(self.width - GRAM + 1, 0)] == absent[self.at])
        if not open_.size:
            return none, none
        number = pc.fill_null(pc.index_in(self.words, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)[self.codes]
        missing = np.concatenate([[0], np.cumsum(number < 0)])
        asked = open_[missing[self.at[open_] + self.width[open_]] == missing[self.at[open_]]]
        low, high = self._range(tokens, order, number, asked)
        n = high - low
        window = np.repeat(asked, n)
        return order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], window

    def _range(self, tokens: np.ndarray, order: np.ndarray, number: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By binary search, the first suffix not before each asked window, and the first beyond those that begin with it."""
        out = []
        for beyond in (False, True):
            left, right = np.zeros(asked.size, np.int64), np.full(asked.size, order.size, np.int64)
            while (open_ := np.flatnonzero(left < right)).size:
                mid = (left[open_] + right[open_]) // 2
                smaller = np.full(open_.size, beyond)  # a suffix that begins with the window
                rest, k = np.arange(open_.size), 0
                while rest.size:
                    rest = rest[self.width[asked[open_[rest]]] > k]
                    place = order[mid[rest]] + k
                    theirs = tokens[np.minimum(place, tokens.size - 1)]  # the last token is an end, so none goes beyond it
                    ours = number[self.at[asked[open_[rest]]] + k]
                    decided = theirs != ours
                    smaller[rest[decided]] = theirs[decided] < ours[decided]
                    rest, k = rest[~decided], k + 1
                left[open_[smaller]] = mid[smaller] + 1
                right[open_[~smaller]] = mid[~smaller]
            out.append(left)
        return out[0], out[1]


def _benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[tuple[list, list]]:
    """Items in blocks of a bounded size, read partition by partition."""
    ids, texts, size, some = [], [], 0, False
    for row in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        ids.append(row.i)
        texts.append(row.t or "")
        size += len(texts[-1].encode())
        if size >= block_bytes:
            yield ids, texts
            ids, texts, size, some = [], [], 0, True
    if ids or not some:
        yield ids, texts


_HITS = "shard string, doc bigint, hit_words array<struct<from:bigint,to:bigint>>, item_ids array<string>, matches array<struct<n_words:bigint,item_id:string,doc_word:bigint,item_word:bigint>>"
_RANGE = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
_MATCH = pa.list_(pa.struct([("n_words", pa.int64()), ("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64())]))


def _hits(sent: list):
    """mapInArrow over shards: the rows that blocks of the benchmark hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                cell = lambda name: batch.column(batch.schema.get_field_index(name))[n].as_buffer()  # noqa: E731, B023
                ends, raw = np.frombuffer(cell("word_ends"), np.int32), cell("words")
                words = pa.Array.from_buffers(pa.binary(), ends.size - 1, [None, pa.py_buffer(ends), raw])
                tokens, order = (np.frombuffer(cell(c), np.int32).astype(np.int64) for c in ("tokens", "suffixes"))
                grams = Grams(words, tokens)
                for block in (b.value for b in sent):
                    place, found = block.occurrences(words, tokens, order, grams)
                    yield _merged(batch.column(0)[n].as_py(), tokens >= len(words), place, found, block)

    return run


def _merged(shard: str, is_end: np.ndarray, place: np.ndarray, found: np.ndarray, block: Suffixes) -> pa.RecordBatch:
    """Per row of a shard that is hit: merged word ranges, items, and matches as long as they go."""
    firsts = np.concatenate([[0], np.flatnonzero(is_end) + 1])
    doc = np.searchsorted(firsts, place, "right") - 1
    change = np.zeros(is_end.size + 1, np.int64)
    np.add.at(change, place, 1)
    np.subtract.at(change, place + block.width[found], 1)
    begins, ends = at.runs(np.cumsum(change)[:-1] > 0, firsts)
    # hits one word apart in both texts, on one diagonal, are one match
    diagonal = place - block.at[found]
    by = np.lexsort((place, diagonal, block.item[found], doc))
    place, found, doc, diagonal = place[by], found[by], doc[by], diagonal[by]
    item = block.item[found]
    new = np.ones(place.size, bool)
    new[1:] = (place[1:] != place[:-1] + 1) | (diagonal[1:] != diagonal[:-1]) | (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.concatenate([start, [place.size]])) + block.width[found[start]] - 1 if place.size else start
    rows: dict[int, tuple[list, list]] = {}
    for d, b, e in zip((np.searchsorted(firsts, begins, "right") - 1).tolist(), begins.tolist(), ends.tolist()):
        rows.setdefault(d, ([], []))[0].append({"from": b - int(firsts[d]), "to": e - int(firsts[d])})
    for d, i, p, f, n in zip(doc[start].tolist(), item[start].tolist(), place[start].tolist(), found[start].tolist(), size.tolist()):
        rows[d][1].append({"n_words": n, "item_id": block.ids[i], "doc_word": p - int(firsts[d]), "item_word": int(block.at[f] - block.first[f])})
    own = sorted(rows)
    columns = [pa.array([shard] * len(own), pa.string()), pa.array(own, pa.int64()), pa.array([rows[d][0] for d in own], _RANGE)]
    columns += [pa.array([sorted({m["item_id"] for m in rows[d][1]}) for d in own], pa.list_(pa.string())), pa.array([rows[d][1] for d in own], _MATCH)]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "doc", "hit_words", "item_ids", "matches"])


def search(stored: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """shard, doc (the row's place in it), hit_words, item_ids and matches of the rows that are hit: a row for each block that hits."""
    out, blocks = None, _benchmark_blocks(benchmark, item_id, item_text, block_bytes)
    while sent := [stored.sparkSession.sparkContext.broadcast(Suffixes(*block, window)) for block in islice(blocks, BLOCKS)]:
        found = stored.select("shard", "words", "word_ends", "tokens", "suffixes").mapInArrow(_hits(sent), _HITS)
        out = found if out is None else out.unionByName(found)
    return out


def _rows(stored: DataFrame) -> DataFrame:
    """shard, doc, key and n_words of every input row."""
    told = stored.select("shard", F.posexplode(F.arrays_zip("keys", "n_words")).alias("doc", "x"))
    return told.select("shard", F.col("doc").cast("bigint").alias("doc"), F.col("x.keys").alias("key"), F.col("x.n_words").alias("n_words"))


#: Ranges of all blocks, sorted, as ranges that neither touch nor overlap.
_JOINED = """aggregate(array_sort(flatten(collect_list(hit_words))), cast(array() as array<struct<from:bigint,to:bigint>>),
 (s, r) -> if(size(s) > 0 and s[size(s) - 1].to >= r.from, concat(slice(s, 1, size(s) - 1), array(named_struct('from', s[size(s) - 1].from, 'to', greatest(s[size(s) - 1].to, r.to)))), concat(s, array(r))))"""


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, hit_words (ranges of word positions, end exclusive), item_ids and longest, the longest verbatim match (n_words, item_id, doc_word, item_word; of equal ones the first by these)."""
    stored = shards(docs, doc_id, text)
    hits = search(stored, benchmark, item_id, item_text, window, block_bytes)
    first = F.array_sort(F.flatten(F.collect_list("matches")), lambda a, b: F.when(a["n_words"] != b["n_words"], F.signum(b["n_words"] - a["n_words"]).cast("int")).when(F.struct(*(a[c] for c in ("item_id", "doc_word", "item_word"))) < F.struct(*(b[c] for c in ("item_id", "doc_word", "item_word"))), -1).when(F.struct(*(a[c] for c in ("item_id", "doc_word", "item_word"))) > F.struct(*(b[c] for c in ("item_id", "doc_word", "item_word"))), 1).otherwise(0))
    merged = hits.groupBy("shard", "doc").agg(F.expr(_JOINED).alias("hit_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.get(first, 0).alias("longest"))
    told = _rows(stored).join(merged, ["shard", "doc"], "left")
    n_hit = F.aggregate("hit_words", F.lit(0).cast("bigint"), lambda s, r: s + r["to"] - r["from"])
    return told.select(
        "key.doc_id",
        "n_words",
        F.coalesce(n_hit, F.lit(0)).alias("n_hit"),
        F.coalesce("hit_words", F.expr("cast(array() as array<struct<from:bigint,to:bigint>>)")).alias("hit_words"),
        F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids"),
        "longest",
    )


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The verbatim matches, each as long as it can be on both sides: doc_id, item_id, doc_word, item_word, n_words."""
    stored = shards(docs)
    found = search(stored, benchmark, window=window, block_bytes=block_bytes).select("shard", "doc", F.explode("matches").alias("m"))
    return found.join(_rows(stored), ["shard", "doc"]).select("key.doc_id", "m.item_id", "m.doc_word", "m.item_word", "m.n_words")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of which no word lies in a benchmark window, with all their columns; rows without an id stay where they are clean."""
    stored = shards(docs)
    hits = search(stored, benchmark, window=window, block_bytes=block_bytes).select("shard", "doc").distinct()
    gone = cut(hits.join(_rows(stored), ["shard", "doc"]).select(F.col("key.doc_id").alias("gone_id"), F.col("key.t1").alias("g1"), F.col("key.t2").alias("g2")).distinct())
    t1, t2 = text_key("text")
    rows = packed(docs, doc_id=F.col("doc_id"), t1=t1, t2=t2)
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("t1") == F.col("g1")) & (F.col("t2") == F.col("g2")), "left_anti").select("row.*")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce("longest.n_words", F.lit(0)).alias("longest_words"),
        F.col("longest.item_id").alias("longest_item"),
        F.col("longest.doc_word").alias("longest_at"),
        F.col("longest.item_word").alias("longest_in_item"),
    )


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT row_number() OVER () AS item, coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT item, item_id, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT item, item_id, n, i AS j, w[i:i + n - 1] AS g FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT dw.doc_id, dw.i, dw.n, win.item, win.item_id, win.j FROM dw JOIN win ON dw.n = win.n AND dw.w[dw.i:dw.i + dw.n - 1] = win.g),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id),
placed AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item, i - j ORDER BY i) AS run FROM hits),
runs AS (SELECT doc_id, item_id, min(i) - 1 AS doc_word, min(j) - 1 AS item_word, max(n) + count(*) - 1 AS n FROM placed GROUP BY doc_id, item, item_id, i - j, run),
longest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, item_id, doc_word, item_word) = 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(longest.n, 0) AS BIGINT) AS longest_words, longest.item_id AS longest_item, longest.doc_word AS longest_at, longest.item_word AS longest_in_item
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""
