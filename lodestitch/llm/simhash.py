"""Operator 9, SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints: the majority bits of the XXH64 (seed 42) of a text's word
shingles. Links: two fingerprints of at most `distance` differing bits.

Method. Bits that are correlated over the corpus are grouped into PARTS
partitions. Thresholds per partition, which may be unequal (-1: not probed),
are allocated by dynamic programming so that they sum to distance - PARTS + 1,
with the least estimated number of candidates: from the histogram of each
partition's values over all fingerprints. Records meet under the keys of their
partition's value and of its neighbours: both sides go half of the threshold,
rounded up, so two values that differ by the whole of it share a key. Buckets
of more than BUCKET different fingerprints are split again by the bits not used
so far (plain pigeonhole), at most until FEW bits are left, which bounds a
bucket. For distances of PARTS bits and more such keys would be too short, so
a large bucket is dealt to pairs of blocks of at most BUCKET / 2 each. In a
bucket, pairs are verified by the whole fingerprints and only a spanning forest
of the links is kept, never all pairs. Components come from alternating large
and small stars, checkpointed each round.

Rows: a null or empty text has fingerprint zero, linked like any other. Every
row gets a row. A null doc_id is in a group but never its component id, which
is null where a group has no other. Any other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrowtext as at
from .tables import cut, kept_table, packed, small_batches, table, text_key

SHINGLE = 3
DISTANCE = 3
#: Bits that may differ where documents are dropped, in either of two fingerprints: nearly all near copies of 0.8 by
#: five-word shingles differ in so few, and thresholds of 2 in each of four partitions need no more keys than less.
WIDE = 11
#: Similarity of word shingles from which on a document is a near copy of one that stays: ALIKE[0] / ALIKE[1] by shingles of WORDS words.
ALIKE = (4, 5)
WORDS = 5
#: Documents of a candidate group that the others are compared with in the first round, and the factor of each further round.
LEADERS = 4
PARTS = 4
#: Different fingerprints that one bucket compares with each other.
BUCKET = 4_096
FEW = 12
#: Keys of large buckets that may be broadcast, some 32 MB; beyond, a shuffled join takes their place.
BROADCAST_ROWS = 1_000_000
PIECE_BYTES = 1 << 20
_HASH = xxhash.xxh64_digest


def _joined_words(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words joined by single blanks, where each starts and ends, and the first word of each text."""
    data = at.LOWER[data]
    starts, ends = at.runs(~at.BLANK[data], offsets)
    firsts = at.per_text(offsets, starts)
    # words joined by single blanks: each keeps its bytes, and one blank follows it
    size = ends - starts + 1
    to = np.concatenate([[0], np.cumsum(size)])
    joined = np.full(to[-1], 32, np.uint8)
    word = np.repeat(np.arange(starts.size), ends - starts)
    inside = ~at.BLANK[data]
    joined[np.flatnonzero(inside) - starts[word] + to[:-1][word]] = data[inside]
    return joined.tobytes(), to[:-1], to[1:] - 1, firsts


def _shingle_hashes(words: tuple[bytes, np.ndarray, np.ndarray, np.ndarray], shingle: int) -> tuple[bytes, np.ndarray]:
    """The digests of all shingles, text by text, and how many each text has; fewer words than a shingle count as one."""
    raw, starts, ends, firsts = words
    n = np.diff(firsts)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    begin = np.repeat(firsts[:-1] - np.cumsum(count) + count, count) + np.arange(count.sum())
    last = begin + np.repeat(np.minimum(n, shingle), count) - 1
    return b"".join([_HASH(raw[s:e], 42) for s, e in zip(starts[begin].tolist(), ends[last].tolist())]), count


def _majority(hashes: bytes, count: np.ndarray) -> np.ndarray:
    out = np.zeros(count.size, np.uint64)
    full = np.flatnonzero(count)
    if full.size:
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, (np.cumsum(count) - count)[full], axis=0, dtype=np.int32)
        major = np.packbits(ones * 2 > count[full][:, None], axis=1)
        out[full] = major.view(">u8").ravel()
    return out


def _second_majority(hashes: bytes, count: np.ndarray) -> np.ndarray:
    """Majority bits of the same shingles under hashes that are independent of the first."""
    again = at.mixed(np.frombuffer(hashes, "<u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return _majority(again.tobytes(), count)


def text_fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Majority bits of each text's shingles, as unsigned 64-bit numbers."""
    return _majority(*_shingle_hashes(_joined_words(data, offsets), shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (64 bits, as a signed number) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in at.pieces(batches, "text", PIECE_BYTES):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(text_fingerprints(data, offsets, shingle).view(np.int64))], names=["doc_id", "fp"])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp bigint")


def correlated_parts(nodes: DataFrame, parts: int = PARTS) -> list[list[int]]:
    """Bits grouped by the correlation of all pairs of bits over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((64, 64), np.int64)
        for rows in batches:
            fp = rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            bits = np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float64)
            both += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(both.ravel())], names=["cell", "n"])

    both = np.zeros(4096)
    n = nodes.count()
    for row in nodes.select("fp").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        both[row.cell] = row.n
    both = both.reshape(64, 64) / max(1, n)
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs((both - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(near, -1)
    left, out, width = set(range(64)), [], 64 // parts
    for _ in range(parts):
        rest = sorted(left)
        sub = near[np.ix_(rest, rest)]
        group = [rest[int(k)] for k in np.unravel_index(np.argmax(sub), sub.shape)][:width] if len(rest) > 1 else rest
        while len(group) < width:
            rest = sorted(left - set(group))
            group.append(rest[int(np.argmax(near[np.ix_(rest, group)].mean(1)))])
        out.append(sorted(group))
        left -= set(group)
    return out


def _value(bits: list[int]) -> Column:
    """The bits of a partition, gathered into a small number."""
    value = F.lit(0).cast("bigint")
    for k, b in enumerate(bits):
        value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1)), k))
    return value


def candidate_counts(histogram: np.ndarray, most: int) -> list[float]:
    """Pairs of records whose values differ in at most t bits, for t from 0 to most."""
    at_distance = [histogram.astype(float)] + [np.zeros(histogram.size)] * most
    index = np.arange(histogram.size)
    for bit in range(int(histogram.size).bit_length() - 1):
        flipped = index ^ (1 << bit)
        at_distance = [at_distance[t] + (at_distance[t - 1][flipped] if t else 0) for t in range(most + 1)]
    return np.cumsum([float(histogram @ x) for x in at_distance]).tolist()


def _radius(threshold: int) -> int:
    """How far each side's keys go from its own value."""
    return (threshold + 1) // 2


def allocate(costs: list[list[float]], distance: int) -> list[int]:
    """Thresholds of least total cost with sum(threshold + 1) = distance + 1; costs[i][t + 1] is that of threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, len(own) - 1):
                total = used + t + 1
                if total <= distance + 1 and (total not in following or cost + own[t + 1] < following[total][0]):
                    following[total] = (cost + own[t + 1], [*chosen, t])
        best = following
    return best[distance + 1][1]


def plan_partitions(nodes: DataFrame, distance: int = DISTANCE, parts: int = PARTS) -> list[tuple[list[int], int]]:
    """Partitions of the bits with their thresholds. Histograms have at most parts * 2**(64 / parts) rows."""
    groups = correlated_parts(nodes, parts)
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), _value(g).alias("value")) for i, g in enumerate(groups)])).alias("x")
    counted = nodes.select(values).groupBy("x.part", "x.value").agg(F.count(F.lit(1)).alias("n")).toArrow()
    part, value, n = (counted.column(c).to_numpy() for c in ("part", "value", "n"))
    costs = []
    for i, g in enumerate(groups):
        own = np.zeros(1 << len(g), np.int64)
        own[value[part == i]] = n[part == i]
        probes = np.cumsum([float(np.prod([(len(g) - k) / (k + 1) for k in range(r)])) for r in range(_radius(distance) + 1)])
        pairs = candidate_counts(own, 2 * _radius(distance))
        costs.append([0.0, *(pairs[2 * _radius(t)] + own.sum() * probes[_radius(t)] for t in range(distance + 1))])
    return list(zip(groups, allocate(costs, distance)))


def _keys(nodes: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """key, used (mask of the bits in the key) and fp: one row for each partition, and each neighbour within its radius; all of them in one reading of the nodes."""
    key_of = lambda i, used: lambda flip: F.struct(F.xxhash64(F.lit(i), F.col(f"value_{i}").bitwiseXOR(flip)).alias("key"), used.alias("used"))
    values, keys = {}, []
    for i, (bits, most) in enumerate(plan):
        if most < 0:
            continue
        used, radius = sum(1 << b for b in bits), _radius(most)
        flips = [0]
        for _ in range(radius):
            flips = sorted({f ^ (1 << k) for f in flips for k in range(len(bits))} | set(flips))
        used = used - (1 << 64) if used >> 63 else used
        # a neighbour's key fixes no bit of the record itself
        values[f"value_{i}"] = _value(bits)
        keys.append(F.transform(F.array(*[F.lit(f).cast("bigint") for f in flips]), key_of(i, F.lit(used if radius == 0 else 0).cast("bigint"))))
    return nodes.withColumns(values).select(F.explode(F.concat(*keys)).alias("x"), "fp").select("x.key", "x.used", "fp")


def _refined(rows: DataFrame, distance: int) -> DataFrame:
    """Rows of large buckets under finer keys: one for each of distance + 1 shares of the bits not used so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, used, fp = (batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(3))
            for mask in np.unique(used).tolist():
                own = used == np.uint64(mask)
                free = [b for b in range(64) if not mask >> b & 1]
                for k, share in enumerate(np.array_split(np.array(free), distance + 1)):
                    share_mask = sum(1 << int(b) for b in share)
                    fine = at.mixed(at.mixed(key[own] + np.uint64(k + 1)) ^ (fp[own] & np.uint64(share_mask)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fine.view(np.int64)), pa.array(np.full(fine.size, mask | share_mask, np.uint64).view(np.int64)), pa.array(fp[own].view(np.int64))], names=["key", "used", "fp"]
                    )

    return rows.select("key", "used", "fp").mapInArrow(run, "key bigint, used bigint, fp bigint")


def _block_pairs(rows: DataFrame, sizes: DataFrame, bucket: int) -> DataFrame:
    """Rows of large buckets under a key for each pair of their bucket's blocks that holds their own block."""
    told = rows.join(sizes.withColumn("blocks", F.ceil(F.col("count") * 2.5 / bucket).cast("int")), "key")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pairs = told.withColumn("own", own.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return pairs.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "used", "fp")


def _linked(key: np.ndarray, fp: np.ndarray, distance: int) -> np.ndarray:
    """Rows sorted by key: for each the least row of its key that links reach from it."""
    label = np.arange(key.size)
    open_ = np.arange(key.size)
    step = 1
    while open_.size:
        open_ = open_[open_ + step < key.size]
        open_ = open_[key[open_] == key[open_ + step]]
        apart = open_[label[open_] != label[open_ + step]]
        near = apart[np.bitwise_count(fp[apart] ^ fp[apart + step]) <= distance]
        while near.size:
            a, b = label[near], label[near + step]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(label, high, low)
            while not np.array_equal(label, label[label]):
                label = label[label]
            near = near[label[near] != label[near + step]]
        step += 1
    return label


def _bucket_links(rows: DataFrame, distance: int) -> DataFrame:
    """u and v: each linked fingerprint of a bucket and the first one that it is linked with, verified."""
    sorted_rows = rows.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            label = _linked(key, fp, distance)
            moved = np.flatnonzero((label != np.arange(label.size)) & (fp != fp[label]))
            return pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[label[moved]].view(np.int64))], names=["u", "v"])

        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            whole = int(np.searchsorted(key, key[-1])) if key.size else 0  # the last key may go on
            if whole:
                yield links(key[:whole], fp[:whole])
                key, fp = key[whole:], fp[whole:]
        yield links(key, fp)

    return sorted_rows.mapInArrow(run, "u bigint, v bigint")


def fingerprint_links(nodes: DataFrame, distance: int = DISTANCE, parts: int = PARTS, bucket: int = BUCKET) -> DataFrame:
    """A spanning part of the links among different fingerprints: u and v."""
    plan = plan_partitions(nodes, distance, parts)
    rows, out = _keys(nodes, plan), None
    free = 64 if any(t > 0 for _, t in plan) else 64 - 64 // parts
    while True:
        sizes = rows.groupBy("key").count().where(F.col("count") > bucket)
        sizes = cut(sizes) if free > FEW else None
        large = sizes.count() if sizes is not None else 0
        if not large:
            found = _bucket_links(rows, distance)
            return found if out is None else out.unionByName(found)
        sizes = F.broadcast(sizes) if large <= BROADCAST_ROWS else sizes
        found = _bucket_links(rows.join(sizes, "key", "left_anti"), distance)
        out = found if out is None else out.unionByName(found)
        if distance >= parts:
            return out.unionByName(_bucket_links(_block_pairs(rows, sizes, bucket), distance))
        rows = _refined(rows.join(sizes, "key", "left_semi"), distance)
        free -= free // (distance + 1)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node with an edge."""
    edges = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    prints = kept_table(fingerprints(docs, shingle), "fingerprints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    roots = components(fingerprint_links(nodes.select("fp"), distance))
    labelled = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return prints.join(labelled.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def dedup_documents(docs: DataFrame, shingle: int = SHINGLE, distance: int = WIDE) -> DataFrame:
    """One document of each component, that of the least doc_id, with all its columns; a component without any doc_id stays."""
    keep = near_duplicates(docs, shingle, distance).where("component_id is null or doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    return packed(docs, doc_id=F.col("doc_id")).join(keep, F.col("doc_id").eqNullSafe(F.col("kept")), "left_semi").select("row.*")


def _described(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2, key (128 bits of the words), n_words and two fingerprints, fp and fp2, of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in at.pieces(batches, "text", PIECE_BYTES):
            raw, starts, ends, firsts = words = _joined_words(data, offsets)
            n = np.diff(firsts)
            keys = [xxhash.xxh3_128_digest(raw[starts[f] : ends[f + k - 1]] if k else b"") for f, k in zip(firsts[:-1].tolist(), n.tolist())]
            hashes = _shingle_hashes(words, SHINGLE)
            prints = [pa.array(p(*hashes).view(np.int64)) for p in (_majority, _second_majority)]
            kept = [rows.column(rows.schema.get_field_index(c)) for c in ("doc_id", "t1", "t2")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(keys, pa.binary()), pa.array(n, pa.int64()), *prints], names=["doc_id", "t1", "t2", "key", "n_words", "fp", "fp2"])

    narrow = docs.select("doc_id", "text", *text_key())
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, t1 bigint, t2 bigint, key binary, n_words bigint, fp bigint, fp2 bigint")


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """key and grams, the different shingles of WORDS words (64 bits each), of rows with key and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in at.pieces(batches, "text", PIECE_BYTES):
            hashes, count = _shingle_hashes(_joined_words(data, offsets), WORDS)
            own = [np.unique(x) for x in np.split(np.frombuffer(hashes, np.int64), np.cumsum(count)[:-1])]
            to = np.concatenate([[0], np.cumsum([x.size for x in own])]).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(to), pa.array(np.concatenate(own)))
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("key")), grams], names=["key", "grams"])

    return texts.select("key", "text").mapInArrow(run, "key binary, grams array<bigint>")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (key, leader) whose shingles are alike, by the whole sets."""
    mine = sets.select("key", F.col("grams").alias("a"))
    theirs = sets.select(F.col("key").alias("leader"), F.col("grams").alias("b"))
    least, of = ALIKE
    both = F.size(F.array_intersect("a", "b"))
    # shared / (a + b - shared) >= least / of, in whole numbers
    return pairs.join(mine, "key").join(theirs, "leader").where(both * (least + of) >= (F.size("a") + F.size("b")) * least)


def _candidate_groups(texts: DataFrame, distance: int) -> DataFrame:
    """fp and root: texts (fp, fp2) with links of either fingerprint between them have the same root.

    The second fingerprints' numbers are hashed, so that they are other nodes
    than the first ones'; should two of them be equal, groups that are only
    searched together become one. A text ties its two fingerprints where its
    second one has a link or is that of other texts.
    """
    other = lambda c: F.xxhash64(F.lit("second"), c)
    # each step has a small plan of its own: the driver holds, and tells anew with each stage, the whole plan of a job
    first = cut(fingerprint_links(cut(texts.select("fp").distinct()), distance))
    second = cut(fingerprint_links(cut(texts.select(F.col("fp2").alias("fp")).distinct()), distance))
    shared = texts.groupBy("fp2").agg((F.min("fp") != F.max("fp")).alias("several")).where("several").select("fp2")
    tied = second.select(F.col("u").alias("fp2")).unionByName(second.select(F.col("v").alias("fp2"))).unionByName(shared).distinct()
    ties = texts.join(tied, "fp2", "left_semi").select(F.col("fp").alias("u"), other("fp2").alias("v"))
    return components(first.unionByName(second.select(other("u").alias("u"), other("v").alias("v"))).unionByName(ties)).withColumnRenamed("node", "fp")


def near_copies(docs: DataFrame, distance: int = WIDE) -> DataFrame:
    """doc_id, t1 and t2 of the rows that go: the words of a row of a lesser doc_id, or a near copy of a row that stays.

    Texts of which either of two independent fingerprints is within `distance`
    bits are candidates only: with one fingerprint a pair at the similarity's
    bound is beyond them about once in twelve. In the order of doc_id (null
    last), a text stays unless it is alike with one that stays: so each that
    goes has a near copy that stays, and no two candidates that stay are alike.
    Components bound where candidates are looked for.
    """
    spark = docs.sparkSession
    rows = kept_table(_described(docs), "near-copies").where("n_words > 0")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    nodes = cut(rows.groupBy("key").agg(F.min(order).alias("first"), F.first("fp").alias("fp"), F.first("fp2").alias("fp2"), F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("n")))
    long = nodes.where(F.col("n_words") >= WORDS)
    grouped = long.join(_candidate_groups(long.select("fp", "fp2"), distance), "fp", "left").select("key", "fp", "fp2", F.coalesce("root", "fp").alias("root"), F.struct("first", "key").alias("place"))
    several = lambda pool: cut(pool.join(pool.groupBy("root").count().where("count > 1").select("root"), "root", "left_semi"))
    pool, gone, leaders = several(grouped), [], LEADERS
    if not pool.isEmpty():
        one = rows.join(pool.select("key"), "key", "left_semi").groupBy("key").agg(F.min(F.struct("t1", "t2")).alias("t")).select("key", "t.*")
        keyed = docs.select("text", *text_key()).join(one, ["t1", "t2"]).select("key", "text")
        sets = kept_table(_shingle_sets(keyed).dropDuplicates(["key"]), "near-copy-shingles")
    while not pool.isEmpty():
        # the first of each part first, so that a large group is not one task
        near = pool.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(64)))
        near = near.withColumn("nth", F.row_number().over(Window.partitionBy("root", "part").orderBy("place"))).where(F.col("nth") <= leaders)
        first = near.withColumn("nth", F.row_number().over(Window.partitionBy("root").orderBy("place"))).where(F.col("nth") <= leaders)
        first = cut(first.select("root", F.col("key").alias("leader"), F.col("fp").alias("leader_fp"), F.col("fp2").alias("leader_fp2"), F.col("place").alias("leader_place"), "nth"))
        close = F.least(*(F.bit_count(F.col(c).bitwiseXOR(F.col(f"leader_{c}"))) for c in ("fp", "fp2"))) <= distance
        pairs = pool.join(first, "root").where((F.col("leader_place") < F.col("place")) & close).select("root", "key", "leader", "nth")
        alike = cut(_alike(pairs, sets).select("root", "key", "leader", "nth"))
        # leaders in their order: one stays unless it is alike with one that stays
        own = alike.groupBy("key").agg(F.collect_list("nth").alias("near"))
        ranked = first.join(own.withColumnRenamed("key", "leader"), "leader", "left").select("root", F.struct("nth", F.coalesce("near", F.array().cast("array<int>")).alias("near")).alias("x"))
        chosen = F.expr("aggregate(array_sort(collect_list(x)), cast(array() as array<int>), (s, x) -> if(arrays_overlap(s, x.near), s, concat(s, array(x.nth))))")
        stay = ranked.groupBy("root").agg(chosen.alias("stay")).select("root", F.explode("stay").alias("nth"))
        out = cut(alike.join(stay, ["root", "nth"], "left_semi").select("key").distinct())
        gone.append(out)
        rest = pool.join(first.select(F.col("leader").alias("key")), "key", "left_anti").join(out, "key", "left_anti")
        pool, leaders = several(rest), leaders * LEADERS
    dropped = gone[0] if gone else spark.createDataFrame([], "key binary")
    for more in gone[1:]:
        dropped = dropped.unionByName(more)
    repeats = rows.join(nodes.where("n > 1").select("key", F.col("first.doc_id").alias("kept_id")), "key").where(~F.col("doc_id").eqNullSafe(F.col("kept_id")))
    return rows.join(dropped, "key", "left_semi").select("doc_id", "t1", "t2").unionByName(repeats.select("doc_id", "t1", "t2")).distinct()


def dedup_near_copies(docs: DataFrame, distance: int = WIDE) -> DataFrame:
    """The rows that are no near copies of a row that stays, with all their columns. Texts without words stay; texts under WORDS words go only for the same words; rows that repeat a doc_id and its words stay together."""
    gone = cut(near_copies(docs, distance)).select(F.col("doc_id").alias("gone"), F.col("t1").alias("g1"), F.col("t2").alias("g2"))
    t1, t2 = text_key()
    rows = packed(docs, doc_id=F.col("doc_id"), t1=t1, t2=t2)
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")) & (F.col("t1") == F.col("g1")) & (F.col("t2") == F.col("g2")), "left_anti").select("row.*")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
