"""Operator 13, embedding near-dedup by product quantisation.

Links are pairs of vectors whose cosine, in double precision, is at least COSINE.

Method. Vectors are scaled to length 1 and equal ones are one class, counted as
often as they stand. K-means on a bounded sample (SAMPLE classes, the least by
hash) gives the coarse centroids, and for each of PARTS subspaces CODES residual
centroids. Each class gets a home list (its nearest centroid), a residual code of
one byte a subspace, and the error of that code.

Probes. A link means a distance of at most r = sqrt(2 - 2 COSINE). Two linked
vectors of different lists lie on both sides of the plane between these lists'
centroids, so their distances to it sum to r at most and one of them is at most
r / 2. Each vector probes all lists to whose plane it is that near: of every link
at least one side finds the other, whatever the number of lists. Where both would,
the side that is probed leaves the count to the other's own probe. `reach` (1:
this bound) can be lowered, for fewer probes at some loss.

Distances. In a list, the table of squared distances from a query's residual to
the residual centroids is made once a query, and a code's distance is the sum of
PARTS looked-up numbers. It can be off by the code's own error, so what is beyond
r plus that error is no link, and the rest is ranked again by exact cosine. No
link is lost by codes; recall against brute force is 1 (a test).

Blocks: vectors in the order of their lists are dealt to blocks of bounded size (a
list of many vectors to several), and each task takes one pair of blocks of which
one probes a list of the other: a vector is sent once for each such pair, not once
for each list that it probes. In a task, queries and members are compared a bounded
number of pairs at a time, so memory does not grow with the lists, their number or
the links. A task emits counts and a spanning forest of its links, never all pairs;
components come from alternating stars.

Rows: vectors that are null, empty or zero, or hold null, NaN or infinite
components link with nothing; vectors of other lengths than most of the sample
are compared among themselves, by a pass of their own length. Every row gets one
row. A null vec_id is in a component but never names it, unless no other id is
there. Any other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .simhash import components
from .tables import kept_table, packed, table

COSINE = 0.95
SAMPLE = 16_384
#: Centroids of a coarse list each so many classes, between the least and the most number of lists.
PER_LIST, LEAST_LISTS, MOST_LISTS = 1_024, 8, 1_024
PARTS, CODES, ROUNDS = 8, 256, 8
#: A block holds MEMBERS vectors at least, else 1 / BLOCKS of all, of COMPONENTS numbers in all at most; QUERIES are compared at a time, with as many members as give PAIRS.
MEMBERS, BLOCKS, COMPONENTS = 1_024, 16, 1 << 20
QUERIES, PAIRS = 2_048, 1 << 19
#: More than the rounding of float tables, of squared distances between unit vectors.
SLACK = 1e-4


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 13) -> np.ndarray:
    """At most k centroids of the rows of x; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to each row of y."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T), 0)


def nearest(x: np.ndarray, centres: np.ndarray, block: int = 4_096) -> np.ndarray:
    return np.concatenate([squares(x[i : i + block], centres).argmin(1) for i in range(0, len(x), block)] or [np.zeros(0, np.int64)])


class Index:
    """Coarse centroids and residual codebooks."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int = PARTS, codes: int = CODES):
        self.centres = kmeans(sample, lists)
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.parts = [p for p in np.array_split(np.arange(sample.shape[1]), parts) if p.size]
        self.books = [kmeans(rest[:, p], codes) for p in self.parts]
        self.apart = np.sqrt(squares(self.centres, self.centres))

    def code(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A byte for each subspace, and the distance of the vector to what the code stands for."""
        rest = x - self.centres[home]
        codes = np.stack([nearest(rest[:, p], book) for p, book in zip(self.parts, self.books)], 1).astype(np.uint8)
        error = sum(((rest[:, p] - book[codes[:, k]]) ** 2).sum(1) for k, (p, book) in enumerate(zip(self.parts, self.books)))
        return codes, np.sqrt(error)

    def to_planes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home list, and each vector's distance to the plane between its home's centroid and each other's; at its home 0."""
        far = squares(x, self.centres)
        home = far.argmin(1)
        apart = self.apart[home]
        gap = (far - far[np.arange(len(x)), home][:, None]) / np.where(apart > 0, 2 * apart, 1)
        return home, np.where(apart > 0, gap, 0.0)

    def tables(self, x: np.ndarray, at: int) -> list[np.ndarray]:
        """For each subspace, squared distances of its residual centroids (rows) to the queries' residuals in list `at` (columns)."""
        rest = x - self.centres[at]
        return [squares(book, rest[:, p]).astype(np.float32) for p, book in zip(self.parts, self.books)]

    def near(self, x: np.ndarray, at: int, codes: np.ndarray, error: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (member, query) of a list that can be within the radius, by table look-up."""
        return looked_up(self.tables(x, at), codes, error, radius)


def looked_up(tables: list[np.ndarray], codes: np.ndarray, error: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros((len(codes), tables[0].shape[1]), np.float32)
    for k, own in enumerate(tables):
        total += own[codes[:, k]]
    return np.nonzero(total <= ((radius + error) ** 2 + SLACK).astype(np.float32)[:, None])


def unit_vectors(column: pa.Array, length: int) -> np.ndarray:
    """Rows of length 1; all components are finite and not all are zero."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), length)
    x = x / np.abs(x).max(1, initial=0.0)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def classes(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """key, h1, h2, vector, length, id (the least) and n of each different vector that can link, stored."""
    floats = vectors.schema[vector].dataType.simpleString() == "array<float>"
    x = F.col(vector) if floats else F.col(vector).cast("array<double>")
    usable = F.exists(x, lambda v: v != 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    told = vectors.select(F.col(vec_id).alias("id"), x.alias("vector")).where(F.coalesce(usable, F.lit(False))).select("id", "vector", *_hashes("vector"))
    one = told.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))
    return kept_table(one.select(F.monotonically_increasing_id().alias("key"), "h1", "h2", "vector", F.size("vector").alias("length"), "id", "n"), "vectors")


def _hashes(vector: str) -> list:
    """128 bits that stand for a vector."""
    x = F.col(vector).cast("array<double>")
    return [F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("vector"), x).alias("h2")]


def fit(nodes: DataFrame, length: int, n: int, sample: int = SAMPLE) -> Index:
    """An index from the classes of the least hashes; a bounded number of rows comes to the driver."""
    rows = nodes.orderBy("h1", "h2").limit(sample).select("vector").toArrow()
    lists = int(np.clip(n // PER_LIST, LEAST_LISTS, MOST_LISTS))
    return Index(unit_vectors(rows.column(0).combine_chunks(), length), lists)


class Forest:
    """Joins nodes 0 to n - 1 by links, some at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Positions of links that connect all that the links connect, of which no root was connected before."""
        kept, at = [np.zeros(0, np.int64)], np.arange(len(u))
        while True:
            a, b = self.root[u[at]], self.root[v[at]]
            open_ = a != b
            if not open_.any():
                return np.concatenate(kept)
            at, a, b = at[open_], a[open_], b[open_]
            # each root but the least of its neighbours is hung below its least neighbour
            pairs, first = np.unique(np.maximum(a, b) * len(self.root) + np.minimum(a, b), return_index=True)
            high, least = np.unique(pairs // len(self.root), return_index=True)
            kept.append(at[first[least]])
            up = np.arange(len(self.root))
            up[high] = pairs[least] % len(self.root)
            while (up[up] != up).any():
                up = up[up]
            self.root = up[self.root]


def compare(rows: pa.Table, index: Index, length: int, cosine: float, radius: float) -> pa.Table:
    """u, v and n (see _links_of_length) of the rows of a pair of blocks."""
    x = unit_vectors(rows.column("vector").combine_chunks(), length)
    key, n, home, error, block = (rows.column(c).to_numpy() for c in ("key", "n", "home", "error", "block"))
    codes, bits = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint8).reshape(len(x), -1) for c in ("code", "bits"))
    probes = np.unpackbits(bits, 1, len(index.centres)).view(bool)
    low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
    found, forest, kept = np.zeros(len(x), np.int64), Forest(len(x)), []

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Members and the queries that can be near."""
        for ours, theirs in {(low, high), (high, low)}:
            for at in np.unique(home[block == ours]).tolist():
                members, queries = np.flatnonzero((block == ours) & (home == at)), np.flatnonzero((block == theirs) & probes[:, at])
                for q in (queries[k : k + QUERIES] for k in range(0, len(queries), QUERIES)):
                    tables, step = index.tables(x[q], at), max(1, PAIRS // len(q))
                    for m in (members[k : k + step] for k in range(0, len(members), step)):
                        j, i = looked_up(tables, codes[m], error[m], radius)
                        yield m[j], q[i]

    step = max(1, COMPONENTS // length)
    for j, i in ((j[k : k + step], i[k : k + step]) for j, i in pairs() for k in range(0, len(j), step)):
        near = (j != i) & ((x[i] * x[j]).sum(1) >= cosine)
        j, i = j[near], i[near]
        np.add.at(found, i, n[j])
        # a member that probes the query's home counts the link there
        own = probes[j, home[i]]
        np.add.at(found, j[~own], n[i[~own]])
        some = forest.add(i, j)
        kept.append((key[i[some]], key[j[some]]))
    u, v = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*kept) if kept else ((), ())))
    some = found > 0
    counted = [key[some], np.full(some.sum(), -1), found[some]]
    u, v, n = (np.concatenate(c).astype(np.int64) for c in zip(counted, (u, v, np.zeros(len(u), np.int64))))
    return pa.table({"u": u, "v": pa.array(v, mask=v < 0), "n": n})


def _links_of_length(nodes: DataFrame, length: int, n: int, cosine: float, reach: float) -> DataFrame:
    """u, v and n of classes of one length: n copies of others that u links to (v null), or a link of a spanning forest (n 0)."""
    spark = nodes.sparkSession
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    index = fit(nodes, length, n)
    sent = spark.sparkContext.broadcast(index)
    n_lists, most = len(index.centres), reach * radius / 2 + SLACK
    vector = nodes.schema["vector"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, step = sent.value, max(1, PAIRS // n_lists)
        for batch in (batch.slice(k, step) for batch in batches for k in range(0, batch.num_rows, step)):
            x = unit_vectors(batch.column(1), length)
            home, gap = index.to_planes(x)
            codes, error = index.code(x, home)
            probes = gap <= most
            probes[np.arange(len(x)), home] = True
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(probes.sum(1))), pa.int32()), pa.array(np.nonzero(probes)[1], pa.int32()))
            bits, codes = (pa.array([c.tobytes() for c in a], pa.binary()) for a in (np.packbits(probes, 1), codes))
            told = [batch.column(0), batch.column(1), batch.column(2), pa.array(home, pa.int32()), codes, pa.array(error), bits, lists]
            yield pa.RecordBatch.from_arrays(told, names=["key", "vector", "n", "home", "code", "error", "bits", "probes"])

    coded = kept_table(nodes.select("key", "vector", "n").mapInArrow(place, f"key bigint, vector {vector}, n bigint, home int, code binary, error double, bits binary, probes array<int>"), "codes")
    dealt = _in_blocks(coded, n_lists, max(MEMBERS, min(n // BLOCKS, COMPONENTS // length)))

    return dealt.groupBy("low", "high").applyInArrow(lambda rows: compare(rows, sent.value, length, cosine, radius), "u bigint, v bigint, n bigint")


def _in_blocks(coded: DataFrame, n_lists: int, size: int) -> DataFrame:
    """The rows with their block of some `size` rows, once for each pair (low, high) of it and a block that it probes or that probes its list."""
    held = dict(map(tuple, coded.groupBy("home").count().collect()))  # a row for each list, MOST_LISTS at most
    counts = [held.get(k, 0) for k in range(n_lists)]
    starts = np.cumsum([0, *counts])[:-1].tolist()
    # a row's place in its list by its hash, of so many places
    grain = 1 << 20
    lasts = [(s * grain + c * (grain - 1)) // (size * grain) for s, c in zip(starts, counts)]
    spans = coded.sparkSession.createDataFrame([(counts, starts, [s // size for s in starts], lasts)], "counts array<bigint>, starts array<bigint>, firsts array<bigint>, lasts array<bigint>")
    at = F.get("starts", F.col("home")) * grain + F.get("counts", F.col("home")) * F.pmod(F.xxhash64("key"), F.lit(grain))
    placed = coded.crossJoin(F.broadcast(spans)).withColumn("at", at).withColumn("block", F.expr(f"at div {size * grain}"))
    asked = placed.select("block", F.explode("probes").alias("home")).groupBy("home").agg(F.collect_set("block").alias("askers"))
    probed = F.flatten(F.transform("probes", lambda k: F.when(F.get("counts", k) > 0, F.sequence(F.get("firsts", k), F.get("lasts", k))).otherwise(F.array().cast("array<bigint>"))))
    other = F.explode(F.array_union(probed, "askers")).alias("other")
    met = placed.join(F.broadcast(kept_table(asked, "askers")), "home").select("key", "vector", "n", "home", "code", "error", "bits", "block", other)
    return met.select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).drop("other")


def linked(nodes: DataFrame, cosine: float = COSINE, reach: float = 1.0) -> DataFrame:
    """u, v and n of all classes (see _links_of_length), by the vectors' length: a pass for each length that there is."""
    lengths = nodes.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()
    out = nodes.sparkSession.createDataFrame([], "u bigint, v bigint, n bigint")
    for row in lengths:
        out = out.unionByName(_links_of_length(nodes.where(F.col("length") == row.length), row.length, row.n, cosine, reach))
    return kept_table(out, "links")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, vector: str = "embedding", vec_id: str = "vec_id", reach: float = 1.0) -> DataFrame:
    """row (the input row), n_links, component_id and kept of every row."""
    nodes = classes(vectors, vector, vec_id)
    links = linked(nodes, cosine, reach)
    counts = links.where("v is null").groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("others"))
    roots = components(links.where("v is not null").select("u", "v"))
    grouped = roots.join(nodes.select(F.col("key").alias("node"), "id"), "node").groupBy("root").agg(F.min("id").alias("component"))
    named = roots.join(grouped, "root").select(F.col("node").alias("key"), "component")
    told = nodes.join(counts, "key", "left").join(named, "key", "left").select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    rows = packed(vectors, vec_id=F.col(vec_id), vector=F.col(vector).cast("array<double>"))
    joined = rows.select("row", "vec_id", *(h.alias(f"__{n}") for n, h in zip(("h1", "h2"), _hashes("vector")))).join(told, ["__h1", "__h2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("row", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def dedup_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """The rows that stay: of each component that of its id."""
    return near_vectors(vectors, cosine).where("kept").select("row.*")


def op13_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("row.vec_id", "n_links", "component_id", "kept")


OP13_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS MATERIALIZED (
  SELECT vec_id, x FROM v
  WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS s, b.vec_id AS t FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= {COSINE}),
reached AS (
  SELECT vec_id, vec_id AS other FROM v
  UNION
  SELECT r.vec_id, l.t FROM reached r JOIN links l ON l.s = r.other)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.s = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id) c USING (vec_id)
"""
