import random
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lodestitch.llm import embeddings as em

ROWS = "vec_id bigint, embedding array<float>, label int"


def planted(n, seed=13, dim=24):
    """Random vectors, some of them moved a little, copied or scaled, chains among them."""
    rng = np.random.default_rng(seed)
    out = list(rng.normal(size=(n, dim)))
    for k in range(n // 3):
        base = out[rng.integers(len(out))]
        near = base / np.linalg.norm(base) + rng.normal(size=dim) / dim**0.5 * rng.choice([0.05, 0.2, 0.3, 0.35])
        out.append(near * rng.choice([0.5, 1, 3]))
        if k % 5 == 0:
            out.append(out[-1].copy())
    return [np.float32(x).tolist() for x in out]


def slow(rows):
    rows = [r for r in rows]
    good = [k for k, r in enumerate(rows) if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = {k: set() for k in range(len(rows))}
    for a in good:
        for b in good:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= em.COSINE:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for k, r in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for other in links[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        ids = [rows[s][0] for s in seen if rows[s][0] is not None]
        c = min(ids) if ids else None
        out.append((r[0], len(links[k]), c, r[0] == c))
    return out


key = lambda r: tuple((x is None, x) for x in r)


def test_query_equals_brute_force_and_its_sql(spark, tmp_path, monkeypatch):
    rows = [(k * 3 % 1009, v, k % 4) for k, v in enumerate(planted(500))] + [(5_000, None, 0), (5_001, [0.0] * 24, 0), (5_002, [float("nan")] * 24, 0), (5_003, [float("inf")] + [0.0] * 23, 0)]
    spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    want = sorted(slow(rows), key=key)
    got = sorted(map(tuple, em.op13_embeddings(spark, str(tmp_path)).collect()), key=key)
    assert got == want and sum(r[1] for r in want) > 200 and any(r[2] != r[0] and r[1] for r in want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.sql(em.OP13_SQL).fetchall(), key=key) == want


def test_many_lists_small_blocks_and_samples_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(em, "PER_LIST", 20)
    monkeypatch.setattr(em, "MEMBERS", 16)
    monkeypatch.setattr(em, "QUERIES", 32)
    hot = np.random.default_rng(1).normal(size=24)
    rows = [(k, v, 0) for k, v in enumerate(planted(400, 5))] + [(10_000 + k, np.float32(hot + np.random.default_rng(k).normal(size=24) * 0.1).tolist(), 0) for k in range(120)]
    rows += [(20_000 + k, np.float32(hot).tolist(), 0) for k in range(60)]
    docs = spark.createDataFrame(rows, ROWS)
    assert sorted((tuple(r)[1:] for r in em.near_vectors(docs).select("row", "n_links", "component_id", "kept").collect()), key=str) == sorted((r[1:] for r in slow(rows)), key=str)


def test_the_bound_of_probes_and_codes():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3_000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x + rng.normal(size=x.shape) * 0.07
    y /= np.linalg.norm(y, axis=1)[:, None]
    radius = np.sqrt(2 - 2 * em.COSINE)
    near = (x * y).sum(1) >= em.COSINE
    index = em.Index(x, 40)
    (home_x, gap_x), (home_y, gap_y) = index.to_planes(x), index.to_planes(y)
    at = np.arange(len(x))
    least = np.minimum(gap_x[at, home_y], gap_y[at, home_x])
    assert near.sum() > 500 and (home_x != home_y)[near].sum() > 100 and (least[near] <= radius / 2 + 1e-9).all()
    assert (gap_x > radius / 2).mean() > 0.3, "most lists need no probe"
    codes, error = index.code(y, home_y)
    for k in range(5):
        own = np.flatnonzero(home_y == k)
        member, query = index.near(x, k, codes[own], error[own], radius)
        passed = set(zip(own[member], query))
        want = {(j, i) for j in own for i in range(len(x)) if x[i] @ y[j] >= em.COSINE}
        assert want <= passed and len(passed) < 0.3 * len(own) * len(x)


def test_nulls_repeats_lengths_and_empty_tables(spark):
    rows = [(None, [1.0, 0.0], 1), (None, [2.0, 0.0], 2), (4, [1.0, 0.01], None), (4, [1.0, 0.01], None), (2, [0.0, 1.0], 0), (9, [1.0, None], 0), (8, [], 0), (7, [1.0, 0.0, 0.0], 0), (6, [-1.0, 0.0], 0), (None, None, 0)]
    docs = spark.createDataFrame(rows, ROWS).withColumnRenamed("label", "n_links")
    got = em.near_vectors(docs)
    assert sorted(((r.row.vec_id, r.n_links, r.component_id) for r in got.collect()), key=str) == sorted((r[:3] for r in slow(rows)), key=str)
    assert em.dedup_vectors(docs).columns == docs.columns and em.dedup_vectors(docs).where("vec_id = 4").count() == 2
    assert em.near_vectors(spark.createDataFrame([], ROWS)).count() == 0


@pytest.mark.parametrize("reach", [1.0, 0.5])
def test_recall(spark, reach, monkeypatch):
    monkeypatch.setattr(em, "PER_LIST", 30)
    rows = [(k, v, 0) for k, v in enumerate(planted(600, 9, 64))]
    random.Random(1).shuffle(rows)
    want = sum(r[1] for r in slow(rows))
    got = sum(r.n_links for r in em.near_vectors(spark.createDataFrame(rows, ROWS), reach=reach).collect())
    assert got == want if reach == 1 else 0.9 * want <= got <= want


def test_many_links_in_many_lists_take_bounded_memory():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    index = em.Index(x / np.linalg.norm(x, axis=1)[:, None], 200)
    hot = x[0] + rng.normal(size=(2_000, 16)) * 0.05
    unit = hot / np.linalg.norm(hot, axis=1)[:, None]
    home, gap = index.to_planes(unit)
    codes, error = index.code(unit, home)
    radius = np.sqrt(2 - 2 * em.COSINE)
    probes = (gap <= radius / 2 + em.SLACK) | (np.arange(200) == home[:, None])
    n = len(hot)
    rows = {"key": np.arange(n), "vector": hot.tolist(), "n": np.ones(n, np.int64), "home": home, "error": error, "code": [c.tobytes() for c in codes], "bits": [b.tobytes() for b in np.packbits(probes, 1)], "block": np.zeros(n, np.int64), "low": np.zeros(n, np.int64), "high": np.zeros(n, np.int64)}
    rows = pa.table(rows)
    tracemalloc.start()
    got = em.compare(rows, index, 16, em.COSINE, radius)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = (unit @ unit.T >= em.COSINE).sum(1) - 1
    assert want.sum() > 3_000_000 and peak < 100e6, "a number for each link and list were over 4 GB"
    found = dict(zip(got["u"].to_pylist(), got["n"].to_pylist())) | {u: m for u, v, m in zip(*(got[c].to_pylist() for c in "uvn")) if v is None}
    assert [found.get(k, 0) for k in range(n)] == want.tolist() and sum(v is not None for v in got["v"].to_pylist()) == n - 1


def test_a_vector_is_sent_once_for_each_pair_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(em, "PER_LIST", 10)
    sent = []
    blocks = em._in_blocks
    monkeypatch.setattr(em, "_in_blocks", lambda coded, lists, size: sent.append((coded.selectExpr("sum(size(probes))").first()[0], blocks(coded, lists, 80).cache())) or sent[-1][1])
    rows = [(k, np.float32(v).tolist(), 0) for k, v in enumerate(np.random.default_rng(4).normal(size=(640, 32)))]
    em.near_vectors(spark.createDataFrame(rows, ROWS), cosine=0.6).count()
    (probes, dealt), = sent
    assert dealt.count() == dealt.select("key", "low", "high").distinct().count() <= 640 * 9 < probes
    assert dealt.groupBy("low", "high").count().agg({"count": "max"}).first()[0] < 250
