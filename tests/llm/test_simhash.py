import random

import numpy as np
import xxhash
from helpers import DOCS, LOWER, documents, some_words
from pyspark.sql import functions as F

from lodestitch.llm import simhash


def _print(text, n=3):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    grams = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(prints, distance=3):
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in prints}


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(10)
    texts = [None, "", " \t\n", "One", "one  TWO", "One Two\u00a0three", "é\x1cx y z"]
    for _ in range(12):
        base = some_words(rng, 300).split()
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = some_words(rng, 1)
            texts.append(" ".join(own))
    texts.append(some_words(rng, 40_000))
    documents(spark, texts).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9_simhash(spark, str(tmp_path)).collect()}
    prints = {d: _print(t) for d, t in enumerate(texts)}
    roots = _groups(prints)
    assert got == {d: (f"{p:016x}", roots[d]) for d, p in prints.items()}
    assert len(set(roots.values())) < len(texts) - 10
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.doc_id for r in simhash.dedup_documents(docs, distance=3).collect()) == sorted(set(roots.values()))
    wide = set(_groups(prints, simhash.WIDE).values())
    assert sorted(r.doc_id for r in simhash.dedup_documents(docs).collect()) == sorted(wide) and len(wide) < len(set(roots.values()))


def _nodes(spark, prints):
    return spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint").distinct()


def test_small_buckets_and_correlated_bits_lose_no_link(spark):
    rng = random.Random(11)
    centre = [rng.getrandbits(64) for _ in range(3)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centre for _ in range(150)}
    prints |= {rng.getrandbits(20) * 0x100001 & (1 << 64) - 1 for _ in range(100)}
    nodes = _nodes(spark, prints)
    links = simhash.fingerprint_links(nodes, bucket=8)
    got = {r.node & (1 << 64) - 1: r.root for r in simhash.components(links).collect()}
    want = _groups({p: p for p in prints})
    by_root = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    assert by_root(got) == [g for g in by_root(want) if len(g) > 1]


def test_wide_distances_lose_no_link(spark):
    rng = random.Random(13)
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(4, 9))) for c in (0, (1 << 64) - 1, 0x0F0F0F0F0F0F0F0F) for _ in range(40)} | {rng.getrandbits(64) for _ in range(60)}
    for distance in (5, 9):
        for bucket in (4096, 6):
            got = {r.node & (1 << 64) - 1: r.root for r in simhash.components(simhash.fingerprint_links(_nodes(spark, prints), distance, bucket=bucket)).collect()}
            want = _groups({p: p for p in prints}, distance)
            assert len(got) == sum(list(want.values()).count(r) > 1 for r in want.values())
            assert len(set(got.values())) == len({r for r in want.values() if list(want.values()).count(r) > 1})


def test_allocation():
    assert sum(t + 1 for t in simhash.allocate([[0, 5, 9, 20, 50]] * 4, 3)) == 4
    assert simhash.allocate([[0, 100, 200, 300, 400], [0, 1, 2, 3, 4]], 3) == [-1, 3]
    values = np.array([3, 1, 0, 2])
    brute = [sum(int(values[a]) * int(values[b]) for a in range(4) for b in range(4) if (a ^ b).bit_count() <= t) for t in range(3)]
    assert simhash.candidate_counts(values, 2) == brute


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (2, 1)] + [(k, k + 1) for k in range(100, 140)], "u bigint, v bigint")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 4), 1), **dict.fromkeys((7, 8, 9), 7), **dict.fromkeys(range(100, 141), 100)}
    assert simhash.components(edges.where("u > 1000")).count() == 0


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d", 1), (5, "a b c d", 2), (5, "a b c d", 3), (None, "q", 4)], "doc_id bigint, text string, fp int")
    rows = simhash.near_duplicates(docs).orderBy(F.col("doc_id").isNull(), "fp").collect()
    assert sorted(str(r.component_id) for r in rows) == ["5", "5", "5", "None"]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def _alike(a, b, n=5):
    a, b = ({tuple(t.lower().split()[k : k + n]) for k in range(len(t.split()) - n + 1)} for t in (a, b))
    return bool(a) and bool(b) and len(a & b) / len(a | b) >= 0.8


def _second_print(text):
    """The majority bits under hashes derived from the first ones, by whole numbers."""
    words, least = (text or "").translate(LOWER).split(), (1 << 64) - 1
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for gram in grams:
        h = int.from_bytes(xxhash.xxh64_digest(gram.encode(), 42), "little") * 0x9E3779B97F4A7C15 + 1 & least
        h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 & least
        h = int.from_bytes((h ^ h >> 29).to_bytes(8, "little"), "big")
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(grams))


def test_near_copies_at_the_bound_are_found(spark):
    """Pairs of 0.8 and a little more, by a passage or by words here and there: at least 0.95 of them."""
    rng, texts = random.Random(21), []
    for k in range(300):
        base = some_words(rng, rng.randint(80, 300)).split()
        own = list(base)
        while True:
            trial = list(own)
            if k % 2:  # one word more, anywhere
                trial[rng.randrange(len(trial))] = some_words(rng, 1) + "q"
            else:  # a passage at the end that grows
                trial.append(some_words(rng, 1) + "q")
            if not _alike(" ".join(base), " ".join(trial)):
                break
            own = trial
        texts += [" ".join(base), " ".join(own)]
    stay = {r.doc_id for r in simhash.dedup_near_copies(documents(spark, texts).repartition(4)).collect()}
    assert stay >= set(range(0, 600, 2))
    assert 600 - len(stay) >= 0.95 * 300


def test_near_copies_are_verified(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEADERS", 2)
    rng = random.Random(14)
    texts = [None, "", " ", None, "ab cd", "Ab  CD", "ab ce", "a b c d", "b c d e"]
    for _ in range(4):
        base = some_words(rng, 60).split()
        for _ in range(12):  # many within WIDE bits, of which only some are alike
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = some_words(rng, 1)
            texts.append(" ".join(own))
    texts += [some_words(rng, k % 4 + 1) for k in range(200)]  # sparse fingerprints
    got = {r.doc_id for r in simhash.dedup_near_copies(documents(spark, texts).repartition(3)).collect()}
    prints, seconds, kept, same = {d: _print(t) for d, t in enumerate(texts)}, {d: _second_print(t) for d, t in enumerate(texts)}, [], set()
    for d, t in enumerate(texts):
        words = tuple((t or "").lower().split())
        if not words:
            kept.append(d)
        elif words not in same and not any(min((p[d] ^ p[k]).bit_count() for p in (prints, seconds)) <= simhash.WIDE and _alike(t, texts[k] or "") for k in kept):
            kept.append(d)
        same.add(words)
    assert got == set(kept)
    assert len([d for d in kept if 9 <= d < 57]) not in (4, 48)  # some are alike, and not all
    lost = {r.doc_id for r in simhash.dedup_documents(documents(spark, texts)).collect()}
    assert not {0, 1, 2, 3} <= lost  # fingerprints alone join texts without words
    rows = spark.createDataFrame([(None, texts[10], 1), (None, texts[30], 2), (7, texts[10], 3), (7, texts[50], 4)], "doc_id bigint, text string, fp int")
    assert {r.fp for r in simhash.dedup_near_copies(rows).collect()} == {2, 3, 4}
    assert simhash.dedup_near_copies(spark.createDataFrame([], DOCS)).count() == 0


def test_our_own_names_do_not_clash(spark):
    from lodestitch.llm import simhash

    text = " ".join(f"word{n}" for n in range(60))
    docs = spark.createDataFrame([(1, text, 4, 5, 6), (2, text, 7, 8, 9)], "doc_id bigint, text string, __id int, row int, gone int")
    assert [tuple(r) for r in simhash.dedup_near_copies(docs).collect()] == [(1, text, 4, 5, 6)]
    assert [tuple(r) for r in simhash.dedup_documents(docs).collect()] == [(1, text, 4, 5, 6)]


def test_keys_are_made_in_one_reading_of_the_fingerprints(spark):
    prints = [0, 5, 2**63 - 1, 256 - 2**63]
    nodes = spark.createDataFrame([(f,) for f in prints], "fp bigint")
    plan = [(list(range(16 * i, 16 * i + 16)), t) for i, t in enumerate((2, 1, 0, -1))]
    keys = simhash._keys(nodes, plan)
    assert "Union" not in keys._jdf.queryExecution().toString()
    got = keys.collect()
    assert len(got) == len({(r.key, r.fp) for r in got}) == len(prints) * (17 + 17 + 1)
    assert {r.used for r in got} == {0, 0xFFFF << 32}
    # a key is that of a part's value, and each row has those of all neighbours
    by = {}
    for r in got:
        by.setdefault(r.key, set()).add(r.fp)
    assert {frozenset(v) for v in by.values() if len(v) > 1} >= {frozenset({0, 5})}
