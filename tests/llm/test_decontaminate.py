import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, documents, some_words, words

from lodestitch.llm import arrowtext as at
from lodestitch.llm import decontaminate as d


def _brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        x = words(t)
        n = min(window, len(x))
        for k in range(len(x) - n + 1) if x else []:
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[k : k + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def _case():
    rng = random.Random(4)
    items = [(n, some_words(rng, rng.choice([3, 9, 10, 11, 25]))) for n in range(12)] + [(77, None), (78, "..."), (5, some_words(rng, 12))]
    texts = [None, "", "...", some_words(rng, 3)]
    for _ in range(40):
        parts = [some_words(rng, rng.randint(0, 30)) for _ in range(3)]
        w = (rng.choice(items)[1] or "").split()
        a = rng.randint(0, max(0, len(w) - 5))
        parts.insert(rng.randint(0, 3), " - ".join(w[a : a + rng.randint(5, 25)]).upper() if rng.random() < 0.5 else ", ".join(w))
        texts.append(" ".join(parts))
    texts.append((some_words(rng, 200) + " ") * 200 + items[4][1])
    return items, texts


def test_query_equals_brute_force(spark, tmp_path):
    items, texts = _case()
    documents(spark, texts).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in d.op5_decontamination(spark, str(tmp_path)).collect()}
    seen = 0
    for n, t in enumerate(texts):
        n_words, n_hit, ids = _brute(t, items)
        r = got[n]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n_words, n_hit, len(ids), n_hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
        seen += n_hit > 0
    assert seen > 5
    left = {r.doc_id for r in d.remove_contaminated(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "benchmark.parquet"))).collect()}
    assert left == {n for n, r in got.items() if not r.contaminated}


def test_blocks_give_the_same_rows(spark):
    items, texts = _case()
    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")
    one = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in d.contamination(docs, bench).collect()}
    many = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in d.contamination(docs, bench, block_bytes=60).collect()}
    assert one == many


def test_repeated_and_null_ids_keep_a_row_each_in_blocks(spark):
    items, texts = _case()
    docs = documents(spark, texts).selectExpr("if(doc_id % 3 = 0, null, 7) as doc_id", "text")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = lambda **how: sorted(map(str, d.contamination(docs, bench, **how).collect()))
    assert rows() == rows(block_bytes=60) and len(rows()) == len(texts)
    whole = [len(ids) for ids, _ in d._benchmark_blocks(spark.createDataFrame([(1, "abcd"), (2, "abcd")], "i bigint, t string"), "i", "t", 4)]
    assert whole == [1, 1]


def test_suffix_array_is_sorted():
    rng = random.Random(5)
    texts = [some_words(rng, 40), "a a a a a a a a a a a a a a", "", *["b a b a b a b a"] * 5]
    data, offsets = at.text_bytes(pa.array(texts))
    found, firsts = d._words(data, offsets)
    assert [w.as_py().decode() for w in found] == [w for t in texts for w in words(t)] and np.diff(firsts).tolist() == [len(words(t)) for t in texts]
    coded = found.dictionary_encode()
    tokens = d._tokens(coded.indices.to_numpy().astype(np.int64), firsts, len(coded.dictionary))
    assert d.suffix_array(tokens).tolist() == sorted(range(tokens.size), key=lambda p: tokens[p:].tolist())


def test_words_are_compared_by_their_letters(spark):
    thue = "".join("ab"[bin(n).count("1") % 2] for n in range(1024))
    other = thue.translate({97: 98, 98: 97})
    got = d.contamination(documents(spark, [f"x {thue} y", f"x {other} y"]), spark.createDataFrame([(1, thue)], "item_id bigint, text string")).collect()
    assert {r.doc_id: r.n_hit for r in got} == {0: 1, 1: 0}


def test_sql_agrees(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    items, texts = _case()
    documents(spark, texts[:-1]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = d.op5_decontamination(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({d.OP5_SQL})").fetchall(), key=str)


def test_longest_matches(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [f"x {item} y", "y " + " ".join(item.split()[1:]) + " z", "nothing"]
    got = sorted(tuple(r) for r in d.longest_matches(documents(spark, rows), spark.createDataFrame([(9, item)], "item_id bigint, text string")).collect())
    assert got == [(0, "9", 1, 0, 12), (1, "9", 1, 1, 11)]


def test_edges(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    docs = documents(spark, ["a b c"]).withColumnRenamed("source", "n_words")
    assert d.remove_contaminated(docs.selectExpr("*", "1 as row", "2 as g1", "3 as t1"), bench).count() == 1
    assert [tuple(r)[1:3] for r in d.contamination(docs, bench).collect()] == [(3, 0)]
    assert d.contamination(spark.createDataFrame([], DOCS), bench).count() == 0
    nameless = spark.createDataFrame([(None, "a b")], "item_id bigint, text string")
    assert d.contamination(docs, nameless).first().item_ids == [""]
    with pytest.raises(ValueError):
        d.Suffixes([1], ["a"], 0)


@pytest.mark.parametrize("window", [1, 2, 3, 4, 10])
def test_runs_rule_out_only_what_is_absent(window):
    rng = random.Random(window)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 2, 3, 40, 90]))) for _ in range(30)]
    items = [" ".join(rng.choice("abcde") for _ in range(rng.choice([0, 1, 2, 3, 9, 30]))) for _ in range(40)] + [texts[k][:41] for k in range(9)]
    data, offsets = at.text_bytes(pa.array(texts))
    coded, firsts = d._words(data, offsets)
    coded = coded.dictionary_encode()
    tokens = d._tokens(coded.indices.to_numpy().astype(np.int64), firsts, len(coded.dictionary))
    block = d.Suffixes(list(range(len(items))), items, window)
    place, found = block.occurrences(coded.dictionary, tokens, d.suffix_array(tokens))
    got = sorted((int(p - firsts[t] - t), int(t), int(block.item[f]), int(block.at[f] - block.first[f])) for p, f, t in zip(place, found, np.searchsorted(firsts[1:] + np.arange(len(texts)), place)))
    want = []
    for t, w in enumerate(words(x) for x in texts):
        for i, x in enumerate(words(y) for y in items):
            n = min(window, len(x))
            want += [(p, t, i, k) for k in range(len(x) - n + 1) for p in range(len(w) - n + 1) if n and w[p : p + n] == x[k : k + n]]
    assert got == sorted(want) and want
    table = d.Grams(coded.dictionary, tokens)
    there = d._gram_codes(np.concatenate([d._word_codes(coded.dictionary), np.zeros(1, np.uint64)])[np.minimum(tokens, len(coded.dictionary))])
    assert not table.absent(there).any() and table.absent(d._word_codes(pa.array([f"word {k}" for k in range(500)]))).mean() > 0.9
