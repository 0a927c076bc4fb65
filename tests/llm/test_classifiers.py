import random
import zlib

import numpy as np
import pyarrow as pa
from helpers import DOCS, documents

from lodestitch.llm import arrowtext as at
from lodestitch.llm import language, quality

GOOD, BAD = ("river", "stone", "garden", "letter", "window"), ("cheap", "buy", "now", "click", "win")


def _labelled(spark, n=400):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(n):
        y = rng.random() < 0.7
        rows.append((k, " ".join(rng.choice(GOOD if y else BAD) + ("" if y else "!!") for _ in range(rng.randint(5, 60))), "en", "s", 0))
        labels.append((k, int(y), 0))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality_learns_and_scores_are_sparse_dot_products(spark, tmp_path):
    docs, labels = _labelled(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = quality.op6_quality(spark, str(tmp_path)).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and len(held) > 20
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    weights = quality.train(docs, labels)
    text = docs.where("doc_id = 3").first().text
    data, offsets = at.text_bytes(pa.array([text]))
    buckets, _ = quality.features(data, offsets)
    x = sum(float(weights[b]) for b in buckets) / len(buckets) ** 0.5 + float(weights[-1])
    assert abs(quality.score(docs.where("doc_id = 3"), weights).first().score - 1 / (1 + np.exp(-x))) < 1e-6


def test_held_out_labels_are_never_read(spark):
    docs, labels = _labelled(spark)
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality", "toxic")
    assert np.array_equal(quality.train(docs, labels), quality.train(docs, flipped))


def test_quality_edges(spark):
    docs = documents(spark, [None, "", "a", "word " * 100_000, "a"])
    none = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    weights = quality.train(docs, none)
    got = {r.doc_id: r.score for r in quality.score(docs.withColumnRenamed("lang", "score"), weights).collect()}
    assert got == dict.fromkeys(range(5), 0.5)
    assert quality.keep_quality(docs, weights).columns == docs.columns and quality.keep_quality(docs, weights).count() == 5
    assert quality.score(spark.createDataFrame([], DOCS), weights).count() == 0


def test_features_do_not_cross_texts():
    data, offsets = at.text_bytes(pa.array(["ab", "ab", None, "ab cd"]))
    buckets, text = quality.features(data, offsets)
    own = [sorted(buckets[text == k].tolist()) for k in range(4)]
    assert own[0] == own[1] and own[2] == [] and len(own[3]) == 3 and own[0][0] in own[3]


LANGS = {"xx": "aeblo", "yy": "ñokut", "zz": "ßzirm"}


def _spoken(spark, n=300):
    rng = random.Random(7)
    rows = []
    for k in range(n):
        lang = rng.choice(list(LANGS))
        rows.append((k, " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(2, 7))) for _ in range(30)), lang, "s", 0))
    return spark.createDataFrame(rows, DOCS)


def test_language_is_learned(spark, tmp_path):
    docs = _spoken(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = language.op10_language(spark, str(tmp_path)).join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and len(held) > 30
    assert all(r.lang_pred == r.lang for r in held) and all(0 <= r.score <= 1 for r in rows)


def test_filter_returns_all_languages_of_an_ngram():
    profiles = {"a": np.arange(1, 200, dtype=np.uint64), "b": np.arange(100, 300, dtype=np.uint64)}
    model = language.LanguageFilter(profiles)
    mask = model.containing(np.arange(1, 300, dtype=np.uint64))
    for code, m in zip(range(1, 300), mask.tolist()):
        assert (m & 1 or code >= 200) and (m & 2 or code < 100)  # no false negatives
    wrong = model.containing(np.arange(10_000, 60_000, dtype=np.uint64))
    assert (wrong != 0).mean() < 0.01


def test_language_edges(spark):
    model = language.train(_spoken(spark))
    docs = documents(spark, [None, "", "123 !?", "aeblo", "ñ", "aeblo " * 50_000, "日本語"]).withColumnRenamed("source", "lang_pred")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0)
    assert got[3][0] == got[5][0] == "xx" and got[6][0] in LANGS
    nothing = language.train(spark.createDataFrame([(1, "a", None, "s", 0)], DOCS))
    assert language.predict(docs, nothing).where("lang_pred != 'und'").count() == 0
    assert language.predict(spark.createDataFrame([], DOCS), model).count() == 0


def test_more_than_64_languages(spark):
    rows = []
    for n in range(70):
        own = " ".join(f"{chr(0x4E00 + 40 * n + k)}{chr(0x4E00 + 40 * n + k + 1)}" for k in range(30))
        rows += [(k + 100 * n, own, f"l{n:02}", "s", 0) for k in range(12)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.train(docs)
    assert len(model.languages) == 70 and len(model.words) == 2
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    assert got == {r[0]: r[2] for r in rows}


def test_ftrl_by_brute_force():
    """Each coordinate's update in plain Python, as McMahan and others (2013) write it."""
    rng = random.Random(3)
    bits, rows = 6, []
    texts = [" ".join(rng.choice(GOOD + BAD) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    labels = [rng.randint(0, 1) for _ in texts]
    z, n = [0.0] * (2**bits + 1), [0.0] * (2**bits + 1)
    m = quality.FTRL(bits)

    def weight(i):
        if abs(z[i]) <= m.l1:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * m.l1) / ((m.beta + n[i] ** 0.5) / m.alpha + m.l2)

    for text in texts:
        own, _ = quality.features(*at.text_bytes(pa.array([text])), bits)
        counts = {b: own.tolist().count(b) for b in own.tolist()}
        rows.append({b: c / len(own) ** 0.5 for b, c in counts.items()} | {2**bits: 1.0})
    for _ in range(3):
        for x, y in zip(rows, labels):
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / m.alpha * w[i]
                n[i] += g * g
    want = np.array([weight(i) for i in range(2**bits + 1)])
    got = quality.fit(pa.array(texts), labels, bits)
    assert np.allclose(got, want, atol=1e-6) and (np.abs(want) > 0.01).sum() > 20


def _grams(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return [int.from_bytes(bytes([k]) + raw[i : i + k], "big") for k in language.LENGTHS for i in range(len(raw) - k + 1)]


def test_language_profiles_and_decisions_by_brute_force(spark):
    """Profiles from plain counts of all n-grams, decisions from sets in the place of filters."""
    from collections import Counter

    rng = random.Random(8)
    signs = {"aa": "abcde ", "bb": "defgh ", "cc": "ghé日 "}
    rows = [(k, "".join(rng.choice(signs[lang]) for _ in range(rng.randint(5, 80))), lang, "s", 0) for k, lang in enumerate(rng.choice(sorted(signs)) for _ in range(150))]
    rows += [(900, None, "aa", "s", 0), (901, "", None, "s", 0), (902, "12 34", "bb", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    counts = {}
    for doc_id, text, lang, _, _ in rows:
        if lang and zlib.crc32(str(doc_id).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(_grams(text))
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    mean = {g: sum(r.get(g, 0) for r in rate.values()) / len(rate) for r in rate.values() for g in r}
    signed = lambda g: g - (1 << 64) if g >= 1 << 63 else g
    profiles = {lang: sorted((g for g in r if r[g] > mean[g] * (1 + 1e-12)), key=lambda g: (-r[g], signed(g)))[:200] for lang, r in rate.items()}
    model = language.train(docs, profile=200)
    want = language.LanguageFilter({lang: np.array(p, np.uint64) for lang, p in profiles.items()})
    assert model.languages == want.languages
    same = sum(int((a == b).sum()) for a, b in zip(model.words, want.words)) / sum(w.size for w in want.words)
    assert same > 0.99999, "but for ties of rates that differ in their last bits"
    sets = {lang: set(p) for lang, p in profiles.items()}
    agree = total = 0
    for r in language.predict(docs, model).collect():
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        if not text or not any(c.isalpha() for c in text):
            assert r.lang_pred == "und"
            continue
        grams = _grams(text)
        shares = {lang: sum(g in s for g in grams) / len(grams) for lang, s in sets.items()}
        best = max(shares.values())
        total += 1
        agree += shares[r.lang_pred] >= best - 0.02
        assert abs(r.score - shares[r.lang_pred] / max(sum(shares.values()), 1e-12)) < 0.05
    assert agree == total > 100
