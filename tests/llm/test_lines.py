import random

from helpers import DOCS, documents, edit_distance, some_words

from lodestitch.llm import lines


def test_automaton_is_the_edit_distance(spark):
    rng = random.Random(1)
    rows = [("", ""), ("", "ab"), ("ab", ""), ("abc", "abc")]
    for _ in range(300):
        a = [rng.choice("abñ") for _ in range(rng.randint(0, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b = rng.choice([b[:at] + [rng.choice("abñ")] + b[at:], b[:at] + b[at + 1 :], b[:at] + [rng.choice("abñ")] + b[at + 1 :]])
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "x string, y string")
    for k in (1, 2, 3):
        for r in df.select("x", "y", lines.within_edits("x", "y", k).alias("v")).collect():
            assert bool(r.v) == (edit_distance(r.x, r.y) <= k), (r, k)


def _allowed(x, y, edits=2, per=5):
    return min(edits, min(len(x), len(y)) // per)


def _brute(texts):
    first = {}
    for d, t in enumerate(texts):
        for p, x in enumerate(t.split("\n") if t is not None else []):
            first.setdefault(x, (d, p))
    near = {x: [y for y in first if y != x and abs(len(x) - len(y)) <= 2 and edit_distance(x, y) <= _allowed(x, y)] for x in first}
    out = {}
    for d, t in enumerate(texts):
        own = list(enumerate(t.split("\n"))) if t is not None else []
        exact = [(d, p) > first[x] for p, x in own]
        close = [any(first[y] < first[x] for y in near[x]) for _, x in own]
        out[d] = (len(own), sum(exact), sum(c and not e for e, c in zip(exact, close)), sum(len(near[x]) for _, x in own), "\n".join(x for (_, x), e, c in zip(own, exact, close) if not e and not c))
    return out


def _texts():
    rng = random.Random(2)
    base = [some_words(rng, 10) for _ in range(6)]
    texts = [None, "", "\n\n", base[0], f"{base[0]}\n{base[0]}"]
    for _ in range(60):  # a group of near lines that is larger than HOT
        x = rng.choice(base)
        at = rng.randrange(len(x))
        texts.append("\n".join([rng.choice(base), x[:at] + rng.choice("xyz") + x[at + rng.randint(0, 1) :], "short", "shore", "ab", "ac", f"line {rng.randint(0, 99)}", f"No. {rng.randint(0, 9999)} of all"]))
    texts.append(" ".join(base) * 60)
    return texts


def test_decisions_and_texts_equal_brute_force(spark, tmp_path):
    texts = _texts()
    want = _brute(texts)
    documents(spark, texts).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_lines, r.n_exact, r.n_near, r.n_links) for r in lines.op1_lines(spark, str(tmp_path)).collect()}
    assert got == {d: w[:4] for d, w in want.items()}
    kept = {r.doc_id: (r.text, r.n_chars) for r in lines.dedup_lines(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()}
    for d, t in enumerate(texts):
        if t is None:
            assert kept[d] == (None, None)
        elif want[d][4] or want[d][1] + want[d][2] < want[d][0]:
            assert kept[d] == (want[d][4], len(want[d][4]))
        else:
            assert d not in kept


def test_hot_limit_changes_nothing(spark):
    docs = documents(spark, _texts())
    pairs = lambda hot, many: {frozenset(r) for r in lines.near_pairs(docs, hot=hot, many=many).collect()}
    assert pairs(1, 1) == pairs(2, 10_000) == pairs(10_000, 10_000) != set()


def test_lines_that_differ_in_digits_only(spark):
    rng = random.Random(3)
    made = sorted({f"order {rng.randint(0, 10**8):08d} has left the house, on its way" for _ in range(20_000)})
    docs = documents(spark, ["\n".join(made[n::4]) for n in range(4)])
    candidates = lines.candidate_pairs(docs).count()
    pairs = {frozenset(r) for r in lines.near_pairs(docs).collect()}
    assert candidates < 20 * len(made)  # of 200,000,000 pairs
    for x in made[::1000]:
        want = {y for y in made if y != x and sum(a != b for a, b in zip(x, y)) <= 4 and edit_distance(x[6:14], y[6:14]) <= 2}
        assert {y for p in pairs if x in p for y in p} - {x} == want


def test_templates_of_all_kinds_equal_brute_force(spark):
    rng = random.Random(4)
    made = {"x" * 9 + str(n % 10) + "y" * (n % 3) for n in range(40)}
    made |= {f"{rng.choice(['the', 'a', 'no'])} {rng.randint(0, 30)} came by the road to {rng.randint(0, 30)} and {rng.choice('abc')} stayed there" for _ in range(250)}
    made |= {f"{rng.randint(0, 99999)} {'z' * rng.randint(20, 22)}" for _ in range(150)}
    made = sorted(made)
    got = {frozenset(r) for r in lines.near_pairs(documents(spark, ["\n".join(made)]), hot=2, many=2).collect()}
    assert got == {frozenset((x, y)) for n, x in enumerate(made) for y in made[:n] if abs(len(x) - len(y)) <= 2 and edit_distance(x, y) <= _allowed(x, y)}


def test_ids_of_other_types_and_our_own_names(spark):
    rows = [("b", "same line\nother words", 1, 2, 3), ("a", "same line", 4, 5, 6), (None, "other words", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, __gone int, __id int, row int")
    got = sorted(map(tuple, lines.dedup_lines(docs).collect()))
    assert got == [("a", "same line", 4, 5, 6), ("b", "other words", 1, 2, 3)]


def test_empty_null_ids_and_clashing_columns(spark):
    assert lines.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
    rows = spark.createDataFrame([(None, "a\nb", 1, "k"), (1, "a", 2, "k"), (1, "c", 3, "k")], "doc_id bigint, text string, pos int, line string")
    got = {(r.doc_id, r.text, r.pos) for r in lines.dedup_lines(rows).collect()}
    assert (None, "b", 1) in got and (1, "a", 2) in got


def test_rows_of_one_id_lose_their_own_lines_only(spark):
    texts = ["alpha\nrepeated line", "beta\nrepeated line", "gamma\nunique line", "delta", "delta\nrepeated line"]
    for doc_id in (None, 3):
        rows = [(1, "first\nof all", "en", "s", 0), *((doc_id, t, "en", "s", len(t)) for t in texts), (doc_id, None, "en", "s", None), (doc_id, texts[2], "en", "s", 0), (9, "unique line", "en", "s", 0)]
        got = [r.text for r in lines.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(3)).collect()]
        kept = sorted(x for t in got if t is not None for x in t.split("\n"))
        assert kept == sorted(["first", "of all", "alpha", "beta", "gamma", "delta", "repeated line", "unique line"])
        assert got.count(None) == 1
