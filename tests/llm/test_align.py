import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import DOCS, documents

from lodestitch.llm import align

RANDOM = random.Random(11)


@pytest.fixture(scope="module")
def tokenizers():
    with open(f"{align.TOKENIZERS}/{align.BYTE_BPE}", encoding="utf-8") as one, open(f"{align.TOKENIZERS}/{align.PIECE_BPE}", "rb") as two:
        return align.Tokenizers(one.read(), two.read())


def odd_texts(n=40):
    letters = ["a", "the ", " ", "  ", "ß", "é", "日本", "🙂", "\n", "\t", "don't", "I'll", "123", "ﬁ", "​", "<s>", "<|endoftext|>", "x́", "▁", "Über", "...", "\x00"]
    return ["".join(RANDOM.choice(letters) for _ in range(RANDOM.randint(1, 60))) for _ in range(n)]


def slow_alignment(t, text):
    """Spans of all tokens of the whole text, compared one with another."""
    none = [], [], [], []
    if not text:
        return none
    raw = f" {text}".encode()
    a, b = t.a.encode(f" {text}", add_special_tokens=False).ids, t.b.encode(text)
    if b"".join(t.a_bytes[x] for x in a) != raw or b"".join(t.b_bytes[x] for x in b) != raw:
        return none
    spans = []
    for ids, own in ((a, t.a_bytes), (b, t.b_bytes)):
        at, out = 0, []
        for x in ids:
            out.append((at, at + len(own[x]), x))
            at += len(own[x])
        spans.append(out)
    links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
    cuts = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
    groups = [([x[2] for x in spans[0] if s < x[1] <= e], [y[2] for y in spans[1] if s < y[1] <= e]) for s, e in zip([0, *cuts], cuts)]
    return a, b, links, groups


def slow_rows(t, texts):
    told = [slow_alignment(t, x) for x in texts]
    docs = Counter(p for x in told for p in set(x[2]))
    most = {}
    for (a, _), n in docs.items():
        most[a] = max(most.get(a, 0), n)
    digest = lambda groups: hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else ""
    return [(len(a), len(b), len(g), len(k), sum(docs[p] == most[p[0]] for p in k), sum(docs[p] for p in k), digest(g)) for a, b, k, g in told]


def test_query_equals_brute_force(spark, tokenizers, tmp_path):
    texts = [None, "", " ", "a", "hello world", "hello world", "wordword " * 50, *odd_texts()]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(align.op11_align(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    assert [tuple(r)[1:] for r in rows] == slow_rows(tokenizers, texts)
    assert any(r.n_groups < min(r.n_a, r.n_b) for r in rows) and rows[0].groups_sha256 == ""


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1000])
def test_pieces_of_any_size_give_the_same_overlaps(piece):
    rng = np.random.default_rng(piece)
    for _ in range(30):
        last = 200
        a, b = (np.append(np.sort(rng.choice(np.arange(1, last), rng.integers(0, 60), replace=False)), last) for _ in range(2))
        over_a, over_b, common_a, common_b = align.overlaps(a, b, piece)
        spans = lambda e: list(zip(np.append(0, e[:-1]), e))
        want = {(i, j) for i, x in enumerate(spans(a)) for j, y in enumerate(spans(b)) if x[0] < y[1] and y[0] < x[1]}
        assert sorted(zip(over_a, over_b)) == sorted(want) and list(a[common_a]) == list(b[common_b]) == sorted(set(a) & set(b))
        i, j = align.diagonals(a, b, piece)
        assert set(np.diff(i + j)[:-1]) <= {piece} and i[-1] == a.size and j[-1] == b.size


def test_chunks_and_slabs_change_nothing(tokenizers):
    words = ["don't", "the", "naïve", "日本", "x", "3.14", "(a", "b)", "  two", "I'm", "Straße"]
    text = " ".join(RANDOM.choice(words) for _ in range(800))
    assert len(tokenizers.chunks(text, 50)) > 20
    whole, cut = (align.align_texts(tokenizers, [text, "a b", text], *x)[0].row() for x in ((1 << 18, 1 << 20), (50, 120, 5)))
    assert whole[:2] == cut[:2] and all(np.array_equal(x, y) for x, y in zip(whole[2:], cut[2:]))
    groups = align.group_lists(tokenizers, text)
    assert groups == [tuple(g) for g in slow_alignment(tokenizers, text)[3]]


def test_rows_with_clashing_columns_nulls_and_a_long_text(spark, tokenizers):
    rows = [(None, "a b", "x", 1), (7, "a b", None, 2), (7, None, "y", 3), (8, "long text here " * 60_000, "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, pair string, key int")
    got = {r.row.key: r for r in align.align(docs).collect()}
    assert got[1].n_a == got[2].n_a == 2 and got[3].n_links == 0 and got[1].row.text == "a b" and got[2].row.pair is None
    assert got[4].n_links >= 180_000 and got[4].count_sum == sum(x.n for x in got[4].pairs)
    assert align.align(spark.createDataFrame([], DOCS)).count() == 0


def test_strings_are_joined_at_once():
    strings = [b"", b"a", b"\xc3\xa4 b", b"12,"]
    own = align.Strings(strings)
    for ids in ([], [0], [3, 1, 0, 2, 2]):
        assert own.joined(np.array(ids, np.int64)).tobytes() == b"".join(strings[n] for n in ids)


def test_bytes_that_differ_at_the_same_length_are_told(tokenizers):
    _, _, same = tokenizers.ids(["plain text", "ﬁ", "a b", "ends in blanks  "])
    whole = [slow_alignment(tokenizers, x)[0] != [] for x in ["plain text", "ﬁ", "a b", "ends in blanks  "]]
    assert same == whole and same[0]
