import hashlib
import random

import duckdb
import pytest
import regex
from helpers import DOCS, documents

from lodestitch.llm import middle


def texts():
    rng = random.Random(12)
    letters = ["a", "é", "日", "🙂", "x́", "\n", " ", "<", "P", ">", "<S", "S>", "M", "\x00", "👩‍👩‍👧"]
    return [None, "", "a", "<P>", "x <M> y", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(300)), "long " * 300_000]


def slow(doc_id, text):
    text, digest = text or "", hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[k * 8 : k * 8 + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, out, a, b = "plain", text, None, None
    elif h[3] % 100 < 20:
        form, out = "spm", f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    else:
        form, out = "psm", f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, n, form, a, None if a is None else b - a, sha(out), sha(text)


def test_query_equals_brute_force_and_its_sql(spark, tmp_path):
    documents(spark, texts()).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, middle.op12_middle(spark, str(tmp_path)).collect()))
    assert got == [slow(k, t) for k, t in enumerate(texts())] and {r[2] for r in got} == {"plain", "psm", "spm"}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(middle.OP12_SQL).fetchall()) == got


@pytest.mark.parametrize("unit", middle.UNITS)
def test_windows_give_the_ends_of_one_match(unit):
    pattern = regex.compile(rf"({middle.UNITS[unit]})*+")
    rng = random.Random(unit)
    for _ in range(60):
        text = "".join(rng.choice(["ab", " ", "\n", "c", "longer word "]) for _ in range(rng.randint(0, 80)))
        whole = pattern.fullmatch(text).ends(1)
        assert [e for part in middle.unit_ends(pattern, text, 7) for e in part] == whole
        assert "".join(text[s:e] for s, e in zip([0, *whole], whole)) == text
        assert middle.cuts(pattern, text, 5, 11, 7) == middle.cuts(pattern, text, 5, 11)


def test_cuts_are_the_smaller_and_the_larger_draw():
    pattern = regex.compile(r"((?s:.))*+")
    assert middle.cuts(pattern, "abc", 3, 1) == (3, 1, 3) and middle.cuts(pattern, "", 9, 9) == (0, 0, 0)
    assert middle.cuts(regex.compile("([ab])*+"), "abc", 1, 1) == (None, None, None)


def test_words_and_lines_keep_columns_and_come_back(spark):
    rows = [(None, "one two three four", 1, "x"), (3, None, 2, None), (3, "l1\nl2\nl3", None, "z"), (3, "l1\nl2\nl3", None, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int, row string")
    for unit in ("word", "line", "[a-z]"):
        out = middle.fill_in_middle(docs, unit)
        assert out.columns == ["doc_id", "text", "n", "row", "fim_form"] and out.count() == 4
        back = sorted((r.x or "") for r in out.select(middle.restored("text", "fim_form").alias("x")).collect())
        assert back == sorted((r[1] or "") for r in rows)
    assert {r.fim_form for r in middle.fill_in_middle(docs, "[a-z]").collect()} == {"plain"}
    assert middle.transformed(spark.createDataFrame([], DOCS)).count() == 0
