"""Large files by blocks against parsers that read them whole."""

import contextlib
import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestitch.functions import jsonx
from lodestitch.sources import blocks, csvscan, jsonscan, readers


@contextlib.contextmanager
def splits(spark, size):
    """Scans with splits of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.set(n, str(size))
        yield
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


@pytest.fixture
def cut(monkeypatch):
    """Every file is cut into blocks of some bytes."""

    def to(block):
        monkeypatch.setattr(readers, "WHOLE", 0)
        monkeypatch.setattr(blocks, "BLOCK", block)

    return to


def some_value(rng, deep=0):
    kind = rng.randint(0, 7 if deep < 3 else 4)
    if kind > 5:
        return {rng.choice(["a", "features", "x,y", 'q"', "ß"]): some_value(rng, deep + 1) for _ in range(rng.randint(0, 3))}
    if kind == 5:
        return [some_value(rng, deep + 1) for _ in range(rng.randint(0, 3))]
    return [None, True, rng.randint(-9, 9), rng.choice(["", "a,b", "]", "{", '"', "\\", '\\"', "é,日本", "x\\,", '"features":[1,2']), 1.5][kind]


def told(spark, adapter, path):
    rows = readers.told(spark, [{"id": "s", "adapter": adapter, "config": {"path": str(path)}}]).collect()
    rows.sort(key=lambda r: (r.file_path, r.position))
    by = {}
    for r in rows:
        by.setdefault(r.file_path.rsplit("/", 1)[-1], []).append(json.loads(r.payload) if r.error is None else ("error", r.error))
    return by


def test_json_elements_equal_json_load(spark, tmp_path, cut):
    rng = random.Random(2)
    values = {f"v{n}.json": [some_value(rng) for _ in range(rng.randint(0, 12))] for n in range(8)}
    values |= {"one.json": {"a": "x,y" * 30}, "text.json": "a,b,c", "empty.json": [], "blank.json": [], "long.json": [{"t": "x,\\\"{" * 80}, {"t": 2}]}
    for name, v in values.items():
        text = json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        (tmp_path / name).write_text("[\n \n]" if name == "blank.json" else f" {text}\n")
    bad = {"cut.json": '[{"a":1},{"a":2},{"a"', "quote.json": '[{"a":1},{"a":"2}]', "item.json": '[{"a":1},{a:2},{"a":3}]', "none.json": "not, json"}
    for name, text in bad.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "more.json").write_text('[{"a":1},{"a":2}] x')  # what follows is not looked at
    values["more.json"] = [{"a": 1}, {"a": 2}]
    want = {k: [{"row": x} for x in v] if isinstance(v, list) else [{"row": v}] for k, v in values.items() if v != []}
    want |= {k: [("error", "not valid JSON")] for k in bad}
    got = told(spark, "json", tmp_path)
    strict = lambda x: {k: json.dumps(v, sort_keys=True) for k, v in x.items()}
    assert strict(got) == strict(want)
    for block, split in ((1 << 20, 1 << 27), (10, 23), (64, 100)):
        cut(block)
        with splits(spark, split):
            assert strict(told(spark, "json", tmp_path)) == strict(want), (block, split)


def test_json_is_cut_at_line_feeds_where_lines_are_short(spark, tmp_path, cut, monkeypatch):
    items = [{"n": n, "t": "a,b]{", "l": [1, {"x": None}]} for n in range(12)]
    texts = {"lines": "[null\n" + "".join(f",{json.dumps(x)}\n" for x in items) + "]\n", "indented": json.dumps(items, indent=1), "compact": json.dumps(items), "late": "[1,\n2,\n" + json.dumps(items)[1:], "bad": "[1,\n2,\n}\n]", "bad_compact": json.dumps(items)[:-1] + ",{a}]"}
    for name, x in texts.items():
        (tmp_path / f"{name}.json").write_text(x)
    want = {f"{k}.json": [("error", "not valid JSON")] if k.startswith("bad") else [{"row": x} if x is not None else {} for x in json.loads(t)] for k, t in texts.items()}
    whole = told(spark, "json", tmp_path)
    monkeypatch.setattr(jsonscan, "LONGEST", 80)
    for block, split in ((50, 70), (1 << 20, 1 << 27)):
        cut(block)
        with splits(spark, split):
            got = told(spark, "json", tmp_path)
        assert got == whole and {k: [x if isinstance(x, tuple) else {a: b for a, b in x.items() if b is not None} for x in v] for k, v in got.items()} == want
    state = jsonscan.all_states(spark, [str(tmp_path)], {"pathGlobFilter": "*.json"}, 0, None, None).select("h", "separator").distinct()
    files = blocks.listing(spark, [str(tmp_path)], {"pathGlobFilter": "*.json"}).join(state, "h").collect()
    assert {r.file.rsplit("/", 1)[-1][:-5]: r.separator for r in files} == {"lines": "\n", "indented": "\n", "compact": ",", "late": ",", "bad": "\n", "bad_compact": ","}


def test_lists_under_a_key(spark, tmp_path, cut):
    items = [{"attributes": {"x": n, "s": '],"features":[{'}, "features": [n]} for n in range(30)]
    pages = {"a": {"m": {"features": [9, 9]}, "features": items, "after": [1, 2]}, "b": {"features": []}, "c": {"error": {"code": 1}, "features": items}, "d": {"features": {"no": "list"}}, "e": items, "f": {"k": [{"error": 1}], "features": items[:2]}}
    for name, page in pages.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(page))
    for block, split in ((None, None), (16, 40), (200, 1 << 20)):
        if block:
            cut(block)
        with splits(spark, split) if split else contextlib.nullcontext():
            got = told(spark, "arcgis", tmp_path)
        assert {k: v for k, v in got.items() if k != "c.json"} == {"a.json": items, "f.json": items[:2]}
        assert [x[0] for x in got["c.json"]] == ["error"]
        with splits(spark, split) if split else contextlib.nullcontext():
            generic = told(spark, "generic_rest", tmp_path)
        assert generic["e.json"] == [{"row": x} for x in items] and generic["b.json"] == [{"row": pages["b"]}]


def some_table(rng):
    cell = lambda: rng.choice(["", "a", "b c", "x,y", 'say "hi"', "two\nlines", "\n", '"', ",", "é", "a\r\nb", "5\" pipe"])
    width = rng.randint(1, 4)
    return [[f"c{k}" for k in range(width)]] + [[cell() for _ in range(width)] for _ in range(rng.randint(0, 12))]


def test_csv_records_equal_csv_reader(spark, tmp_path, cut):
    rng = random.Random(5)
    want = {}
    for n in range(12):
        table, out = some_table(rng), io.StringIO()
        csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]), quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerows(table)
        (tmp_path / f"t{n}.csv").write_bytes(out.getvalue().encode())
        rows = [{"row": {k: v or None for k, v in zip(table[0], r)}} for r in list(csv.reader(io.StringIO(out.getvalue(), newline="")))[1:] if r]
        if rows:
            want[f"t{n}.csv"] = rows
    (tmp_path / "odd.csv").write_text('a,a,b\n1\n\n  \n1,2,3,4\n5" pipe,x"y,"q"z\n"open,1\n')
    want["odd.csv"] = [{"row": {"a": "1", "a.1": None, "b": None}}, ("error", "3 fields expected, 4 found"), {"row": {"a": '5" pipe', "a.1": 'x"y', "b": "qz"}}, ("error", "a quote is not closed")]
    assert told(spark, "csv", tmp_path) == want
    for block, split in ((1 << 20, 1 << 27), (5, 11), (40, 64)):
        cut(block)
        with splits(spark, split):
            assert told(spark, "csv", tmp_path) == want, (block, split)


def test_lines_and_positions_do_not_hang_on_splits(spark, tmp_path, cut):
    lines = [json.dumps({"n": n, "t": "é" * (n % 7)}, ensure_ascii=False) for n in range(60)]
    (tmp_path / "a.ndjson").write_text("\n".join([*lines, "", "{cut", '{"n":60}\r']))
    (tmp_path / "b.csv").write_text("n,t\n" + "".join(f'{n},"a\nb"\n' for n in range(40)))
    (tmp_path / "c.json").write_text(json.dumps([{"n": n} for n in range(50)]))
    cut(32)
    seen = []
    for split in (37, 100, 1 << 27):
        with splits(spark, split):
            seen.append(sorted((r.file_path, r.position, r.payload or r.error) for r in readers.told(spark, [{"id": "s", "adapter": "flatfile", "config": {"path": str(tmp_path)}}]).collect()))
    assert seen[0] == seen[1] == seen[2] and len({x[:2] for x in seen[0]}) == len(seen[0]) == 62 + 40 + 50
    text = (tmp_path / "a.ndjson").read_bytes()
    assert all(text[p:].startswith(b'{"n":') or "not valid" in what for f, p, what in seen[0] if f.endswith("ndjson"))


def test_a_large_array_is_read_by_several_tasks(spark, tmp_path):
    with open(tmp_path / "large.json", "w") as out:
        out.write("[")
        for n in range(40_000):
            out.write(("," if n else "") + json.dumps({"n": n, "text": 'w,"[' * 120}))
        out.write("]")
    assert (tmp_path / "large.json").stat().st_size > readers.WHOLE
    with splits(spark, 4 << 20):
        rows = readers.read_source(spark, {"id": "s", "adapter": "json", "config": {"path": str(tmp_path)}})
        got = rows.select(F.get_json_object("payload", "$.row.n").cast("int").alias("n"), F.spark_partition_id().alias("p")).agg(F.count("*").alias("c"), F.countDistinct("n").alias("d"), F.max("n").alias("m"), F.countDistinct("p").alias("p")).first()
    assert (got.c, got.d, got.m) == (40_000, 40_000, 39_999) and got.p >= 4


def test_transitions_of_lines():
    for line, want in ((b"a,b", (False, True)), (b'"a', (True, False)), (b'a"', (False, False)), (b'"a""', (True, False)), (b'x,"y', (True, False)), (b'","', (False, True)), (b'"a"b"', (False, False)), (b'"a",', (False, True))):
        assert csvscan.after(line, False) == want[0]
        for inside in (False, True):
            read = list(csv.reader(io.StringIO(('"' if inside else "") + line.decode() + '\nNEXT', newline="")))
            assert csvscan.after(line, inside) == (len(read) == 1), (line, inside)


def test_escapes():
    import numpy as np

    for text in (r'"a\"b"', r'"\\"', r'"\\\""', '""', r'\"'):
        data = np.frombuffer(text.encode(), np.uint8)
        want, escaped = [], False
        for c in text:
            want.append(c == '"' and not escaped)
            escaped = c == "\\" and not escaped
        assert jsonscan.quotes(data).tolist() == want


def test_many_sources_make_one_scan(spark, tmp_path):
    sources = []
    for n in range(120):
        (tmp_path / f"d{n}").mkdir()
        (tmp_path / f"d{n}" / "a.csv").write_text(f"c{n % 3}\n{n}\n")
        sources.append({"id": f"s{n}", "adapter": "csv", "config": {"path": str(tmp_path / f"d{n}")}})
    sources.append({"id": "again", "adapter": "csv", "config": {"path": f"file://{tmp_path}/d7/"}})
    rows = readers.ingest(spark, sources)
    assert {(r.source_id, r.payload) for r in rows.collect()} == {(f"s{n}", f'{{"row":{{"c{n % 3}":"{n}"}}}}') for n in range(120)} | {("again", '{"row":{"c1":"7"}}')}
    plan = lambda s: readers.ingest(spark, s)._jdf.queryExecution().optimizedPlan().toString()
    scans = lambda s: plan(s).count("Relation [value")
    assert scans(sources) == scans(sources[:2]) == 1


def test_rejects_and_rows_from_one_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n2,3\n")
    (tmp_path / "b.json").write_text("[{]")
    (tmp_path / "c.ndjson").write_text('{"x":1}\n{\n')
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "cut.xml").write_text("<rss><channel><item><title>T</title></item><item>")
    (tmp_path / "f" / "page.xml").write_text("<html/>")
    sources = [{"id": "drop", "adapter": "flatfile", "config": {"path": str(tmp_path)}}, {"id": "feed", "adapter": "news_rss", "config": {"path": str(tmp_path / "f")}}]
    rows, log = readers.ingest_run(spark, sources, "2024-01-01 00:00:00")
    assert sorted(r.payload for r in rows.collect()) == ['{"entry":{"title":"T"}}', '{"row":{"x":"1"}}', '{"row":{"x":1}}']
    errors = {r.source_id: r.error for r in log.collect()}
    assert errors["drop"] == "3 rejected, first in a.csv: 1 fields expected, 2 found" and errors["feed"].startswith("2 rejected, first in cut.xml: not valid XML")
    assert rows.select("position").where("position is null").count() == 0
    assert jsonx.parse("payload") is not None
