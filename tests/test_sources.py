import json

import pytest
from pyspark.sql import functions as F

from lodestitch.functions import text
from lodestitch.operators import staging
from lodestitch.sources import readers


def one(adapter, **config):
    return [{"id": "s", "adapter": adapter, "config": config}]


def payloads(df):
    return sorted((json.loads(r.payload) for r in df.collect()), key=str)


def test_csv_stays_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("badge,name\n007,NA\n,x\n")
    (tmp_path / "b.txt").write_text("skip")
    got = payloads(readers.read_source(spark, {"id": "s", "adapter": "flatfile", "config": {"path": str(tmp_path)}}))
    assert got == sorted([{"row": {"badge": "007", "name": "NA"}}, {"row": {"badge": None, "name": "x"}}], key=str)


def test_csv_headers_patterns_and_folders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.CSV").write_text("y,x\n3,4\n")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "c.csv").write_text("x,y\n5,6\n")
    rows = lambda **c: payloads(readers.read_source(spark, {"id": "s", "adapter": "flatfile", "config": {"drop_dir": str(tmp_path), **c}}))
    assert rows() == sorted([{"row": {"x": "1", "y": "2"}}, {"row": {"y": "3", "x": "4"}}], key=str)
    assert rows(filename_pattern="a*") == [{"row": {"x": "1", "y": "2"}}]
    assert rows(filename_pattern="*.json") == []


def test_json_ndjson_and_missing_folder(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"a":1},{"a":2}]')
    (tmp_path / "o.json").write_text('{"b":1}')
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "n.ndjson").write_text('{"c":1}\n\n  \n{"c":2}\n')
    got = readers.read_source(spark, {"id": "s", "adapter": "flatfile", "config": {"path": str(tmp_path)}})
    assert payloads(got) == sorted([{"row": {"a": 1}}, {"row": {"a": 2}}, {"row": {"b": 1}}, {"row": {"c": 1}}, {"row": {"c": 2}}], key=str)
    assert {json.loads(r.metadata)["file"] for r in got.collect()} == {"l.json", "o.json", "n.ndjson"}
    bad = readers.rejected(spark, {"id": "s", "adapter": "flatfile", "config": {"drop_dir": str(tmp_path)}}).collect()
    assert [(r.file.rsplit("/", 1)[-1], r.error) for r in bad] == [("bad.json", "not valid JSON")]
    assert {r.content_type for r in got.collect()} == {"application/json", "application/x-ndjson"}
    assert readers.read_source(spark, {"id": "s", "adapter": "flatfile", "config": {"path": str(tmp_path / "none")}}).count() == 0
    assert readers.read_source(spark, {"id": "s", "adapter": "json", "config": {}}).count() == 0


def test_feature_pages(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"features":[{"attributes":{"x":1},"geometry":null},{"attributes":{"x":2},"geometry":null}]}')
    (tmp_path / "2.json").write_text('{"error":{"code":400}}')
    assert payloads(readers.read_source(spark, {"id": "s", "adapter": "arcgis", "config": {"path": str(tmp_path)}})) == [{"attributes": {"x": 1}, "geometry": None}, {"attributes": {"x": 2}, "geometry": None}]
    assert readers.rejected(spark, {"id": "s", "adapter": "arcgis", "config": {"path": str(tmp_path)}}).first().error == '{"code":400}'


def test_datasets_results_and_generic(spark, tmp_path):
    for d in ("d1", "d2"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "p.json").write_text(f'[{{"v":"{d}"}}]')
    got = readers.read_source(spark, {"id": "s", "adapter": "socrata", "config": {"path": str(tmp_path), "dataset_ids": ["d1", "d2", "none"]}})
    assert payloads(got) == [{"dataset_id": "d1", "row": {"v": "d1"}}, {"dataset_id": "d2", "row": {"v": "d2"}}]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "r.json").write_text('{"results":[{"docket_number":"1"}]}')
    (tmp_path / "r" / "e.json").write_text('{"detail":"x"}')
    assert payloads(readers.read_source(spark, {"id": "s", "adapter": "courtlistener", "config": {"path": str(tmp_path / "r")}})) == [{"docket": {"docket_number": "1"}}]
    assert payloads(readers.read_source(spark, {"id": "s", "adapter": "muckrock", "config": {"path": str(tmp_path / "r")}})) == [{"foia": {"docket_number": "1"}}]
    (tmp_path / "g").mkdir()
    for n, body in enumerate(('[{"a":1}]', '{"data":[{"a":2},{"a":3}]}', '{"a":4}', '{"data":{"a":5}}')):
        (tmp_path / "g" / f"{n}.json").write_text(body)
    assert payloads(readers.read_source(spark, {"id": "s", "adapter": "generic_rest", "config": {"path": str(tmp_path / "g")}})) == [{"row": {"a": n}} for n in range(1, 6)]


def test_feeds_audio_and_tables(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><title>c</title><item><title>T</title><link>L</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><description>D</description></item></channel></rss>")
    (tmp_path / "e.xml").write_text("<rss><channel></channel></rss>")
    (entry,) = payloads(readers.read_source(spark, {"id": "s", "adapter": "news_rss", "config": {"path": str(tmp_path)}}))
    assert entry["entry"] == {"title": "T", "link": "L", "published": "Tue, 02 Jan 2024 03:04:05 GMT", "summary": "D"}
    (tmp_path / "a.mp3").write_bytes(b"12345")
    assert payloads(readers.read_source(spark, {"id": "s", "adapter": "audio", "config": {"path": str(tmp_path)}})) == [{"file_name": "a.mp3", "size_bytes": 5, "duration_seconds": None}]
    spark.createDataFrame([(1, "x"), (2, "y")], "n int, s string").write.parquet(str(tmp_path / "t"))
    assert payloads(readers.read_source(spark, {"id": "s", "adapter": "opd", "config": {"path": str(tmp_path / "t"), "where": "n > 1", "out_fields": "s"}})) == [{"row": {"s": "y"}}]


def test_pages_and_documents(spark, tmp_path):
    entities = spark.createDataFrame([("<p>a&nbsp;b &#8217;&#x27; &mdash;&eacute; &amp;lt; &copy 5 &nosuch; &#0; x</p>",), ("none",), (None,)], "html string")
    assert [r[0] for r in entities.select(text.html_text(F.col("html"))).collect()] == ["a\xa0b ’' —é &lt; © 5 &nosuch; \ufffd x", "none", None]
    html = "<html><title> A &amp; B </title><script>x()</script><p>one</p><!-- no --><p>two &lt;3</p></html>"
    pages = spark.createDataFrame([("u", html), ("v", "<p>" + "z" * 6000), ("w", None)], "url string, html string")
    rows = pages.select(text.html_title(F.col("html"), F.col("url")).alias("t"), text.html_text(F.col("html")).alias("x")).collect()
    assert (rows[0].t, rows[0].x) == ("A & B", "A & B one two <3")
    assert rows[1].t == "v" and len(rows[1].x) == 5000 and rows[2].x is None
    texts = spark.createDataFrame([("d/a.pdf", " \n"), ("d/b.pdf", "B"), ("d/c.pdf", None)], "path string, text string")
    siblings = spark.createDataFrame([("d/a.txt", "A")], "path string, text string")
    assert {r.path: r.text for r in readers.with_sibling_text(texts, siblings).collect()} == {"d/a.pdf": "A", "d/b.pdf": "B", "d/c.pdf": ""}
    joined = text.joined_pages(spark.createDataFrame([("p", 2, "b"), ("p", 1, "a"), ("p", 3, None)], "path string, page_no int, text string"))
    assert joined.first().text == "a\nb\n"


def test_registry_and_staging(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.reader("nope")
    (tmp_path / "a.csv").write_text("x\n1\n1\n")
    sources = [{"id": "s1", "adapter": "flatfile", "config": {"path": str(tmp_path)}}, {"id": "s2", "adapter": "flatfile", "enabled": False, "config": {"path": str(tmp_path)}}, {"id": "s3", "adapter": "audio", "config": {}}]
    raw = staging.raw_records(readers.ingest(spark, sources), "b", "2024-01-01 00:00:00")
    catalog = spark.createDataFrame([("s1", True, "incident"), ("s2", False, None), ("s3", None, None)], "id string, enabled boolean, entity_type string")
    staged = staging.stage(raw, catalog)
    assert {(r.entity_type, r.status) for r in staged.collect()} == {("incident", "pending")}
    assert staged.count() == 2 and staging.unique_records(staged).count() == 2 and staging.content_dedup(staged).count() == 1
    log = readers.ingest_log(spark, [*sources, {"id": "s4", "adapter": "csv", "config": {"path": str(tmp_path / "none")}}], "2024-01-01 00:00:00")
    assert {r.source_id: r.error for r in log.collect()} == {"s1": None, "s2": "disabled", "s3": "not configured", "s4": "nothing has landed"}
    assert {r.source_id: r.n_rows for r in staging.source_counts(catalog, staged).collect()} == {"s1": 2, "s3": 0}


def test_catalog(spark, tmp_path):
    (tmp_path / "catalog.json").write_text(json.dumps({"id": "s", "adapter": "csv", "config": {"path": "p"}}) + "\n")
    row = readers.load_catalog(spark, str(tmp_path / "catalog.json")).first()
    assert (row.id, row.enabled, row.config) == ("s", None, {"path": "p"})


def test_upsert_and_outcomes(spark):
    stored = spark.createDataFrame([("a", "A", "c", "x", "auto"), ("b", "B", "c", "x", "auto")], "id string, name string, category string, adapter string, access_mode string")
    catalog = spark.createDataFrame([("b", "B2", None, "y", None), ("n", None, None, None, None)], "id string, name string, category string, adapter string, access_mode string")
    got = {r.id: tuple(r)[1:] for r in staging.upsert_sources(catalog, stored).collect()}
    assert got == {"a": ("A", "c", "x", "auto"), "b": ("B2", "unknown", "y", "manual"), "n": ("n", "unknown", "unknown", "manual")}
