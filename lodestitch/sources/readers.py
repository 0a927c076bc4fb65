"""Readers of landed files and tables; each gives rows of the raw envelope.

A reader is a function (spark, sources) -> DataFrame of told rows: the envelope and
`error`. All sources of an adapter whose files are picked by the same pattern are
read by one scan, and a row's source follows from the folder of its file, so that a
plan does not grow with the catalog. What does not parse, or reports an error, is a
row with an error in place of a payload, told by the same scan.

A path that is not there, or a key that is not configured, gives no rows rather
than an error. Files are those of the folder itself (path or drop_dir) whose name
fits filename_pattern. `position` orders a file's rows: a number of the row, or of
its first byte, however the file was split. Files of up to WHOLE bytes are parsed
whole; larger ones by many tasks (see blocks), to the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx, text
from ..schemas import RAW_ENVELOPE, empty
from ..session import kept_table
from . import blocks, csvscan, feeds, jsonscan

Reader = Callable[[SparkSession, list[dict]], DataFrame]
READERS: dict[str, Reader] = {}

JSON, NDJSON, HTML, AUDIO, PDF, XML = "application/json", "application/x-ndjson", "text/html", "audio/mpeg", "application/pdf", "application/rss+xml"
TOLD = f"{RAW_ENVELOPE}, error string"
#: Files of more bytes are cut into blocks.
WHOLE = 8 << 20


def register(name: str) -> Callable[[Reader], Reader]:
    def add(reader: Reader) -> Reader:
        READERS[name] = reader
        return reader

    return add


def reader(name: str) -> Reader:
    if name not in READERS:
        raise ValueError(f"unknown adapter: {name}")
    return READERS[name]


def told(spark: SparkSession, sources: list[dict] | DataFrame) -> DataFrame:
    """Rows of the envelope, and of what could not be read (error, no payload), of all enabled sources of known adapters: one scan for each adapter and pattern."""
    by: dict[str, list[dict]] = {}
    for source in catalog_sources(sources) if isinstance(sources, DataFrame) else sources:
        if source.get("enabled", True) and source["adapter"] in READERS:
            by.setdefault(source["adapter"], []).append({"id": source.get("id"), "adapter": source["adapter"], "config": source.get("config") or {}})
    out = spark.createDataFrame([], TOLD)
    for adapter in sorted(by):
        out = out.unionByName(READERS[adapter](spark, by[adapter]))
    return out


def good(rows: DataFrame) -> DataFrame:
    """The envelope rows of told ones."""
    return rows.where("error is null").drop("error")


def read_source(spark: SparkSession, source: dict) -> DataFrame:
    """Rows of one catalogued source; its nested config is what a reader sees."""
    reader(source["adapter"])
    return good(told(spark, [{**source, "enabled": True}]))


def ingest(spark: SparkSession, sources: list[dict] | DataFrame) -> DataFrame:
    """All enabled sources as one union. A source whose adapter is unknown gives no rows and is told by the log."""
    return good(told(spark, sources))


def rejected(spark: SparkSession, source: dict) -> DataFrame:
    """file and error of what a source's reader leaves out."""
    return told(spark, [{**source, "enabled": True}]).where("error is not null").select(F.col("file_path").alias("file"), "error")


def envelope(df: DataFrame, payload: Column, content_type: str = JSON, file_path: Column | None = None, position: Column | None = None, **metadata: Column) -> DataFrame:
    """Rows of the raw envelope; metadata is JSON text of what the reader knows, with the file's name where there is one. Further columns source_id and error are kept."""
    null = F.lit(None)
    if file_path is not None:
        metadata = {"file": text.file_name(file_path), **metadata}
    known = F.to_json(F.struct(*(c.cast("string").alias(k) for k, c in metadata.items()))) if metadata else null
    own = {"content_type": F.lit(content_type), "payload": payload, "file_path": file_path, "metadata": known, "position": position}
    own = {k: c for k, c in own.items() if c is not None} | {c: F.col(c) for c in ("source_id", "error") if c in df.columns}
    wanted = [x.split() for x in (TOLD if "error" in df.columns else RAW_ENVELOPE).split(", ")]
    return df.select(*(own.get(n, null).cast(t).alias(n) for n, t in wanted))


def exists(spark: SparkSession, path: str) -> bool:
    """Asks the path's own file system, so that any store works; a glob exists if something matches."""
    if not path:
        return False
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def place(config: dict) -> str:
    return config.get("path") or config.get("drop_dir") or ""


def _glob(config: dict, suffix: str) -> str | None:
    """The names of a suffix, in any case, that fit the configured pattern; None if no name can."""
    pattern = config.get("filename_pattern") or config.get("pattern") or "*"
    if pattern.lower().endswith(suffix):
        return pattern
    return pattern + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix) if pattern.endswith("*") else None


class Files:
    """The files of some sources, of one suffix and pattern, as one scan."""

    def __init__(self, spark: SparkSession, glob: str, sources: list[dict], folders: list[str] | None = None):
        """folders: of each source, as the files' paths have it; None if there is one source, whose path is a file or a pattern."""
        self.spark, self.options, self.sources, self.folders = spark, {"pathGlobFilter": glob}, sources, folders
        self.paths = list(dict.fromkeys(place(s["config"]) for s in sources))

    def large(self) -> DataFrame | None:
        """file and h of the files that are cut into blocks; None if there are none."""
        found = blocks.listing(self.spark, self.paths, self.options).where(F.col("length") > WHOLE).select("file", "h")
        n = found.count()
        return None if not n else F.broadcast(found) if n <= blocks.BROADCAST_ROWS else found

    def whole(self) -> DataFrame:
        """value (a whole file) and file, of the others."""
        files = self.spark.read.options(**self.options).text(self.paths, wholetext=True).where(F.col("_metadata.file_size") <= WHOLE)
        return files.select("value", F.col("_metadata.file_path").alias("file"))

    def told(self, rows: DataFrame, payload: Column, content_type: str) -> DataFrame:
        """Told envelope rows of rows with file, position and error: one for each source that a file belongs to. `payload` may use `extra`, what a source adds to the metadata."""
        metadata = F.to_json(F.map_concat(F.create_map(F.lit("adapter"), F.col("adapter"), F.lit("file"), text.file_name(F.col("file"))), "extra"))
        return _told(self.owned(rows), F.when(F.col("error").isNull(), payload), content_type, F.col("file"), F.col("position"), metadata)

    def owned(self, rows: DataFrame) -> DataFrame:
        """Rows (with `file`) with source_id, adapter and extra of each source that the file belongs to."""
        known = [(s["id"], s["adapter"], {k: str(v) for k, v in s.get("extra", {}).items()}) for s in self.sources]
        if self.folders is None:
            (source, adapter, extra), = known
            pairs = [F.lit(x) for kv in extra.items() for x in kv]
            return rows.withColumns({"source_id": F.lit(source), "adapter": F.lit(adapter), "extra": (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>")})
        places = self.spark.createDataFrame([(f, *k) for f, k in zip(self.folders, known)], "folder string, source_id string, adapter string, extra map<string,string>")
        rows = rows if "folder" in rows.columns else rows.withColumn("folder", _folder(F.col("file")))
        return rows.join(F.broadcast(places.withColumn("folder", _same(F.col("folder")))), "folder").drop("folder")

    def csv(self) -> DataFrame:
        """file, position, payload and error of each record."""
        rows, large = csvscan.small_rows(self.whole()), self.large()
        if large is None:
            return rows
        return rows.unionByName(csvscan.large_rows(self.spark, self.paths, self.options, WHOLE).join(large, "h").drop("h"))

    def lines(self) -> DataFrame:
        """file, position, item (Variant) and error of each line that is not blank."""
        rows, large = self.whole().select("file", F.posexplode(F.split("value", "\n")).alias("position", "value")), self.large()
        rows = rows.withColumn("position", F.col("position").cast("bigint"))
        if large is not None:
            rows = rows.unionByName(csvscan.large_lines(self.spark, self.paths, self.options, WHOLE).join(large, "h").drop("h"))
        rows = rows.where(F.col("value").rlike(r"\S")).withColumn("item", jsonx.parse("value"))
        return rows.withColumn("error", F.when(F.col("item").isNull(), "not valid JSON")).drop("value")

    def json(self, key: str | None = None, error: str | None = None) -> DataFrame:
        """file, folder, position, item (Variant), shape and error: of each file the items of its list ("list"), or of the list under the key ("named"), or its one value ("single"). A file that is no JSON, or whose `error` key is there, gives none and is told."""
        docs = self.whole().withColumn("doc", jsonx.parse("value"))
        null = F.lit(None).cast("string")
        named = jsonx.field("doc", key) if key else null.try_cast("variant")
        docs = docs.select("file", _folder(F.col("file")).alias("folder"), "doc", named.alias("named"), F.when(F.col("doc").isNull(), "not valid JSON").otherwise(jsonx.text(jsonx.field("doc", error)) if error else null).alias("error"))
        shape = F.when(jsonx.is_array(F.col("doc")), "list").when(jsonx.is_array(F.col("named")), "named").otherwise("single")
        items = F.when(shape == "list", F.try_variant_get("doc", "$", "array<variant>")).when(shape == "named", F.try_variant_get("named", "$", "array<variant>")).otherwise(F.array("doc"))
        none = F.array(F.parse_json(F.lit("null")))
        rows = docs.withColumn("shape", shape).select("file", "folder", "shape", "error", F.posexplode(F.when(F.col("error").isNull(), items).otherwise(none)).alias("position", "item"))
        rows, large = rows.withColumn("position", F.col("position").cast("bigint")), self.large()
        if large is None:
            return rows
        found, errors = jsonscan.large_elements(self.spark, self.paths, self.options, WHOLE, key, error)
        bad = errors.select("h", F.lit("single").alias("shape"), "error", F.lit(0).cast("bigint").alias("position"), F.parse_json(F.lit("null")).alias("item"))
        both = found.select("h", "shape", null.alias("error"), "position", F.col("doc").alias("item")).unionByName(bad)
        return rows.unionByName(both.join(large.withColumn("folder", _folder(F.col("file"))), "h").drop("h"))


def _told(rows: DataFrame, payload: Column, content_type: str, file: Column, position: Column, metadata: Column) -> DataFrame:
    known = {"content_type": F.lit(content_type), "payload": payload, "file_path": file, "position": position, "metadata": metadata, "source_id": F.col("source_id"), "error": F.col("error")}
    return rows.select(*(known.get(n, F.lit(None)).cast(t).alias(n) for n, t in (x.split() for x in TOLD.split(", "))))


def _folder(file: Column) -> Column:
    return _same(F.regexp_replace(file, r"/[^/]*$", ""))


def _same(path: Column) -> Column:
    """A folder's path, however its scheme and its end are written."""
    return F.regexp_replace(F.regexp_replace(path, r"^(\w+:)/+", "$1/"), "/+$", "")


def _scans(spark: SparkSession, sources: list[dict], suffix: str) -> list[Files]:
    """The scans that read all files of a suffix: one for the folders of each pattern, and one for each path that is itself a file or a pattern."""
    by: dict[str, list[tuple[dict, str]]] = {}
    out = []
    for source in sources:
        path, glob = place(source["config"]), _glob(source["config"], suffix)
        if glob is None or not exists(spark, path):
            continue
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if not any(c in path for c in "*?{[") and system.getFileStatus(where).isDirectory():
            by.setdefault(glob, []).append((source, system.makeQualified(where).toUri().toString()))
        else:
            out.append(Files(spark, glob, [source]))
    return [*(Files(spark, glob, [s for s, _ in own], [f for _, f in own]) for glob, own in sorted(by.items())), *out]


def _union(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    out = spark.createDataFrame([], TOLD)
    for part in parts:
        out = out.unionByName(part)
    return out


def _row(item: Column) -> Column:
    return F.to_json(F.struct(item.alias("row")))


@register("csv")
def csv_rows(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """Each record as {"row": {...}}; all values stay text, an empty one is null. Each file has its own columns."""
    return _union(spark, [f.told(f.csv(), F.col("payload"), JSON) for f in _scans(spark, sources, ".csv")])


@register("json")
def json_items(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """{"row": item} for each item of a list, {"row": value} for any other value."""
    return _union(spark, [f.told(f.json(), _row(F.col("item")), JSON) for f in _scans(spark, sources, ".json")])


@register("ndjson")
def ndjson_lines(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """{"row": value} for each line that is not blank."""
    return _union(spark, [f.told(f.lines(), _row(F.col("item")), NDJSON) for suffix in (".ndjson", ".jsonl") for f in _scans(spark, sources, suffix)])


@register("flatfile")
def flat_files(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """CSV, JSON and NDJSON files of a folder; other suffixes are skipped."""
    return csv_rows(spark, sources).unionByName(json_items(spark, sources)).unionByName(ndjson_lines(spark, sources))


@register("public_records")
def mixed_drop(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """A folder of mixed files: CSV and JSON are read as such, extracted PDF text comes from a table; NDJSON and the rest are skipped."""
    return csv_rows(spark, sources).unionByName(json_items(spark, sources)).unionByName(document_texts(spark, sources))


@register("arcgis")
def feature_pages(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """Landed pages of features: {"attributes", "geometry"} each; a page that reports an error is told."""
    layered = [{**s, "extra": {"layer": s["config"].get("layer", 0)}} for s in sources]
    scans = _scans(spark, layered, ".json")
    return _union(spark, [f.told(f.json("features", "error").where("shape = 'named' or error is not null"), F.to_json("item"), JSON) for f in scans])


def features(pages: DataFrame, value: str = "value") -> DataFrame:
    """`item` of each feature of the pages without an error."""
    good = pages.withColumn("doc", jsonx.parse(value)).where(jsonx.field("doc", "error").isNull())
    items = F.explode(F.try_variant_get("doc", "$.features", "array<variant>")).alias("item")
    return good.select(*pages.columns, items)


def filtered(table: DataFrame, config: dict) -> DataFrame:
    """A landed table under a source's own filter and fields."""
    fields = config.get("out_fields", "*")
    names = table.columns if fields in ("*", None) else [f.strip() for f in fields.split(",")] if isinstance(fields, str) else fields
    return table.where(F.expr(config.get("where") or "1=1")).select(*names)


def _datasets(source: dict) -> list[dict]:
    """A source of its own for each dataset of a source."""
    named = source["config"].get("dataset_ids") or []
    names = [d.strip() for d in (named.split(",") if isinstance(named, str) else named)]
    return [{**source, "config": {**source["config"], "path": f"{place(source['config'])}/{d}"}, "extra": {"dataset": d}} for d in names]


@register("socrata")
def dataset_rows(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """Landed arrays under path/<dataset id>/: {"dataset_id", "row"} each; all datasets of all sources in one scan."""
    own = [d for source in sources for d in _datasets(source)]
    row = F.to_json(F.struct(F.col("extra")["dataset"].alias("dataset_id"), F.col("item").alias("row")))
    return _union(spark, [f.told(f.json(), row, JSON) for f in _scans(spark, own, ".json")])


def exploded(df: DataFrame, value: Column) -> DataFrame:
    """`item`: each element of a list, or the value itself."""
    items = F.when(jsonx.is_array(value), F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(value))
    return df.select("*", F.explode(items).alias("item"))


@register("generic_rest")
def generic_json(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """A list gives its items, {"data": X} gives X or its items, any other object is one row; each as {"row": ...}."""
    inner = F.when((F.col("shape") == "single") & jsonx.is_object(F.col("item")), jsonx.field("item", "data"))
    return _union(spark, [f.told(f.json("data"), _row(F.coalesce(inner, "item")), JSON) for f in _scans(spark, sources, ".json")])


def generic_items(files: DataFrame, value: str = "value") -> DataFrame:
    doc = files.withColumn("doc", jsonx.parse(value)).where("doc is not null")
    inner = F.when(jsonx.is_object(F.col("doc")) & jsonx.field("doc", "data").isNotNull(), jsonx.field("doc", "data")).otherwise(F.col("doc"))
    return exploded(doc.withColumn("doc", inner), F.col("doc"))


def result_items(files: DataFrame, name: str, value: str = "value") -> DataFrame:
    """payload {name: item} of each of results[]; no results, no rows."""
    items = F.explode(F.try_variant_get(jsonx.parse(value), "$.results", "array<variant>")).alias("item")
    return files.select(*files.columns, items).withColumn("payload", F.to_json(F.struct(F.col("item").alias(name))))


def _results(spark: SparkSession, sources: list[dict], name: str) -> DataFrame:
    payload = F.to_json(F.struct(F.col("item").alias(name)))
    return _union(spark, [f.told(f.json("results").where("shape = 'named' or error is not null"), payload, JSON) for f in _scans(spark, sources, ".json")])


@register("courtlistener")
def dockets(spark: SparkSession, sources: list[dict]) -> DataFrame:
    return _results(spark, sources, "docket")


@register("muckrock")
def records_requests(spark: SparkSession, sources: list[dict]) -> DataFrame:
    return _results(spark, sources, "foia")


@register("news_rss")
def feed_items(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """Items of landed RSS, RDF and Atom feeds: {"entry": {title, link, published, summary, author}}; what is no feed, or breaks off, is told."""
    parts = []
    for f in _scans(spark, sources, ".xml"):
        files = spark.read.format("binaryFile").options(**f.options).load(f.paths)
        parts.append(f.told(feeds.items(files.select(F.col("_metadata.file_path").alias("file"), "content")), F.col("payload"), XML))
    return _union(spark, parts)


def _tables(spark: SparkSession, sources: list[dict], key: str, rows: Callable[[DataFrame, dict], DataFrame]) -> DataFrame:
    """Told rows of landed Parquet tables, a scan each, as their columns differ."""
    parts = []
    for source in sources:
        if exists(spark, source["config"].get(key, "")):
            table = spark.read.parquet(source["config"][key])
            parts.append(rows(table, source["config"]).withColumns({"source_id": F.lit(source["id"]), "error": F.lit(None).cast("string"), "metadata": _with_adapter(source["adapter"])}))
    return _union(spark, parts)


def _with_adapter(adapter: str) -> Column:
    known = F.from_json(F.coalesce("metadata", F.lit("{}")), "map<string,string>")
    return F.to_json(F.map_concat(F.create_map(F.lit("adapter"), F.lit(adapter)), known))


@register("web_scraper")
def web_pages(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """A landed table of pages (url, html): {"url", "title", "text"}."""
    return _tables(spark, sources, "path", lambda pages, _: page_rows(pages))


def page_rows(pages: DataFrame) -> DataFrame:
    row = F.struct("url", text.html_title(F.col("html"), F.col("url")).alias("title"), text.html_text(F.col("html")).alias("text"))
    return envelope(pages, F.to_json(row), HTML, url=F.col("url"))


@register("pdf_ocr")
def document_texts(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """Extracted texts (table `texts`: path, text, metadata; blank ones take the sibling text of table `siblings`: path, text)."""

    def rows(texts: DataFrame, config: dict) -> DataFrame:
        siblings = spark.read.parquet(config["siblings"]) if exists(spark, config.get("siblings", "")) else spark.createDataFrame([], "path string, text string")
        row = F.struct(text.file_name(F.col("path")).alias("file_name"), "text", "metadata")
        return envelope(with_sibling_text(texts, siblings), F.to_json(row), PDF, F.col("path"))

    return _tables(spark, sources, "texts", rows)


def with_sibling_text(texts: DataFrame, siblings: DataFrame) -> DataFrame:
    """text, or where that is blank the text of the file of the same name but for its suffix, or ''."""
    other = siblings.select(text.stem(F.col("path")).alias("__stem"), F.col("text").alias("__text")).groupBy("__stem").agg(F.min("__text").alias("__text"))
    joined = texts.withColumn("__stem", text.stem(F.col("path"))).join(other, "__stem", "left")
    return joined.withColumn("text", F.coalesce(text.blank_to_null(F.col("text")), F.col("__text"), F.lit(""))).drop("__stem", "__text")


@register("opd")
def table_rows(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """Any landed Parquet table, each row as {"row": {...}}; its position is its number in its file."""

    def rows(table: DataFrame, config: dict) -> DataFrame:
        own = filtered(table, config)
        placed = table.where(F.expr(config.get("where") or "1=1")).select(F.struct(*(F.col(f"`{c}`") for c in own.columns)).alias("row"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        return envelope(placed, F.to_json(F.struct("row"), {"ignoreNullFields": "false"}), file_path=F.col("file"), position=F.col("at"))

    return _tables(spark, sources, "path", rows)


@register("audio")
def audio_files(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """{"file_name", "size_bytes", "duration_seconds": null} of each .mp3; the content is never read."""
    row = F.struct(text.file_name(F.col("file")).alias("file_name"), F.col("length").alias("size_bytes"), F.lit(None).cast("double").alias("duration_seconds"))
    parts = []
    for f in _scans(spark, sources, ".mp3"):
        files = blocks.listing(spark, f.paths, f.options).select("file", "length", F.lit(0).cast("bigint").alias("position"), F.lit(None).cast("string").alias("error"))
        parts.append(f.told(files, F.to_json(row, {"ignoreNullFields": "false"}), AUDIO))
    return _union(spark, parts)


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalog as JSON lines: id, name, category, adapter, access_mode, schedule, availability_window, enabled, entity_type, config."""
    schema = "id string, name string, category string, adapter string, access_mode string, schedule string, availability_window string, enabled boolean, entity_type string, config map<string,string>"
    return spark.read.schema(schema).json(path)


def catalog_sources(catalog: DataFrame) -> list[dict]:
    """The catalog's rows, one for each source, as read_source takes them; a source without an adapter is a manual one and is left to a person."""
    rows = catalog.select("id", "adapter", "enabled", "entity_type", "config").orderBy("id").toLocalIterator()
    return [{"id": r.id, "adapter": r.adapter or "manual", "enabled": r.enabled is not False, "entity_type": r.entity_type, "config": r.config or {}} for r in rows]


#: Suffixes of the files of each adapter; the others read tables.
SUFFIXES = {"csv": (".csv",), "json": (".json",), "ndjson": (".ndjson", ".jsonl"), "flatfile": (".csv", ".json", ".ndjson", ".jsonl"), "public_records": (".csv", ".json"), "arcgis": (".json",), "socrata": (".json",), "generic_rest": (".json",), "courtlistener": (".json",), "muckrock": (".json",), "news_rss": (".xml",), "audio": (".mp3",)}


def landed_files(spark: SparkSession, sources: list[dict] | DataFrame) -> DataFrame:
    """source_id, file, length and changed of the files that enabled sources read (of a table, its Parquet files); no content is read."""
    out = spark.createDataFrame([], "source_id string, file string, length bigint, changed timestamp")
    by: dict[str, list[dict]] = {}
    for source in catalog_sources(sources) if isinstance(sources, DataFrame) else sources:
        source = {"id": source.get("id"), "adapter": source["adapter"], "config": source.get("config") or {}, "enabled": source.get("enabled", True)}
        if not source["enabled"]:
            continue
        for suffix in SUFFIXES.get(source["adapter"], ()):
            by.setdefault(suffix, []).extend(_datasets(source) if source["adapter"] == "socrata" else [source])
        if source["adapter"] == "opd" and exists(spark, place(source["config"])):
            meta = F.col("_metadata")
            table = spark.read.parquet(place(source["config"])).select(F.lit(source["id"]).alias("source_id"), meta.file_path.alias("file"), meta.file_size.alias("length"), meta.file_modification_time.alias("changed"))
            out = out.unionByName(table.distinct())
    for suffix, own in sorted(by.items()):
        for f in _scans(spark, own, suffix):
            out = out.unionByName(f.owned(blocks.listing(spark, f.paths, f.options)).select("source_id", "file", "length", "changed"))
    return out.distinct()


def skip_reason(spark: SparkSession, source: dict) -> str | None:
    """Why a source gives no rows, without being an error; None if it has something to read."""
    config = source.get("config") or {}
    if not source.get("enabled", True):
        return "disabled"
    if source["adapter"] not in READERS:
        return f"unknown adapter: {source['adapter']}"
    path = place(config) or config.get("texts")
    if not path:
        return "not configured"
    return None if exists(spark, path) else "nothing has landed"


def ingest_log(spark: SparkSession, sources: list[dict] | DataFrame, at: str, rows: DataFrame | None = None) -> DataFrame:
    """A row for each source of a run: source_id, ts and error, the reason for which it was skipped or what its reader left out. `rows`: the run's told rows, where they are stored."""
    sources = catalog_sources(sources) if isinstance(sources, DataFrame) else sources
    reasons = spark.createDataFrame([(s["id"], skip_reason(spark, s)) for s in sources], "source_id string, reason string")
    bad = (told(spark, sources) if rows is None else rows).where("error is not null").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file_path", "position", "error")).alias("first"))
    said = F.concat("n", F.lit(" rejected, first in "), text.file_name(F.col("first.file_path")), F.lit(": "), F.col("first.error"))
    joined = reasons.join(bad, "source_id", "left")
    return joined.select("source_id", F.lit(at).cast("timestamp").alias("ts"), F.coalesce("reason", F.when(F.col("n") > 0, said)).alias("error"))


def ingest_run(spark: SparkSession, sources: list[dict] | DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Envelope rows and log of one run, both from one scan, whose rows are stored first."""
    sources = catalog_sources(sources) if isinstance(sources, DataFrame) else sources
    rows = kept_table(told(spark, sources), "told")
    return good(rows), ingest_log(spark, sources, at, rows)
