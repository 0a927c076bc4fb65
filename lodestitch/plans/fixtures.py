"""The driver's tables as landed sources: staging records with JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import staging

#: Stands for a JSON null in a payload; a SQL NULL leaves the key out.
NULL = "@null"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def payload(under: str | None, **fields: Column) -> Column:
    own = F.struct(*(c.alias(k) for k, c in fields.items()))
    json = F.to_json(own if under is None else F.struct(own.alias(under)))
    return F.regexp_replace(json, f'"{NULL}"', "null")


def staged(df: DataFrame, key: str, source: str, entity_type: Column | str, json: Column) -> DataFrame:
    kind = F.lit(entity_type) if isinstance(entity_type, str) else entity_type
    return staging.dealt(df).select(
        F.col(key).cast("bigint").alias("id"),
        F.col(key).cast("bigint").alias("raw_record_id"),
        F.lit(source).alias("source_id"),
        kind.alias("entity_type"),
        json.alias("payload"),
        F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("suspension_reason"),
    )


def iso(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def prop_k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def uof_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of errors and views: the badge is the user, the incident number is props.k (0 is falsy)."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "view"))
    return staged(events, "event_id", "events", "use_of_force", payload("row", badge_number=F.col("user_id").cast("string"), incident_number=prop_k(), date_time=iso("ts")))


def stored_officers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as officers: the key is the badge, every third also has an employee id."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return s.select(
        key.cast("bigint").alias("id"),
        F.col("s_nationkey").cast("bigint").alias("agency_id"),
        F.col("s_name").alias("first_name"),
        key.cast("string").alias("badge_number"),
        F.when(key % 3 == 0, F.concat(F.lit("E"), key)).alias("employee_id"),
        F.create_map(F.lit("code"), key.cast("string"), F.lit("nation"), F.col("s_nationkey").cast("string")).alias("external_ids"),
    )


def incident_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as incidents: dates in seven forms, agencies named, missing or null."""
    key = F.col("o_orderkey")
    form = key % 7
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    when = F.when(form == 0, iso("o_orderdate")).when(form == 1, date).when(form == 2, F.date_format("o_orderdate", "dd/MM/yyyy")).when(form == 3, F.date_format("o_orderdate", "yyyy-M-d 'x'"))
    when = when.when(form == 4, F.date_format("o_orderdate", "yyyyMMdd")).when(form == 5, F.concat(iso("o_orderdate"), F.lit("Z")))
    agency = F.when(key % 11 == 0, NULL).when(key % 5 != 0, F.concat(F.lit("Agency "), key % 25))
    return staged(table(spark, sf_dir, "orders"), "o_orderkey", "orders", "incident", payload("attributes", incident_number=F.when(key % 13 != 0, key), date_time=when, location=F.col("o_orderpriority"), agency_name=agency))


def arrest_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("event_type = 'signup'")
    name = F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("Person "), F.col("user_id")))
    return staged(events, "event_id", "events", "arrest", payload("attributes", booking_number=prop_k(), person_name=name))


def officer_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return staged(table(spark, sf_dir, "supplier"), "s_suppkey", "supplier", "officer", payload("row", badge=F.when(key % 5 != 0, key), employee_id=F.when(key % 3 == 0, F.concat(F.lit("E"), key)), name=F.col("s_name"), first_name=F.col("s_name"), agency_name=F.concat(F.lit("Nation "), F.col("s_nationkey"))))


def court_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return staged(table(spark, sf_dir, "orders"), "o_orderkey", "orders", "court_case", payload("docket", docket_number=F.when(key % 17 != 0, F.col("o_custkey")), court=F.col("o_orderpriority"), date_filed=F.date_format("o_orderdate", "yyyy-MM-dd"), status=F.col("o_orderstatus")))


def document_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    name = F.when(key % 4 == 1, "").when(key % 4 != 0, F.concat(F.lit("f"), key, F.lit(".pdf")))
    return staged(table(spark, sf_dir, "documents"), "doc_id", "documents", "document", payload(None, file_name=name, title=F.concat(F.lit("T"), key), text=F.col("text")))


def policy_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(table(spark, sf_dir, "documents"), "doc_id", "documents", "policy", payload(None, lang=F.col("lang"), source=F.col("source"), n_chars=F.col("n_chars")))


def news_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    title = F.when(key % 5 == 0, NULL).when(key % 7 != 0, F.concat(F.lit("Page "), key))
    published = F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (key % 900).cast("int")), "EEE, dd MMM yyyy"), F.lit(" 03:04:05 GMT"))
    return staged(table(spark, sf_dir, "pages"), "page_id", "pages", "news", payload("entry", title=title, link=F.when(key % 11 != 0, F.col("url")), published=published))


def report_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 900).cast("int")), "yyyy-MM-dd")
    return staged(table(spark, sf_dir, "documents"), "doc_id", "documents", "monitor_report", payload(None, period=F.col("lang"), published_at=day))


def surveillance_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    agency = F.when(key % 9 == 0, NULL).when(key % 4 != 0, F.concat(F.lit("Unit "), key % 10))
    return staged(table(spark, sf_dir, "events").where("event_type = 'view'"), "event_id", "events", "surveillance_event", payload("row", agency_name=agency, date_time=iso("ts"), location=F.concat(F.lit("L"), F.col("user_id"))))


ALL = (uof_staging, incident_staging, arrest_staging, officer_staging, court_staging, document_staging, policy_staging, news_staging, report_staging, surveillance_staging)


def all_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's records; ids are unique within an entity type."""
    out = ALL[0](spark, sf_dir)
    for more in ALL[1:]:
        out = out.unionByName(more(spark, sf_dir))
    return out


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of documents, one without rows and one that is disabled."""
    named = table(spark, sf_dir, "documents").select(F.col("source").alias("id")).distinct().unionByName(spark.createDataFrame([("empty",)], "id string"))
    return named.select("id", F.when(F.col("id") == "src3", False).when(F.col("id") != "src5", True).alias("enabled"), F.when(F.col("id") != "src1", F.concat(F.lit("type_"), "id")).alias("entity_type"))
