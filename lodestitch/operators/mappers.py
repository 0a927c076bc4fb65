"""Staging records to entities: dispatch, ten mappers, edges, outcomes and dependencies.

A mapper gives one row for each record that it takes: id, source_id, raw_record_id, entity_type, its
outcome (status, reason), what it waits for (dep_type, dep_key, dep_value),
the edge's join key, and its entity's fields. All of it is column expressions.
Precedence: a payload of the wrong shape fails, then a missing key suspends,
then a broken constraint fails, else the record is ready.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from . import joins

#: Entity types by mapper; any other type goes to "unknown".
TYPES = {
    "incident": ("incident", "death"),
    "arrest": ("arrest",),
    "use_of_force": ("use_of_force", "officer_involved_shooting"),
    "officer": ("officer", "officer_certification"),
    "court_case": ("court_case", "public_records_request"),
    "document": ("document",),
    "news": ("news", "sentiment_survey"),
    "monitor_report": ("monitor_report",),
    "surveillance": ("surveillance_event",),
}

#: Table that each mapper fills, and the name of its entity in edges.
TARGETS = {
    "incident": ("incidents", "incident"),
    "arrest": ("arrests", "arrest"),
    "use_of_force": ("incidents", "incident"),
    "officer": ("officers", "officer"),
    "court_case": ("court_cases", "court_case"),
    "document": ("documents", "document"),
    "news": ("news_articles", "news_article"),
    "monitor_report": ("monitor_reports", "monitor_report"),
    "surveillance": ("surveillance_events", "surveillance_event"),
    "unknown": ("documents", "document"),
}

BAD_SHAPE = "payload object is not a map"
OUTCOME = ("id", "source_id", "raw_record_id", "entity_type", "status", "reason", "dep_type", "dep_key", "dep_value", "join_key")


def mapper_of(entity_type: Column) -> Column:
    out = F.lit("unknown")
    for name, types in TYPES.items():
        out = F.when(entity_type.isin(*types), name).otherwise(out)
    return out


def taken(staging: DataFrame, mapper: str) -> DataFrame:
    """Records of a mapper's types that are open: pending or suspended."""
    open_ = staging.where(F.col("status").isin("pending", "suspended"))
    if mapper == "unknown":
        known = [t for types in TYPES.values() for t in types]
        return open_.where(F.col("entity_type").isNull() | ~F.col("entity_type").isin(*known))
    return open_.where(F.col("entity_type").isin(*TYPES[mapper]))


def _shaped(staging: DataFrame, mapper: str, under: tuple[str, ...], *keys: str) -> DataFrame:
    """With obj, the value under the first present key of `under` (none: the whole payload), `opened`, its fields `keys`, and `fine`: both are objects. Each is parsed once."""
    parsed = taken(staging, mapper).withColumn("doc", jsonx.parse("payload"))
    if under:
        top = parsed.withColumn("top", jsonx.opened("doc", *under))
        parsed = top.withColumn("obj", F.coalesce(*(F.col("top")[k] for k in under), F.parse_json(F.lit("{}"))))
    else:
        parsed = parsed.withColumns({"top": jsonx.opened("doc"), "obj": F.col("doc")})
    shaped = parsed.withColumn(jsonx.OPENED, jsonx.opened("obj", *keys))
    shaped = shaped.withColumn("fine", F.col("top").isNotNull() & F.col(jsonx.OPENED).isNotNull())
    # a generator of one row: a filter on an outcome is not pushed below it, where each mention of a field would parse the payload again
    return shaped.select(*staging.columns, F.inline_outer(F.array(F.struct("doc", "top", "obj", jsonx.OPENED, "fine"))))


def _mapped(df: DataFrame, mapper: str, join_key: Column, suspends: list[tuple[Column, Column | str, str, str, Column | str]], fails: list[tuple[Column, str]], **fields: Column) -> DataFrame:
    """suspends: condition, reason, dependency type, key and value, in order; fails: condition and reason."""
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    fine = F.col("fine")
    status, reason = F.when(~fine, "failed"), F.when(~fine, BAD_SHAPE)
    dep = [F.when(~fine, F.lit(None).cast("string")) for _ in range(3)]
    for when, why, *waits in suspends:
        status, reason = status.when(when, "suspended"), reason.when(when, as_col(why))
        dep = [d.when(when, as_col(w)) for d, w in zip(dep, waits)]
    for when, why in fails:
        status, reason = status.when(when, "failed"), reason.when(when, why)
    keep = [c for c in ("id", "source_id", "raw_record_id", "entity_type") if c in df.columns]
    return df.select(
        *keep,
        F.lit(mapper).alias("mapper"),
        status.otherwise("ready").alias("status"),
        reason.otherwise(F.lit(None)).alias("reason"),
        *(d.otherwise(F.lit(None)).alias(n) for d, n in zip(dep, ("dep_type", "dep_key", "dep_value"))),
        join_key.cast("string").alias("join_key"),
        *(c.alias(n) for n, c in fields.items()),
    )


def _agency_fails(key: str = "agency_name") -> list[tuple[Column, str]]:
    return [(jsonx.is_null_key(jsonx.OPENED, key), "agency name is null")]


def map_incidents(staging: DataFrame) -> DataFrame:
    df = _shaped(staging, "incident", ("attributes", "row"), "incident_number", "case_number", "id", "agency_name", "date_time", "occurred_at", "location").withColumns({"number": jsonx.first_truthy(jsonx.OPENED, "incident_number", "case_number", "id"), "when_text": jsonx.first_truthy(jsonx.OPENED, "date_time", "occurred_at")})
    return _mapped(
        df, "incident", F.col("number"),
        [(F.col("number").isNull(), "Missing incident_number/case_number", "incident", "external_id", "UNKNOWN")],
        _agency_fails(),
        agency_name=jsonx.get_text(jsonx.OPENED, "agency_name", "Unknown"),
        incident_type=F.col("entity_type"),
        occurred_at=jsonx.iso_timestamp(F.col("when_text")),
        location=jsonx.get_text(jsonx.OPENED, "location"),
        external_ids=jsonx.string_map(source_id=F.col("source_id"), incident_number=F.col("number")),
        data=F.to_json("obj"),
    )


def map_arrests(staging: DataFrame) -> DataFrame:
    """With first_name and last_name of the person, whose id is the record's; null where no person is named."""
    df = _shaped(staging, "arrest", ("attributes", "row"), "booking_number", "arrest_number", "person_name", "name", "arrested_at").withColumn("number", jsonx.first_truthy(jsonx.OPENED, "booking_number", "arrest_number"))
    person = jsonx.first_truthy(jsonx.OPENED, "person_name", "name")
    return _mapped(
        df, "arrest", F.col("number"),
        [(F.col("number").isNull(), "Missing booking_number", "arrest", "booking_number", "UNKNOWN")],
        [],
        first_name=person,
        last_name=F.when(person.isNotNull(), ""),
        person_id=F.when(person.isNotNull(), F.col("id")),
        arrested_at=jsonx.iso_timestamp(jsonx.get_text(jsonx.OPENED, "arrested_at")),
        booking_number=F.col("number"),
        external_ids=jsonx.string_map(source_id=F.col("source_id"), booking_number=F.col("number")),
    )


def map_use_of_force(staging: DataFrame, officers: DataFrame) -> DataFrame:
    """With officer_id: the officer of the employee id, else of the badge."""
    df = (
        _shaped(staging, "use_of_force", ("attributes", "row"), "officer_badge_number", "badge_number", "officer_employee_id", "employee_id", "incident_number", "case_number", "id", "officer_name", "agency_name", "date_time", "location")
        .withColumn("badge", jsonx.first_truthy(jsonx.OPENED, "officer_badge_number", "badge_number"))
        .withColumn("employee", jsonx.first_truthy(jsonx.OPENED, "officer_employee_id", "employee_id"))
        .withColumn("number", jsonx.first_truthy(jsonx.OPENED, "incident_number", "case_number", "id"))
    )
    df = joins.find_officers(df, officers, "employee", "badge")
    key = F.coalesce("badge", "employee")
    return _mapped(
        df, "use_of_force", F.col("number"),
        [
            (key.isNull(), "Missing officer_badge_number/officer_employee_id for UOF", "officer", "badge_number", jsonx.get_text(jsonx.OPENED, "officer_name", "UNKNOWN")),
            (F.col("officer_id").isNull(), F.concat(F.lit("Officer not found for badge/employee_id "), key), "officer", F.when(F.col("badge").isNotNull(), "badge_number").otherwise("employee_id"), key),
            (F.col("number").isNull(), "Missing incident_number for UOF", "incident", "external_id", "UNKNOWN"),
        ],
        _agency_fails(),
        officer_id=F.col("officer_id"),
        officer_key=key,
        agency_name=jsonx.get_text(jsonx.OPENED, "agency_name", "Phoenix Police Department"),
        incident_type=F.col("entity_type"),
        occurred_at=jsonx.iso_timestamp(jsonx.get_text(jsonx.OPENED, "date_time")),
        location=jsonx.get_text(jsonx.OPENED, "location"),
        external_ids=jsonx.string_map(source_id=F.col("source_id"), incident_number=F.col("number")),
        data=F.to_json("obj"),
    )


def map_officers(staging: DataFrame) -> DataFrame:
    df = (
        _shaped(staging, "officer", ("row", "attributes"), "badge_number", "badge", "employee_id", "officer_id", "name", "agency_name", "first_name", "last_name", "status")
        .withColumn("badge", jsonx.first_truthy(jsonx.OPENED, "badge_number", "badge"))
        .withColumn("employee", jsonx.first_truthy(jsonx.OPENED, "employee_id", "officer_id"))
    )
    key = F.coalesce("badge", "employee")
    return _mapped(
        df, "officer", key,
        [(key.isNull(), "Missing badge_number/employee_id for officer", "officer", "badge_number", jsonx.get_text(jsonx.OPENED, "name", "UNKNOWN"))],
        _agency_fails(),
        agency_name=jsonx.get_text(jsonx.OPENED, "agency_name", "Unknown"),
        first_name=jsonx.get_text(jsonx.OPENED, "first_name"),
        last_name=jsonx.get_text(jsonx.OPENED, "last_name"),
        badge_number=F.col("badge"),
        employee_id=F.col("employee"),
        external_ids=jsonx.string_map(source_id=F.col("source_id")),
        officer_status=jsonx.get_text(jsonx.OPENED, "status"),
    )


def map_court_cases(staging: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The least id of a case number is ready, if it is not stored yet; the others fail."""
    df = _shaped(staging, "court_case", ("docket", "row"), "docket_number", "case_number", "court", "date_filed", "status").withColumn("number", jsonx.first_truthy(jsonx.OPENED, "docket_number", "case_number"))
    firsts = df.where(F.col("fine") & F.col("number").isNotNull()).groupBy("number").agg(F.min("id").alias("__first"))
    if stored is not None:
        firsts = firsts.join(stored.select(F.col("case_number").alias("number")).distinct(), "number", "left_anti")
    df = df.join(firsts, "number", "left")
    return _mapped(
        df, "court_case", F.col("number"),
        [(F.col("number").isNull(), "Missing docket_number/case_number", "court_case", "case_number", "UNKNOWN")],
        [(F.col("__first").isNull() | (F.col("__first") != F.col("id")), "duplicate case_number")],
        case_number=F.col("number"),
        court=jsonx.get_text(jsonx.OPENED, "court"),
        filed_at=jsonx.iso_timestamp(jsonx.get_text(jsonx.OPENED, "date_filed")),
        case_status=jsonx.get_text(jsonx.OPENED, "status"),
        external_ids=jsonx.string_map(source_id=F.col("source_id"), case_number=F.col("number")),
    )


def map_documents(staging: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """raw gives the file path of each record."""
    df = _shaped(staging, "document", (), "file_name", "title", "text")
    if raw is None:
        df = df.withColumn("file_path", F.lit(None).cast("string"))
    else:
        df = df.join(raw.select(F.col("id").alias("raw_record_id"), "file_path"), "raw_record_id", "left")
    title = F.coalesce(jsonx.first_truthy(jsonx.OPENED, "file_name"), jsonx.get_text(jsonx.OPENED, "title"))
    return _mapped(
        df, "document", F.lit(None), [], [],
        doc_type=F.coalesce(F.nullif("entity_type", F.lit("")), F.lit("document")),
        title=title,
        file_path=F.col("file_path"),
        text=jsonx.get_text(jsonx.OPENED, "text"),
        external_ids=jsonx.string_map(source_id=F.col("source_id")),
    )


def map_news(staging: DataFrame) -> DataFrame:
    df = _shaped(staging, "news", ("entry",), "title", "link", "published", "summary")
    title, url = jsonx.get_text(jsonx.OPENED, "title", "Untitled"), jsonx.get_text(jsonx.OPENED, "link")
    return _mapped(
        df, "news", F.lit(None), [], [(title.isNull(), "title is null"), (url.isNull(), "url is null")],
        title=title,
        url=url,
        published_at=jsonx.feed_timestamp(jsonx.get_text(jsonx.OPENED, "published")),
        content=jsonx.get_text(jsonx.OPENED, "summary"),
        external_ids=jsonx.string_map(source_id=F.col("source_id")),
    )


def map_monitor_reports(staging: DataFrame) -> DataFrame:
    df = _shaped(staging, "monitor_report", (), "period", "published_at")
    return _mapped(
        df, "monitor_report", F.lit(None), [], [],
        agency_id=F.lit(None).cast("bigint"),
        period=jsonx.get_text(jsonx.OPENED, "period"),
        report_date=jsonx.iso_timestamp(jsonx.get_text(jsonx.OPENED, "published_at")),
        compliance_data=F.to_json("doc"),
        document_id=F.lit(None).cast("bigint"),
    )


def map_surveillance(staging: DataFrame) -> DataFrame:
    df = _shaped(staging, "surveillance", ("row", "attributes"), "agency_name", "event_type", "date_time", "location")
    return _mapped(
        df, "surveillance", F.lit(None), [], _agency_fails(),
        agency_name=jsonx.get_text(jsonx.OPENED, "agency_name", "Unknown"),
        event_type=F.coalesce(F.nullif("entity_type", F.lit("")), jsonx.get_text(jsonx.OPENED, "event_type", "alpr")),
        occurred_at=jsonx.iso_timestamp(jsonx.get_text(jsonx.OPENED, "date_time")),
        location=jsonx.get_text(jsonx.OPENED, "location"),
        event_metadata=F.to_json("obj"),
    )


def map_unknown(staging: DataFrame) -> DataFrame:
    df = _shaped(staging, "unknown", ())
    return _mapped(
        df, "unknown", F.lit(None), [], [],
        doc_type=F.lit("raw_staging"),
        title=F.concat(F.lit("Staging "), F.col("id")),
        text=F.substring(F.to_json("doc"), 1, 5_000),
        external_ids=jsonx.string_map(staging_id=F.col("id")),
    )


MAPPERS: dict[str, Callable[..., DataFrame]] = {
    "incident": map_incidents,
    "arrest": map_arrests,
    "use_of_force": map_use_of_force,
    "officer": map_officers,
    "court_case": map_court_cases,
    "document": map_documents,
    "news": map_news,
    "monitor_report": map_monitor_reports,
    "surveillance": map_surveillance,
    "unknown": map_unknown,
}


def dispatch_counts(staging: DataFrame) -> DataFrame:
    return staging.groupBy(mapper_of(F.col("entity_type")).alias("mapper")).agg(F.count(F.lit(1)).alias("n_rows"))


def entities(mapped: DataFrame) -> DataFrame:
    """The ready rows of one mapper, with the entity's fields alone; its id is the record's."""
    drop = {"raw_record_id", "entity_type", "mapper", "status", "reason", "dep_type", "dep_key", "dep_value", "join_key", "officer_id", "officer_key"}
    names = {"officer_status": "status", "case_status": "status"}
    ready = mapped.where(F.col("status") == "ready")
    return ready.select(*(F.col(c).alias(names.get(c, c)) for c in mapped.columns if c not in drop))


def links(mapped: DataFrame, target: str) -> DataFrame:
    """An edge from each ready record to its entity; officers are involved in the incidents of use of force."""
    ready = mapped.where(F.col("status") == "ready")
    edges = ready.select(*_edge("staging", F.col("id"), target, F.col("id"), "derived_from", F.col("join_key")))
    if "officer_id" in mapped.columns:
        edges = edges.unionByName(ready.select(*_edge("officer", F.col("officer_id"), "incident", F.col("id"), "involved_in", F.col("officer_key"))))
    return edges


def _edge(source: str, source_id: Column, target: str, target_id: Column, relation: str, key: Column) -> list[Column]:
    return [
        F.lit(source).alias("source_entity"),
        source_id.alias("source_id"),
        F.lit(target).alias("target_entity"),
        target_id.alias("target_id"),
        F.lit(relation).alias("relation_type"),
        F.lit(1.0).alias("confidence"),
        key.alias("join_key"),
    ]


def outcomes(*mapped: DataFrame) -> DataFrame:
    """Status and reason of every record, of any number of mappers."""
    out = None
    for m in mapped:
        own = m.select(*(F.col(c) if c in m.columns else F.lit(None).alias(c) for c in (*OUTCOME, "mapper")))
        out = own if out is None else out.unionByName(own)
    return out


def updated_staging(staging: DataFrame, outcome: DataFrame) -> DataFrame:
    """Staging with its new status and reason, each row once; a ready record has no reason."""
    new = outcome.groupBy("id").agg(F.min(F.struct("status", "reason")).alias("__new")).select("id", F.col("__new.status").alias("__status"), F.col("__new.reason").alias("__reason"))
    joined = staging.join(new, "id", "left")
    changed = F.col("__status").isNotNull()
    return joined.withColumn("suspension_reason", F.when(changed, F.col("__reason")).otherwise(F.col("suspension_reason"))).withColumn("status", F.coalesce("__status", "status")).drop("__status", "__reason").select(*staging.columns)


def dependencies(outcome: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """What suspended records wait for, once for each record, type, key and value; known ones keep their attempts and are left out."""
    keys = ["staging_record_id", "required_entity_type", "required_key", "required_value"]
    found = outcome.where(F.col("status") == "suspended").select(F.col("id").alias(keys[0]), F.col("dep_type").alias(keys[1]), F.col("dep_key").alias(keys[2]), F.col("dep_value").alias(keys[3]))
    for k in keys[1:]:
        found = found.where(F.col(k) != "")
    found = found.distinct()
    if known is not None:
        found = found.join(known.select(*keys), keys, "left_anti")
    return found.withColumn("status", F.lit("waiting")).withColumn("attempts", F.lit(0))


def run_stats(outcome: DataFrame) -> DataFrame:
    """processed: records that end ready; suspended and failed truly counted."""
    return outcome.agg(*(F.count_if(F.col("status") == s).alias(n) for s, n in (("ready", "processed"), ("suspended", "suspended"), ("failed", "failed"))))
