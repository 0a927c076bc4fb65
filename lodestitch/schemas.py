"""Columns of the stored tables, as DDL; JSON is text at rest and Variant inside a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_ENVELOPE = "content_type string, payload string, file_path string, checksum string, source_id string, batch_id string, metadata string, position bigint"

TABLES = {
    "data_sources": "id string, name string, category string, adapter string, access_mode string, schedule string, availability_window string, enabled boolean, last_run_at timestamp, last_error string, config string",
    "raw_records": "id bigint, source_id string, batch_id string, content_type string, raw_data string, file_path string, checksum string, ingested_at timestamp",
    "staging_records": "id bigint, raw_record_id bigint, source_id string, entity_type string, payload string, record_hash string, status string, suspension_reason string",
    "pending_synthesis": "staging_record_id bigint, required_entity_type string, required_key string, required_value string, status string, attempts int, last_error string",
    "agencies": "id bigint, name string, state string, jurisdiction string, external_ids map<string,string>",
    "officers": "id bigint, agency_id bigint, first_name string, last_name string, badge_number string, employee_id string, external_ids map<string,string>, status string",
    "persons": "id bigint, first_name string, last_name string, date_of_birth string, external_ids map<string,string>",
    "incidents": "id bigint, agency_id bigint, incident_type string, occurred_at timestamp, location string, external_ids map<string,string>, data string",
    "complaints": "id bigint, agency_id bigint, complaint_number string, filed_at timestamp, status string, data string",
    "arrests": "id bigint, incident_id bigint, person_id bigint, arrested_at timestamp, booking_number string, external_ids map<string,string>",
    "charges": "id bigint, arrest_id bigint, charge_code string, description string, data string",
    "court_cases": "id bigint, case_number string, court string, filed_at timestamp, status string, external_ids map<string,string>",
    "documents": "id bigint, source_id string, doc_type string, title string, file_path string, text string, published_at timestamp, external_ids map<string,string>",
    "news_articles": "id bigint, source_id string, title string, url string, published_at timestamp, content string, external_ids map<string,string>",
    "surveillance_events": "id bigint, agency_id bigint, event_type string, occurred_at timestamp, location string, event_metadata string",
    "internal_affairs_cases": "id bigint, agency_id bigint, officer_id bigint, case_number string, status string, data string",
    "monitor_reports": "id bigint, agency_id bigint, period string, report_date timestamp, compliance_data string, document_id bigint",
    "entity_links": "source_entity string, source_id bigint, target_entity string, target_id bigint, relation_type string, confidence double, join_key string, link_metadata string",
    "synthesis_runs": "run_id bigint, started_at timestamp, completed_at timestamp, status string, processed bigint, suspended bigint, failed bigint",
    "waiting_deps": "staging_record_id bigint, required_entity_type string, required_key string, required_value string, batch_id string",
    "arrived_keys": "required_entity_type string, required_key string, required_value string, batch_id string",
    "decided_deps": "staging_record_id bigint, required_entity_type string, required_key string, required_value string, batch_id string",
    "status_snapshot": "staging_id bigint, run_id bigint, status string, reason string",
    "status_log": "staging_id bigint, run_id bigint, status string, reason string",
}

STAGING_STATES = ("pending", "ready", "suspended", "failed")
DEPENDENCY_STATES = ("waiting", "resolved", "expired")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], RAW_ENVELOPE if name == "raw_envelope" else TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in its order, cast to its types; missing ones are null."""
    wanted = df.sparkSession.createDataFrame([], TABLES[name]).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))
