"""Set-based joins in the place of lookups by record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def agency_id(name: str):
    return F.xxhash64(name)


def new_agencies(names: DataFrame, agencies: DataFrame, state: str = "AZ") -> DataFrame:
    """Agencies named in names (agency_name) that are not there yet, each once."""
    missing = names.where("agency_name is not null").select(F.col("agency_name").alias("name")).distinct().join(agencies.select("name").distinct(), "name", "left_anti")
    return missing.select(agency_id("name").alias("id"), "name", F.lit(state).alias("state"))


def get_or_create_agencies(names: DataFrame, agencies: DataFrame, state: str = "AZ") -> DataFrame:
    """All agencies, old and new; the least id stands for a repeated name."""
    return agencies.groupBy("name").agg(F.min_by(F.struct("id", "state"), "id").alias("x")).select("x.id", "name", "x.state").unionByName(new_agencies(names, agencies, state))


def with_agency(rows: DataFrame, agencies: DataFrame) -> DataFrame:
    """agency_id in the place of agency_name; agencies holds a name once."""
    ids = agencies.select(F.col("name").alias("agency_name"), F.col("id").alias("agency_id"))
    return rows.join(ids, "agency_name", "left").drop("agency_name")


def find_officers(rows: DataFrame, officers: DataFrame, employee: str, badge: str) -> DataFrame:
    """officer_id by employee id, else by badge: two equi-joins; the least id stands for a repeated key."""
    for key, column in ((employee, "employee_id"), (badge, "badge_number")):
        least = officers.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(key)).agg(F.min("id").alias(f"__{column}"))
        rows = rows.join(least, key, "left")
    return rows.withColumn("officer_id", F.coalesce("__employee_id", "__badge_number")).drop("__employee_id", "__badge_number")


def find_officers_by_external_id(rows: DataFrame, officers: DataFrame, key: str, value: str) -> DataFrame:
    """officer_id of the least officer with external_ids[key] = value, for columns key and value of rows."""
    owned = officers.select("id", F.explode("external_ids").alias(key, value)).groupBy(key, value).agg(F.min("id").alias("officer_id"))
    return rows.join(owned, [key, value], "left")


#: Declared references: (table, column) to table.
REFERENCES = {
    ("raw_records", "source_id"): "data_sources",
    ("staging_records", "raw_record_id"): "raw_records",
    ("staging_records", "source_id"): "data_sources",
    ("pending_synthesis", "staging_record_id"): "staging_records",
    ("officers", "agency_id"): "agencies",
    ("incidents", "agency_id"): "agencies",
    ("complaints", "agency_id"): "agencies",
    ("surveillance_events", "agency_id"): "agencies",
    ("internal_affairs_cases", "agency_id"): "agencies",
    ("internal_affairs_cases", "officer_id"): "officers",
    ("monitor_reports", "agency_id"): "agencies",
    ("monitor_reports", "document_id"): "documents",
    ("arrests", "incident_id"): "incidents",
    ("arrests", "person_id"): "persons",
    ("charges", "arrest_id"): "arrests",
    ("documents", "source_id"): "data_sources",
    ("news_articles", "source_id"): "data_sources",
}


def navigate(rows: DataFrame, column: str, target: DataFrame, *fields: str) -> DataFrame:
    """Rows with fields of the referenced row, named <column without _id>_<field>; null where there is none."""
    name = column.removesuffix("_id")
    found = target.select(F.col("id").alias(column), *(F.col(f).alias(f"{name}_{f}") for f in fields))
    return rows.join(found, column, "left")


def follow(tables: dict[str, DataFrame], table: str, column: str, *fields: str) -> DataFrame:
    """Rows of a table with fields of what its declared reference `column` points to."""
    return navigate(tables[table], column, tables[REFERENCES[table, column]], *fields)


def link_endpoints(links: DataFrame, side: str, entity: str, target: DataFrame, *fields: str) -> DataFrame:
    """Edges whose source or target is of the entity, with fields of it."""
    ids = target.select(F.col("id").alias(f"{side}_id"), *(F.col(f).alias(f"{side}_{f}") for f in fields))
    return links.where(F.col(f"{side}_entity") == entity).join(ids, f"{side}_id")
