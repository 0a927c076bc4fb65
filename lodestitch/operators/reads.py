"""Bounded reads of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mappers

#: Greatest limit of each read.
MOST = {"incidents": 500, "officers": 500, "links": 1_000, "suspended": 1_000}


def _bounded(limit: int, offset: int, most: int) -> None:
    if not 0 <= limit <= most:
        raise ValueError(f"limit must be 0 to {most}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def latest_incidents(incidents: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """By occurred_at, the latest first and those without one before all; ties by id."""
    _bounded(limit, offset, MOST["incidents"])
    return incidents.orderBy(F.desc_nulls_first("occurred_at"), "id").offset(offset).limit(limit)


def latest_of_staging(staging: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """latest_incidents of the incidents that staging records give: only ids and times are mapped of all records, and whole entities of those of the page."""
    page = latest_incidents(mappers.map_incidents(staging).where("status = 'ready'").select("id", "occurred_at"), limit, offset)
    rows = mappers.entities(mappers.map_incidents(staging.join(F.broadcast(page.select("id")), "id", "left_semi")))
    return latest_incidents(rows, limit)


def officer_page(officers: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    _bounded(limit, offset, MOST["officers"])
    return officers.orderBy("id").offset(offset).limit(limit)


def link_page(links: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    _bounded(limit, offset, MOST["links"])
    return links.orderBy("source_entity", "source_id", "target_entity", "target_id", "relation_type").offset(offset).limit(limit)


def suspended_page(staging: DataFrame, limit: int = 100) -> DataFrame:
    _bounded(limit, 0, MOST["suspended"])
    return staging.where(F.col("status") == "suspended").orderBy("id").limit(limit)


def staging_count(staging: DataFrame) -> DataFrame:
    return staging.agg(F.count(F.lit(1)).alias("staging_records"))
