"""One synthesis pass over all open staging records, and the loop with the resolver."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import conform, empty
from ..session import cut
from . import joins, mappers, resolver


@dataclass
class Tables:
    """What a pass reads and what it gives; entity tables by name."""

    staging: DataFrame
    entities: dict[str, DataFrame] = field(default_factory=dict)
    links: DataFrame | None = None
    deps: DataFrame | None = None
    outcome: DataFrame | None = None

    def settled(self) -> Tables:
        """The same tables with their lineage cut: between passes, and before several sinks read them."""
        settle = lambda df: None if df is None else cut(df)
        return Tables(cut(self.staging), {n: cut(df) for n, df in self.entities.items()}, settle(self.links), settle(self.deps), settle(self.outcome))

    def of(self, spark: SparkSession, name: str) -> DataFrame:
        return self.entities.get(name, empty(spark, name))


def synthesize(spark: SparkSession, tables: Tables, raw: DataFrame | None = None, only: tuple[str, ...] = tuple(mappers.MAPPERS)) -> Tables:
    """Officers first, then all other records see the old and the new officers.

    `only` names the mappers to run: a source of few entity types needs no
    others. The result's frames are lazy: settle them before a further pass.
    """
    staging = tables.staging
    mapped = {"officer": mappers.map_officers(staging)}
    new_officers = mappers.entities(mapped["officer"])
    known = tables.of(spark, "officers").select("id", "badge_number", "employee_id").unionByName(new_officers.select("id", "badge_number", "employee_id"))
    needs = {"use_of_force": known, "court_case": tables.of(spark, "court_cases"), "document": raw}
    for name in mappers.MAPPERS:
        if name in only and name != "officer":
            mapped[name] = mappers.MAPPERS[name](staging, needs[name]) if name in needs else mappers.MAPPERS[name](staging)

    named = None
    for name in ("incident", "use_of_force", "officer", "surveillance"):
        if name not in mapped:
            continue
        names = mapped[name].where("status = 'ready'").select("agency_name")
        named = names if named is None else named.unionByName(names)
    agencies = joins.get_or_create_agencies(named, tables.of(spark, "agencies").select("id", "name", "state"))

    entities = dict(tables.entities)
    entities["agencies"] = conform(agencies, "agencies")
    links = tables.links
    for name, frame in mapped.items():
        table, entity = mappers.TARGETS[name]
        rows = mappers.entities(frame)
        if "agency_name" in rows.columns:
            rows = joins.with_agency(rows, agencies)
        if name == "arrest":
            persons = rows.where("person_id is not null").select(F.col("person_id").alias("id"), "first_name", "last_name", F.create_map(F.lit("source_id"), F.col("source_id")).alias("external_ids"))
            entities["persons"] = tables.of(spark, "persons").unionByName(conform(persons, "persons"))
        rows = conform(rows, table)
        entities[table] = entities[table].unionByName(rows) if table in entities else rows
        edges = mappers.links(frame, entity)
        links = edges if links is None else links.unionByName(edges)
    outcome = mappers.outcomes(*mapped.values())
    deps = mappers.dependencies(outcome, tables.deps)
    deps = deps if tables.deps is None else tables.deps.unionByName(deps)
    return Tables(mappers.updated_staging(staging, outcome), entities, links, deps, outcome)


def resolve_pass(spark: SparkSession, tables: Tables) -> Tables:
    """One resolver pass over the dependencies of tables."""
    there = resolver.available(*(tables.of(spark, n) for n in ("officers", "incidents", "arrests", "court_cases")))
    after = resolver.resolve(tables.deps, there)
    return Tables(resolver.released(tables.staging, tables.deps, after), tables.entities, tables.links, after, tables.outcome)
