import pytest
from pyspark.sql import functions as F

from lodestitch.operators import joins, mappers, resolver, synthesis
from lodestitch.schemas import conform, empty

STAGING = "id bigint, raw_record_id bigint, source_id string, entity_type string, payload string, status string, suspension_reason string"


def staged(spark, *rows):
    return spark.createDataFrame([(n, n, "s", kind, payload, "pending", None) for n, (kind, payload) in enumerate(rows, 1)], STAGING)


def officers(spark, *rows):
    return spark.createDataFrame(list(rows), "id bigint, badge_number string, employee_id string")


def one(df):
    (row,) = df.collect()
    return row


@pytest.mark.parametrize(
    ("payload", "status", "reason", "key"),
    [
        ('{"attributes":{"incident_number":"A1","date_time":"2025-01-02T03:04:05","agency_name":"X"}}', "ready", None, "A1"),
        ('{"row":{"incident_number":"","case_number":0,"id":7}}', "ready", None, "7"),
        ('{"row":{"location":"L"}}', "suspended", "Missing incident_number/case_number", None),
        ('{"attributes":null,"row":{"id":1}}', "failed", "payload object is not a map", None),
        ('{"row":{"id":1,"agency_name":null}}', "failed", "agency name is null", "1"),
        ('{"row":{"id":"0"}}', "ready", None, "0"),
        ('{"row":{"id":1,"date_time":"01/02/2025"}}', "ready", None, "1"),
        ("not json", "failed", "payload object is not a map", None),
        (None, "failed", "payload object is not a map", None),
        ("{}", "suspended", "Missing incident_number/case_number", None),
    ],
)
def test_incidents(spark, payload, status, reason, key):
    row = one(mappers.map_incidents(staged(spark, ("incident", payload))))
    assert (row.status, row.reason, row.join_key) == (status, reason, key)
    if status == "suspended":
        assert (row.dep_type, row.dep_key, row.dep_value) == ("incident", "external_id", "UNKNOWN")


def test_incident_fields(spark):
    rows = mappers.map_incidents(staged(spark, ("incident", '{"attributes":{"incident_number":"A1","date_time":"2025-01-02T03:04:05"}}'), ("death", '{"row":{"id":7,"date_time":"01/02/2025"}}'))).orderBy("id").collect()
    assert str(rows[0].occurred_at) == "2025-01-02 03:04:05" and rows[1].occurred_at is None
    assert rows[0].agency_name == "Unknown" and rows[1].incident_type == "death"
    assert rows[1].external_ids == {"source_id": "s", "incident_number": "7"}


def test_arrests(spark):
    rows = mappers.map_arrests(staged(spark, ("arrest", '{"attributes":{"arrest_number":55,"person_name":"P Q"}}'), ("arrest", '{"attributes":{"arrest_number":55}}'), ("arrest", '{"attributes":{"booking_number":0}}'))).orderBy("id").collect()
    assert (rows[0].first_name, rows[0].last_name, rows[0].person_id) == ("P Q", "", 1)
    assert rows[1].status == "ready" and rows[1].person_id is None
    assert (rows[2].status, rows[2].reason) == ("suspended", "Missing booking_number")


def test_use_of_force(spark):
    known = officers(spark, (1, "B1", "E1"), (2, "B2", None), (3, "B1", None))
    rows = mappers.map_use_of_force(
        staged(
            spark,
            ("use_of_force", '{"row":{"badge_number":"B1","incident_number":"I1"}}'),
            ("use_of_force", '{"row":{"badge_number":"B9","incident_number":"I1"}}'),
            ("officer_involved_shooting", '{"row":{"employee_id":"E9","incident_number":"I1"}}'),
            ("use_of_force", '{"row":{"employee_id":"E1","badge_number":"B2","incident_number":"I1"}}'),
            ("use_of_force", '{"row":{"officer_name":"N"}}'),
            ("use_of_force", '{"row":{"badge_number":"B1"}}'),
        ),
        known,
    )
    got = {r.id: r for r in rows.collect()}
    assert (got[1].status, got[1].officer_id, got[1].agency_name) == ("ready", 1, "Phoenix Police Department")
    assert (got[2].status, got[2].dep_key, got[2].dep_value) == ("suspended", "badge_number", "B9")
    assert (got[3].dep_type, got[3].dep_key, got[3].dep_value) == ("officer", "employee_id", "E9")
    assert (got[4].officer_id, got[4].officer_key) == (1, "B2")
    assert (got[5].reason, got[5].dep_value) == ("Missing officer_badge_number/officer_employee_id for UOF", "N")
    assert (got[6].status, got[6].reason) == ("suspended", "Missing incident_number for UOF")
    edges = {(r.source_entity, r.source_id, r.target_id, r.relation_type, r.join_key) for r in mappers.links(rows, "incident").collect()}
    assert edges == {("staging", 1, 1, "derived_from", "I1"), ("officer", 1, 1, "involved_in", "B1"), ("staging", 4, 4, "derived_from", "I1"), ("officer", 1, 4, "involved_in", "B2")}


def test_officers(spark):
    rows = mappers.map_officers(staged(spark, ("officer", '{"row":{"badge":7,"first_name":"F"}}'), ("officer_certification", '{"row":{"name":"N"}}'))).orderBy("id").collect()
    assert (rows[0].badge_number, rows[0].employee_id, rows[0].first_name, rows[0].agency_name) == ("7", None, "F", "Unknown")
    assert (rows[1].status, rows[1].dep_value) == ("suspended", "N")


def test_court_cases(spark):
    rows = staged(spark, ("court_case", '{"docket":{"docket_number":"D"}}'), ("court_case", '{"docket":{"docket_number":"D"}}'), ("public_records_request", '{"foia":{"id":1}}'), ("court_case", '{"row":{"case_number":"S"}}'))
    stored = spark.createDataFrame([("S",)], "case_number string")
    got = {r.id: (r.status, r.reason) for r in mappers.map_court_cases(rows, stored).collect()}
    assert got == {1: ("ready", None), 2: ("failed", "duplicate case_number"), 3: ("suspended", "Missing docket_number/case_number"), 4: ("failed", "duplicate case_number")}


def test_other_mappers(spark):
    rows = staged(
        spark,
        ("document", '{"file_name":"a.pdf","text":"t"}'),
        ("news", '{"entry":{"link":"u"}}'),
        ("news", '{"entry":{"title":null,"link":"u"}}'),
        ("sentiment_survey", '{"row":{"q":1}}'),
        ("surveillance_event", '{"row":{}}'),
        ("geography", '{"x":"%s"}' % ("y" * 6000)),
        ("monitor_report", '{"period":"Q1"}'),
        (None, "[1]"),
    )
    doc = one(mappers.map_documents(rows))
    assert (doc.status, doc.title, doc.join_key, doc.doc_type) == ("ready", "a.pdf", None, "document")
    news = {r.id: (r.status, r.reason, r.title) for r in mappers.map_news(rows).collect()}
    assert news == {2: ("ready", None, "Untitled"), 3: ("failed", "title is null", None), 4: ("failed", "url is null", "Untitled")}
    seen = one(mappers.map_surveillance(rows))
    assert (seen.status, seen.agency_name, seen.event_type) == ("ready", "Unknown", "surveillance_event")
    other = {r.id: r for r in mappers.map_unknown(rows).collect()}
    assert (other[6].doc_type, len(other[6].text), other[6].title) == ("raw_staging", 5000, "Staging 6") and other[8].status == "failed"
    assert one(mappers.map_monitor_reports(rows)).period == "Q1"


def test_every_record_has_one_outcome_and_ready_ones_one_edge(spark):
    rows = staged(
        spark,
        ("officer", '{"row":{"badge":"B1"}}'),
        ("use_of_force", '{"row":{"badge_number":"B1","incident_number":"I1"}}'),
        ("use_of_force", '{"row":{"badge_number":"B2","incident_number":"I2"}}'),
        ("incident", '{"row":{"id":1,"agency_name":"A"}}'),
        ("arrest", '{"row":{"booking_number":5,"name":"P"}}'),
        ("court_case", '{"row":{"case_number":"C"}}'),
        ("document", '{"title":"T"}'),
        ("news", '{"entry":{"link":"u"}}'),
        ("monitor_report", "{}"),
        ("surveillance_event", '{"row":{"agency_name":"A"}}'),
        ("policy", "{}"),
        ("incident", '{"row":{}}'),
    )
    first = synthesis.synthesize(spark, synthesis.Tables(rows)).settled()
    status = {r.id: r.status for r in first.outcome.collect()}
    assert sorted(status) == list(range(1, 13))
    ready = {k for k, v in status.items() if v == "ready"}
    assert ready == set(range(1, 12)) - {3}  # record 2 sees the officer of the same batch
    assert sorted(r.source_id for r in first.links.where("relation_type = 'derived_from'").collect()) == sorted(ready)
    assert {r.name for r in first.entities["agencies"].collect()} == {"Unknown", "A", "Phoenix Police Department"}
    assert first.entities["arrests"].columns == empty(spark, "arrests").columns and one(first.entities["persons"]).first_name == "P"
    stats = one(mappers.run_stats(first.outcome))
    assert (stats.processed, stats.suspended, stats.failed) == (10, 2, 0)
    # the missing officer arrives: the next pass releases the record, the one after maps it
    late = conform(officers(spark, (77, "B2", None)), "officers")
    given = synthesis.Tables(first.staging, {**first.entities, "officers": first.entities["officers"].unionByName(late)}, None, first.deps)
    after = synthesis.resolve_pass(spark, given).settled()
    assert {(r.staging_record_id, r.status, r.attempts) for r in after.deps.collect()} == {(3, "resolved", 0), (12, "waiting", 1)}
    assert after.staging.where("id = 3").first().status == "pending"
    again = synthesis.synthesize(spark, after, only=("use_of_force",)).settled()
    assert again.staging.where("id = 3").first().status == "ready"


def test_dependencies_are_emitted_once(spark):
    outcome = mappers.map_incidents(staged(spark, ("incident", '{"row":{}}'), ("incident", '{"row":{}}')))
    first = mappers.dependencies(outcome)
    assert first.count() == 2
    assert mappers.dependencies(outcome, first.where("staging_record_id = 1")).count() == 1


def test_resolver(spark):
    deps = spark.createDataFrame(
        [(1, "officer", "badge_number", "B", "waiting", 3), (2, "officer", "badge_number", "B", "waiting", 0), (3, "officer", "employee_id", "X", "waiting", 9), (4, "officer", "employee_id", "X", "waiting", 10), (5, "planet", "k", "B", "waiting", 0), (6, "incident", "external_id", "UNKNOWN", "waiting", 0), (7, "incident", "incident_number", "I", "waiting", 0), (8, "officer", "badge_number", "B", "expired", 11), (9, "court_case", "case_number", None, "waiting", 0)],
        "staging_record_id bigint, required_entity_type string, required_key string, required_value string, status string, attempts int",
    )
    incidents = spark.createDataFrame([({"incident_number": "I", "external_id": "UNKNOWN"},)], "external_ids map<string,string>")
    there = resolver.available(officers(spark, (1, "B", None)), incidents)
    after = resolver.resolve(deps, there)
    assert {r.staging_record_id: (r.status, r.attempts) for r in after.collect()} == {1: ("resolved", 3), 2: ("resolved", 0), 3: ("waiting", 10), 4: ("expired", 11), 5: ("waiting", 1), 6: ("waiting", 1), 7: ("resolved", 0), 8: ("expired", 11), 9: ("waiting", 1)}
    assert resolver.resolved_count(deps, after).first().n_resolved == 3
    rows = spark.createDataFrame([(1, 1, "s", "x", "{}", "suspended", "r"), (2, 2, "s", "x", "{}", "ready", None)], STAGING)
    assert {r.id: (r.status, r.suspension_reason) for r in resolver.released(rows, deps, after).collect()} == {1: ("pending", None), 2: ("ready", None)}
    fixed = resolver.resolve(after.where("status != 'waiting'"), there)
    assert sorted(map(tuple, fixed.collect())) == sorted(map(tuple, after.where("status != 'waiting'").collect()))


def test_agencies(spark):
    old = spark.createDataFrame([(5, "A", "XX"), (3, "A", "XY")], "id bigint, name string, state string")
    named = spark.createDataFrame([("A",), ("B",), ("B",), (None,)], "agency_name string")
    got = {r.name: (r.id, r.state) for r in joins.get_or_create_agencies(named, old).collect()}
    assert got["A"] == (3, "XY") and got["B"][1] == "AZ" and len(got) == 2
    rows = joins.with_agency(named.where("agency_name is not null"), joins.get_or_create_agencies(named, old))
    assert rows.where("agency_id is null").count() == 0


def test_plans_have_no_cross_join_and_no_python(spark):
    rows = staged(spark, ("use_of_force", "{}"))
    plan = mappers.map_use_of_force(rows, officers(spark, (1, "B", None)))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan and "Python" not in plan


def test_partitioning_changes_nothing(spark):
    rows = staged(spark, *[("court_case", f'{{"row":{{"case_number":{n % 5}}}}}') for n in range(40)])
    a = mappers.map_court_cases(rows.repartition(1)).select("id", "status")
    b = mappers.map_court_cases(rows.repartition(7).orderBy(F.rand(1))).select("id", "status")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
