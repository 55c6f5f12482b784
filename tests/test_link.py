"""Registry people, linkage candidates, citations and their audit trail on hand-made rows."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodestead.operators import analyze as A
from lodestead.operators import cite as K
from lodestead.operators import link as R
from lodestead.schemas import SCHEMAS, empty

NAME = "struct<given:string,surnames:array<string>>"


@pytest.fixture(scope="module")
def people(spark):
    rows = [("I1", "h1", 0, ("Ann", ["Cole"]), [("Annie", ["Smith"])], ["e1", "e2", "gone"], None), ("I2", "h2", 1, ("Bob", []), None, [], None),
            ("I3", "h3", 0, ("Joann", ["Coleman"]), None, ["e3"], None)]
    return spark.createDataFrame(rows, SCHEMAS["registry_people"])


@pytest.fixture(scope="module")
def events(spark):
    rows = [("e1", "Death", [1, 5, 2001], "Town"), ("e2", "Death", [0, 0, 0], ""), ("e3", "Birth", None, "Bay")]
    return spark.createDataFrame(rows, SCHEMAS["registry_events"])


def test_people(people, events):
    assert [r.registry_id for r in R.search_people(people, surname="COLE").collect()] == ["I1", "I3"]
    assert [r.registry_id for r in R.search_people(people, query="ann cole", limit=1).collect()] == ["I1"]
    assert R.get_person(people, "h2").first().registry_id == "I2"
    assert {(r.registry_id, r.pos, r.full) for r in R.person_names(people).collect()} == {("I1", 0, "Ann Cole"), ("I1", 1, "Annie Smith"), ("I2", 0, "Bob"), ("I3", 0, "Joann Coleman")}
    facts = {r.registry_id: r for r in R.person_facts(people, events).collect()}
    # the last event with a date wins though its date is unknown; the place of the one before stays
    assert facts["I1"].death_date is None and facts["I1"].death_place == "Town" and facts["I3"].birth_place == "Bay" and facts["I2"].birth_date is None


def test_families(spark, people):
    families = spark.createDataFrame([("F1", "f1", ["h1", "h2"], ["h3"])], SCHEMAS["registry_families"])
    got = {r.registry_id: (r.as_parent, r.as_child) for r in R.person_families(people, families).collect()}
    assert got == {"I1": (["F1"], []), "I2": (["F1"], []), "I3": ([], ["F1"])}


@pytest.fixture(scope="module")
def claims(spark):
    rows = [(1, 10, "person_name", "Ann Cole", "deceased_primary", "Ann Cole", 5), (2, 10, "person_death_date", "Ann Cole", "deceased_primary", "2001-05-01", 5),
            (3, 11, "person_name", "Bob", "other", "Bob", 6)]
    return spark.createDataFrame([(*r, Decimal("0.90")) for r in rows],
                                 "id bigint, document_id bigint, fact_type string, subject_name string, subject_role string, fact_value string, entity_id bigint, confidence_score decimal(3,2)"
                                 ).withColumn("related_name", F.lit(None).cast("string")).withColumn("relationship_type", F.lit(None).cast("string"))


def test_find_matches(spark, people, claims, events):
    entities = spark.createDataFrame([(5, ["Ann Cole", "Ann"])], "id bigint, name_variants array<string>")
    got = {r.registry_id: r for r in R.find_matches(entities, claims, people, events.filter("handle <> 'e2'")).collect()}
    assert got["I1"].confidence == 1.0 and got["I1"].name_method == "exact_normalized" and got["I1"].registry_name == "Ann Cole"
    assert got["I1"].reasons == ["name: exact_normalized", "death date equal"] and "I2" not in got


def test_citations(spark, claims):
    documents = spark.createDataFrame([(10, "u10"), (11, "u11")], "id bigint, url string")
    when = dt.datetime(2020, 1, 1)
    citations = spark.createDataFrame([(1, 10, 5, "I1", "Own name", when), (2, 11, 6, "I1", None, when), (3, 12, 5, "I2", "", when)],
                                      "id bigint, document_id bigint, entity_id bigint, registry_person_id string, document_name string, created_timestamp timestamp")
    wanted = spark.createDataFrame([(5, "I1", 10), (5, "I9", 10), (5, "I9", 11)], "entity_id bigint, registry_person_id string, document_id bigint")
    sources = spark.createDataFrame([("S2", "s2", [("URL", "u10")]), ("S1", "s1", [("url", "u10")])], SCHEMAS["registry_sources"])
    new, skipped, outbox = K.plan_citations(wanted, citations, claims, documents, sources)
    assert {(r.registry_person_id, r.document_id, r.document_name, r.registry_source_id) for r in new.collect()} == {
        ("I9", 10, "Obituary of Ann Cole", "S1"), ("I9", 11, "Obituary of Unknown", None)}
    assert [r.document_id for r in skipped.collect()] == [10]
    assert {(r.kind, r.url, r.confidence) for r in outbox.collect()} == {
        ("source", "u11", None), ("citation", "u10", 3), ("citation", "u11", 3), ("attach", "u10", 3), ("attach", "u11", 3)}
    entities = spark.createDataFrame([(5, "Ann Cole")], "id bigint, canonical_name string")
    trail = {r.id: (r.entity_name, r.document_name) for r in K.audit_trail(citations, entities, claims).collect()}
    assert trail == {1: ("Ann Cole", "Own name"), 2: (None, "Obituary of Bob"), 3: ("Ann Cole", None)}
    assert [r.id for r in K.entity_citations(citations, documents, 5).orderBy("id").collect()] == [1, 3]
    assert K.person_citations(citations, documents, "I1", claims).count() == 2


def test_unlink(spark, claims):
    c = claims.withColumn("registry_person_id", F.lit("I1")).withColumn("resolution_status", F.lit("resolved"))
    e = spark.createDataFrame([(5, "I1", "verified"), (6, "I2", "verified")], "id bigint, registry_person_id string, entity_status string")
    k = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id bigint, entity_id bigint")
    c2, e2, k2 = K.unlink(c, e, k, 5)
    assert c2.filter("registry_person_id is null and resolution_status = 'clustered'").count() == 2
    assert {(r.id, r.registry_person_id, r.entity_status) for r in e2.collect()} == {(5, None, "unverified"), (6, "I2", "verified")}
    assert sorted(r.id for r in k2.collect()) == [2, 3]


def test_summaries(spark, claims):
    assert A.entity_summary(claims, spark.createDataFrame([(10, "u10")], "id bigint, url string")).filter("entity_id = 5").first().urls == ["u10"]
    assert A.claim_rows(claims.withColumn("confidence_score", F.lit(0).cast("decimal(3,2)"))).filter("confidence_score is null").count() == 3
    assert A.corroboration_summary(A.entity_corroboration(claims)).first().asDict() == {"corroborated_count": 0, "max_sources": 0}
    assert A.entity_stats(empty(spark, "claims")).count() == 0
