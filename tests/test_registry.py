"""Registry pages as they come, and many searches at once."""

import json
import random

import pytest

from lodestead.operators import link as R
from lodestead.schemas import SCHEMAS
from lodestead.sources import registry as J


@pytest.fixture(scope="module")
def pages(tmp_path_factory):
    at = tmp_path_factory.mktemp("pages")
    people = [
        {"gramps_id": "I1", "handle": "h1", "gender": 0, "primary_name": {"first_name": "Ann", "surname_list": [{"surname": "Cole"}, {"surname": "Poe"}]},
         "alternate_names": [{"first_name": "Annie", "surname_list": ["Smith"]}], "event_ref_list": [{"ref": "e1"}, "e2", {"ref": ""}, {}], "citation_list": ["c1"]},
        {"gramps_id": "I2", "handle": "h2", "primary_name": {}}, {"gramps_id": "I3", "primary_name": {"first_name": None, "surname_list": []}, "gender": "odd", "event_ref_list": None, "extra": [1, {"a": 2}]},
        {"handle": "no id", "primary_name": {"first_name": "X"}}, "a text", None, 7]
    (at / "a.json").write_text(json.dumps(people))
    (at / "sub").mkdir()
    (at / "sub" / "b.json").write_text(json.dumps({"total": 3, "data": [
        {"handle": "e1", "type": {"string": "Death"}, "date": {"dateval": [1, 5, 2001, False]}, "place": "Town"}, {"handle": "e2", "type": "Birth", "date": {"dateval": None}, "place": {"name": "Bay"}},
        {"handle": "e3", "type": "Birth", "date": {}, "place": None}, {"type": "Birth", "date": {"dateval": [0, 0, 1990]}}]}, indent=1))
    (at / "c.json").write_text(json.dumps({"data": [{"gramps_id": "F1", "handle": "f1", "father_handle": "h1", "mother_handle": "", "child_ref_list": [{"ref": "h2"}, {"ref": "h3"}]},
                                                    {"gramps_id": "F2", "handle": "f2", "mother_handle": "h2"}]}))
    (at / "empty.json").write_text("[]")
    (at / "cut.json").write_text('[{"gramps_id": "I9"')
    (at / "other.json").write_text('{"error": "busy"}')
    return str(at)


def test_pages_as_they_come(spark, pages):
    r = J.read_registry(spark, pages)
    people = {p.registry_id: p for p in r.people.collect()}
    assert set(people) == {"I1", "I2", "I3"}
    one = people["I1"]
    assert (one.handle, one.gender, one.primary_name.given, one.primary_name.surnames, one.event_refs, one.citation_list) == ("h1", 0, "Ann", ["Cole", "Poe"], ["e1", "e2"], ["c1"])
    assert [(n.given, n.surnames) for n in one.alternate_names] == [("Annie", ["Smith"])]
    assert (people["I2"].primary_name.given, people["I2"].primary_name.surnames, people["I2"].alternate_names) == ("", [], [])
    assert people["I3"].gender is None and people["I3"].event_refs == [] and people["I3"].handle is None
    assert {(e.handle, e.type, tuple(e.dateval) if e.dateval is not None else None, e.place) for e in r.events.collect()} == {
        ("e1", "Death", (1, 5, 2001), "Town"), ("e2", "Birth", None, "Bay"), ("e3", "Birth", None, "")}
    assert {(f.registry_id, tuple(f.parents), tuple(f.children)) for f in r.families.collect()} == {("F1", ("h1",), ("h2", "h3")), ("F2", ("h2",), ())}
    broken = sorted((b.path.rsplit("/", 1)[1], b.pos) for b in r.broken.collect())
    assert broken == [("a.json", 3), ("a.json", 4), ("a.json", 5), ("a.json", 6), ("b.json", 3), ("cut.json", -1), ("other.json", -1)]
    for frame, table in ((r.people, "registry_people"), (r.events, "registry_events"), (r.families, "registry_families")):
        assert [f"{f.name} {f.dataType.simpleString()}" for f in frame.schema] == [f"{f.name} {f.dataType.simpleString()}" for f in spark.createDataFrame([], SCHEMAS[table]).schema]
    # what was read is what the linking reads
    facts = {f.registry_id: f for f in R.person_facts(r.people, r.events).collect()}
    assert facts["I1"].death_date == "2001-05-01" and facts["I1"].birth_place == "Bay"


@pytest.mark.parametrize("limit", [1, 3, 100])
def test_many_searches_find_what_each_finds(spark, limit):
    rnd = random.Random(limit)
    word = lambda n: "".join(rnd.choice("abC") for _ in range(n))
    names = [(f"I{k:03d}", word(rnd.randint(0, 4)), word(rnd.randint(0, 5))) for k in range(150)]
    people = spark.createDataFrame([(i, f"h{i}", (g, [s] if s else [])) for i, g, s in names], "registry_id string, handle string, primary_name struct<given:string,surnames:array<string>>")
    pick = lambda n: rnd.choice([None, "", word(rnd.randint(1, n)), word(rnd.randint(1, n))])
    asked = [(k, rnd.choice([None, None, f"{word(1)} {word(1)}", word(2)]), pick(4), pick(3)) for k in range(120)]
    got = {}
    frame = R.search_many(people, spark.createDataFrame(asked, "query_id bigint, query string, surname string, given string"), limit)
    for r in frame.orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.registry_id)
    for k, q, s, g in asked:
        want = [i for i, given, surname in names if (not g or g.lower() in given.lower()) and (not s or s.lower() in surname.lower()) and (not q or q.lower() in f"{given} {surname}".lower())][:limit]
        assert got.get(k, []) == want, (q, s, g)
    # the first few are cut before they are shuffled
    assert "WindowGroupLimit" in frame._jdf.queryExecution().toString()
