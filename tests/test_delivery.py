"""Delivery of the outbox: once for each write, whatever breaks, with handles fed to what refers to them."""

import pytest
from pyspark.sql import functions as F

from lodestead.operators import changes as G
from lodestead.operators import cite as K
from lodestead.sources import delivery as Y
from lodestead.sources.store import Store

OUTBOX = "step int, kind string, url string, title string, document_id bigint, registry_person_id string, confidence int"


@pytest.fixture
def outbox(spark):
    rows = []
    for i in range(40):
        url = None if i == 0 else f"u{i % 10}"
        rows += [(2, "citation", url, f"t{i}", i, f"I{i % 7}", 3), (3, "attach", url, f"t{i}", i, f"I{i % 7}", 3)]
    rows += [(1, "source", u, "s", 1, None, None) for u in [None, *[f"u{i}" for i in range(10) if i != 4]]]
    rows += [(2, "citation", "u1", "twice", 1, "I1", 3), (2, "citation", None, "nobody", None, None, None), (3, "attach", None, "nobody", None, None, None)]
    return spark.createDataFrame(rows, OUTBOX).withColumn("key", K.write_key()).repartition(8)


@pytest.fixture
def known(spark):
    return spark.createDataFrame([("S4", "h4", [("URL", "u4")]), ("S5", "h5", [("URL", "u5")])], "registry_id string, handle string, attributes array<struct<type:string,value:string>>")


def _check(sent, outbox):
    rows = sent.collect()
    assert len({r.key for r in rows}) == len(rows)
    source = {r.url: r.handle for r in rows if r.kind == "source"} | {"u4": "h4", "u5": "h5"}
    cited = {(r.registry_person_id, r.document_id): r.handle for r in rows if r.kind == "citation"}
    assert "u5" not in {r.url for r in rows if r.kind == "source"}
    assert all(r.refers_to == source[r.url] for r in rows if r.kind == "citation")
    assert all(r.refers_to == cited[(r.registry_person_id, r.document_id)] for r in rows if r.kind == "attach")
    assert {r.key for r in rows} == {r.key for r in outbox.collect() if (r.kind, r.url) != ("source", "u5")}


def _files(folder):
    import os

    return {d: len([f for f in os.listdir(f"{folder}/{d}") if not f.startswith(".")]) if os.path.isdir(f"{folder}/{d}") else 0 for d in ("parts", "commits")}


def test_each_write_is_sent_once(spark, outbox, known, tmp_path):
    folder = str(tmp_path / "sent")
    _check(Y.deliver(outbox, folder, known), outbox)
    before = _files(folder)
    assert before["commits"] == 3
    _check(Y.deliver(outbox, "file:" + folder, known), outbox)
    assert _files(folder) == before


@pytest.mark.parametrize("kind", ["source", "citation", "attach"])
def test_a_run_that_breaks_is_repeated(spark, outbox, known, tmp_path, kind):
    folder = str(tmp_path / "sent")
    broken = outbox.withColumn("title", F.when((F.col("kind") == kind) & (F.coalesce("document_id", F.lit(1)) == 1), F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("title")))
    with pytest.raises(Exception, match="lost"):
        Y.deliver(broken, folder, known)
    assert {r.kind for r in Y.delivered(spark, folder).collect()} == set(Y.KINDS[:Y.KINDS.index(kind)])
    _check(Y.deliver(outbox, folder, known), outbox)
    assert Y._place(folder)[1] == folder


def test_a_citation_waits_for_its_source(spark, outbox, known, tmp_path):
    folder = str(tmp_path / "sent")
    early = Y.deliver(outbox.filter("kind <> 'source'"), folder, known)
    assert {r.url for r in early.collect()} == {"u4", "u5"}
    _check(Y.deliver(outbox, folder, known), outbox)


def test_files_without_a_commit_do_not_count(spark, outbox, known, tmp_path):
    folder = str(tmp_path / "sent")
    w = Y.FolderWriter(folder)
    batch = outbox.limit(3).withColumn("handle", F.lit("x")).withColumn("refers_to", F.lit("x")).toArrow().to_batches()
    first, second = w.write(iter(batch)), w.write(iter([]))
    assert first.writes == 3 and second == Y.Sent(None, 0) and Y.delivered(spark, folder).count() == 0
    w.abort([first, None, second])
    assert _files(folder) == {"parts": 0, "commits": 0}
    w.commit([second, None])
    assert Y.delivered(spark, folder).count() == 0
    with pytest.raises(ValueError):
        Y.RegistryWrites({"path": folder}).writer(None, True)


def test_an_empty_outbox(spark, outbox, tmp_path):
    assert Y.deliver(outbox.limit(0), str(tmp_path / "sent")).count() == 0


def test_stored_outbox_and_handles_of_citations(spark, tmp_path):
    store, folder = Store(spark, str(tmp_path / "store")), str(tmp_path / "sent")
    with store.change() as c:
        c.write("documents", spark.createDataFrame([(10, "u10"), (11, "u11")], "id bigint, url string"))
        c.write("claims", spark.createDataFrame([(1, 10, 1, "person_name", "Ann"), (2, 11, 1, "person_name", "Ann")], "id bigint, document_id bigint, entity_id bigint, fact_type string, subject_name string"))
        c.write("entities", spark.createDataFrame([(1, "Ann")], "id bigint, canonical_name string"))
    assert G.link_entity(store, 1, "I1") == {"created": 2, "skipped": 0}
    v = store.manifest()["version"]
    assert G.deliver_outbox(store, folder) == {"source": 2, "citation": 2, "attach": 2}
    handles = {(r.registry_person_id, r.document_id): r.handle for r in Y.delivered(spark, folder).filter("kind = 'citation'").collect()}
    assert {(r.registry_person_id, r.document_id): r.registry_citation_id for r in store.read("citations").collect()} == handles and len(handles) == 2
    assert store.manifest()["version"] == v + 1
    assert G.deliver_outbox(store, folder) == {"source": 2, "citation": 2, "attach": 2} and store.manifest()["version"] == v + 1
