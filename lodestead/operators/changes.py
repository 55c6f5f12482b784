"""Changes of several stored tables, each published as one version or not at all."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import empty
from ..sources import delivery
from ..sources.store import Change, Store
from . import cite, resolve
from .analyze import generate_summary
from .extract import append_claims
from .process import Reader, processed, read_claims, read_people

WRITER = "linking"


def _last_id(table: DataFrame) -> int:
    return table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]


def _numbered(rows: DataFrame, table: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ids that follow the greatest of ``table``."""
    return resolve.numbered_by(rows.drop("id"), [F.col(c) for c in order], _last_id(table))


def link_entity(store: Store, entity_id: int, registry_person_id: str, confidence: str = "high", sources: DataFrame | None = None) -> dict[str, int]:
    """Link an entity to a registry person: its claims, itself, new citations of its documents and the outbox, in one version.

    ``sources``: what the registry has (``registry_id``, ``handle``,
    ``attributes``), none if absent. Returns how many citations were created and
    skipped. An unknown entity, and a person that another one has, are errors
    that change nothing.
    """
    def work(c: Change) -> dict[str, int]:
        claims, entities, citations = c.read("claims"), c.read("entities"), c.read("citations")
        new_claims, new_entities = cite.link(claims, entities, entity_id, registry_person_id)
        wanted = claims.filter(F.col("entity_id") == entity_id).select("entity_id", F.lit(registry_person_id).alias("registry_person_id"), "document_id").distinct()
        known = empty(store.spark, "registry_sources") if sources is None else sources
        new, skipped, outbox = cite.plan_citations(wanted, citations, claims, c.read("documents"), known, confidence)
        rows = _numbered(new, citations, "document_id").select(
            "*", F.lit(None).cast("string").alias("registry_citation_id"), F.lit("obituary").alias("citation_type"),
            F.current_timestamp().alias("created_timestamp"), F.lit(WRITER).alias("created_by"))
        c.write("claims", new_claims)
        c.write("entities", new_entities)
        written = c.write("citations", rows, "append")
        c.write("outbox", outbox.withColumn("key", cite.write_key()).withColumn("created_timestamp", F.current_timestamp()), "append")
        return {"created": written.count(), "skipped": skipped.count()}

    return store.retrying(work)


def unlink_entity(store: Store, entity_id: int) -> dict[str, object]:
    """Undo an entity's link: its claims, itself and its citations, in one version. What the registry was sent stays there.

    Returns the person it was linked to and how many citations went.
    """
    def work(c: Change) -> dict[str, object]:
        claims, entities, citations = c.read("claims"), c.read("entities"), c.read("citations")
        told = cite.unlink_summary(entities, citations, entity_id).first()
        if told is None:
            raise ValueError(f"no entity {entity_id}")
        for table, frame in zip(("claims", "entities", "citations"), cite.unlink(claims, entities, citations, entity_id), strict=True):
            c.write(table, frame)
        return told.asDict()

    return store.retrying(work)


def generate_entities(store: Store, threshold: float = resolve.THRESHOLD, cut: float = resolve.THRESHOLD, require_surname: bool = False) -> dict[str, int]:
    """Resolve all claims anew: claims and entities in one version; returns the summary."""
    def work(c: Change) -> dict[str, int]:
        new_claims, entities = resolve.generate(c.read("claims"), threshold, cut, require_surname)
        written = c.write("entities", entities)
        # ids are read back, so claims and entities hold the same
        c.write("claims", new_claims)
        return generate_summary(written).first().asDict()

    return store.retrying(work)


@dataclass
class Run:
    """What a processing run read and wrote."""

    asked: int
    failed: int
    claims: int
    version: int


def process_documents(store: Store, people: Reader = read_people, facts: Reader = read_claims, provider: str = "reader", model: str = "notation", parts: int = 1) -> Run:
    """Both passes over the stored documents, every answer written before it is used.

    Prompts that the memo can't answer go to the reader in ``parts`` shares by
    hash. A share's answers are written to the store once, published, and read
    back from there; claims, mentions and states come from the stored answers
    only. So each prompt is asked once whatever is made of it, a run that breaks
    off asks only what no share has published, and the next one asks again only
    what failed. Claims, mentions and states of all documents are one version.
    """
    asked = failed = 0

    def remember(answers: Callable[[DataFrame], DataFrame], prompts: DataFrame) -> DataFrame:
        nonlocal asked, failed
        for part in range(parts):
            if prompts.isEmpty():
                break
            share = prompts if parts == 1 else prompts.filter(F.pmod(F.xxhash64("prompt_hash"), F.lit(parts)) == part)
            # what was answered lies there before it gets ids, so another writer's answers don't make it ask again
            laid = store.frame("memo", [store.lay("memo", answers(share))])
            made = store.retrying(lambda c, laid=laid: c.write("memo", _numbered(laid, c.read("memo"), "prompt_hash"), "append"), times=20)
            told = made.agg(F.count(F.lit(1)).alias("n"), F.count("api_error").alias("e")).first()
            asked, failed = asked + told["n"], failed + told["e"]
        return store.read("memo")

    def publish(c: Change) -> int:
        documents, claims = c.read("documents"), c.read("claims")
        out = processed(documents, lambda: store.read("memo"), people, facts, provider, model, remember)
        new = _numbered(append_claims(claims, out.claims), claims, "document_id", "pos").withColumn("resolution_status", F.lit("unresolved")).withColumn(
            "created_timestamp", F.current_timestamp()).withColumn("entity_id", F.lit(None).cast("bigint")).withColumn("registry_person_id", F.lit(None).cast("string"))
        written = c.write("claims", new, "append")
        c.write("mentions", out.mentions)
        state = out.documents.select("id", F.col("processing_status").alias("_state"))
        c.write("documents", documents.join(state, "id", "left").withColumn("processing_status", F.coalesce("_state", "processing_status")).drop("_state"))
        return written.count()

    n = store.retrying(publish)
    return Run(asked, failed, n, store.manifest()["version"])


def deliver_outbox(store: Store, folder: str, sources: DataFrame | None = None) -> dict[str, int]:
    """Send the stored outbox to ``folder`` and note the handles of citations made, in one version; returns how many writes of each kind are delivered.

    A run that breaks is simply run again: what was sent isn't sent again, and
    the handles are noted then.
    """
    sent = delivery.deliver(store.read("outbox"), folder, sources)
    handles = sent.filter("kind = 'citation'").select("registry_person_id", "document_id", F.col("handle").alias("_handle"))

    def work(c: Change) -> None:
        citations = c.read("citations")
        key = ["registry_person_id", "document_id"]
        if not citations.filter("registry_citation_id IS NULL").join(handles, key, "left_semi").isEmpty():
            c.write("citations", citations.join(handles, key, "left").withColumn("registry_citation_id", F.coalesce("registry_citation_id", "_handle")).drop("_handle"))

    store.retrying(work)
    return {r["kind"]: r["count"] for r in sent.groupBy("kind").count().collect()}
