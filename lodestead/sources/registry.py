"""The registry as its service gives it: pages of JSON, a list of records each or an object that holds one under ``data``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import empty


@dataclass
class Registry:
    """``people``, ``events`` and ``families`` in the engine's schemas; ``broken``: ``path``, ``pos``, ``record`` of what is none of them."""

    people: DataFrame
    events: DataFrame
    families: DataFrame
    broken: DataFrame


def _get(path: str, kind: str, of: str = "record") -> Column:
    """A field of a record, null where it is missing or of another kind."""
    return F.try_variant_get(of, path, kind)


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _name(v: Column) -> Column:
    """A name as given and surnames; surnames are objects or plain texts, empty ones go."""
    surnames = F.coalesce(F.try_variant_get(v, "$.surname_list", "array<variant>"), F.array().cast("array<variant>"))
    plain = F.transform(surnames, lambda s: _filled(F.coalesce(F.try_variant_get(s, "$.surname", "string"), _text(s))))
    return F.struct(F.coalesce(F.try_variant_get(v, "$.first_name", "string"), F.lit("")).alias("given"), F.array_compact(plain).alias("surnames"))


def _text(v: Column) -> Column:
    """A plain text; null for objects and lists."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _refs(path: str) -> Column:
    """Handles of a list of references, objects with ``ref`` or plain texts."""
    listed = F.coalesce(_get(path, "array<variant>"), F.array().cast("array<variant>"))
    return F.array_compact(F.transform(listed, lambda r: _filled(F.coalesce(F.try_variant_get(r, "$.ref", "string"), _text(r)))))


def records(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``pos``, ``record`` of every record on the pages under ``path``; a page that is no JSON, or no list, is one record, at -1, of its text.

    A page is a file, and files are dealt over tasks as they are.
    """
    pages = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value", F.try_parse_json("value").alias("page"))
    listed = F.coalesce(_get("$.data", "array<variant>", "page"), _get("$", "array<variant>", "page"))
    whole = F.array(F.struct(F.lit(-1).alias("pos"), F.parse_json(F.to_json(F.struct("value"))).alias("record")))
    rows = F.coalesce(F.transform(listed, lambda v, k: F.struct(k.alias("pos"), v.alias("record"))), whole)
    return pages.select("path", F.explode(rows).alias("r")).select("path", "r.pos", "r.record")


def read_registry(spark: SparkSession, path: str) -> Registry:
    """People, events and families of the pages under ``path``.

    Records are told by what they hold: a person a name, an event a date or a
    place beside its type, a family parents or children. Missing and odd fields
    are null or empty. What is none of them, or has no id of its own, is set
    aside as broken.
    """
    every = records(spark, path).withColumn("handle", _filled(_get("$.handle", "string"))).withColumn("id", _filled(_get("$.gramps_id", "string")))
    has = {k: _get(f"$.{k}", "variant").isNotNull() for k in ("primary_name", "type", "date", "place", "father_handle", "mother_handle", "child_ref_list")}
    family = has["father_handle"] | has["mother_handle"] | has["child_ref_list"]
    kind = (F.when(F.col("pos") < 0, "broken").when(has["primary_name"] & F.col("id").isNotNull(), "person")
            .when(has["type"] & (has["date"] | has["place"]) & F.col("handle").isNotNull(), "event").when(family & F.col("id").isNotNull(), "family").otherwise("broken"))
    every = every.withColumn("kind", kind)

    def typed(table: str, rows: DataFrame) -> DataFrame:
        schema = empty(spark, table).schema
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])

    alternates = F.transform(F.coalesce(_get("$.alternate_names", "array<variant>"), F.array().cast("array<variant>")), _name)
    people = every.filter("kind = 'person'").select(
        F.col("id").alias("registry_id"), "handle", _get("$.gender", "int").alias("gender"), _name(_get("$.primary_name", "variant")).alias("primary_name"),
        alternates.alias("alternate_names"), _refs("$.event_ref_list").alias("event_refs"), _refs("$.citation_list").alias("citation_list"))
    events = every.filter("kind = 'event'").select(
        "handle", F.coalesce(_get("$.type.string", "string"), _text(_get("$.type", "variant"))).alias("type"),
        F.transform(F.slice(_get("$.date.dateval", "array<variant>"), 1, 3), lambda v: F.try_variant_get(v, "$", "int")).alias("dateval"),
        F.coalesce(_get("$.place.name", "string"), _text(_get("$.place", "variant")), F.lit("")).alias("place"))
    parents = F.array_compact(F.array(_filled(_get("$.father_handle", "string")), _filled(_get("$.mother_handle", "string"))))
    families = every.filter("kind = 'family'").select(F.col("id").alias("registry_id"), "handle", parents.alias("parents"), _refs("$.child_ref_list").alias("children"))
    broken = every.filter("kind = 'broken'").select("path", "pos", F.col("record").cast("string").alias("record"))
    return Registry(typed("registry_people", people), typed("registry_events", events), typed("registry_families", families), broken)

