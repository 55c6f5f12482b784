"""Aggregates over claims: corroboration, conflicts, summaries, review queues.

Every function takes and returns DataFrames. Means are one exact sum over one
count, as a double; lists are sorted; the first of several is that of least id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFLICT_TYPES = ("person_death_date", "person_birth_date", "person_death_age")
RELATION_TYPES = ("relationship", "marriage")


def mean(c: Column | str) -> Column:
    return F.sum(c).cast("double") / F.count(c)


def hundredths(total: Column, n: Column) -> Column:
    """Mean of decimals with two places, rounded half up on whole hundredths."""
    return (F.floor((2 * (total * 100).cast("bigint") + n) / (2 * n)) / 100).cast("decimal(3,2)")


def filled(c: Column | str) -> Column:
    """Empty text is no value."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def relation_key() -> tuple[Column, Column]:
    """What a relation says, and about whom, where it says so."""
    return F.coalesce(filled("relationship_type"), filled("fact_value"), F.lit("unknown")), F.coalesce(filled("related_name"), F.lit("unknown"))


# A1 .. A6: views over the claim table

def claims_by_subject(claims: DataFrame) -> DataFrame:
    pick = lambda kind: F.max(F.when(F.col("fact_type") == kind, F.col("fact_value")))
    return claims.groupBy("subject_name", "document_id", "entity_id", "registry_person_id").agg(
        F.count(F.lit(1)).alias("fact_count"), mean("confidence_score").alias("avg_confidence"),
        pick("person_death_date").alias("death_date"), pick("person_death_age").alias("death_age"), pick("maiden_name").alias("maiden_name"))


def review_queue(claims: DataFrame, documents: DataFrame) -> DataFrame:
    waiting = claims.filter(F.col("resolution_status").isin("unresolved", "conflicting"))
    urls = documents.select(F.col("id").alias("_doc"), F.col("url").alias("source_url"))
    order = [F.col("confidence_score").asc(), *[F.col(c).desc() for c in ("created_timestamp",) if c in claims.columns]]
    return waiting.join(urls, F.col("document_id") == F.col("_doc")).drop("_doc").orderBy(*order)


def corroborated_claims(claims: DataFrame) -> DataFrame:
    return claims.groupBy("subject_name", "fact_type", "fact_value").agg(
        F.size(F.collect_set("document_id")).cast("bigint").alias("source_count"), mean("confidence_score").alias("avg_confidence"),
        F.array_join(F.transform(F.array_sort(F.collect_set("document_id")), lambda x: x.cast("string")), ",").alias("document_ids")).filter(
        "source_count > 1").orderBy(F.desc("source_count"), F.desc("avg_confidence"), "subject_name", "fact_type", "fact_value")


def multi_document_subjects(claims: DataFrame, documents: DataFrame) -> DataFrame:
    many = claims.groupBy("subject_name").agg(F.count_distinct("document_id").alias("document_count")).filter("document_count > 1")
    seen = claims.select("subject_name", "document_id").distinct().join(
        documents.select(F.col("id").alias("document_id"), "url"), "document_id")
    urls = seen.groupBy("subject_name").agg(F.array_join(F.array_sort(F.collect_set("url")), ",").alias("urls"))
    return many.join(urls, "subject_name", "left").orderBy(F.desc("document_count"), "subject_name")


def surname_variant_groups(claims: DataFrame) -> DataFrame:
    """Surnames under which several names with several given parts occur."""
    from ..functions.names import tokens

    names = claims.select("subject_name").distinct().withColumn("t", tokens(F.col("subject_name"))).filter(F.size("t") >= 2)
    names = names.select("subject_name", F.element_at("t", -1).alias("surname"), F.array_join(F.slice("t", 1, F.size("t") - 1), " ").alias("given"))
    return names.groupBy("surname").agg(
        F.count_distinct("subject_name").alias("name_count"), F.count_distinct("given").alias("given_count"),
        F.array_join(F.array_sort(F.collect_set("subject_name")), ",").alias("names")).filter("name_count > 1 and given_count > 1")


def processing_counts(claims: DataFrame, documents: DataFrame) -> DataFrame:
    done = documents.agg(F.count(F.when(F.col("processing_status") == "completed", 1)).alias("completed_documents"))
    return done.crossJoin(claims.agg(F.count(F.lit(1)).alias("total_claims")))  # one row by one row


# A7 .. A9: entities

def entity_stats(claims: DataFrame, by: str = "entity_id") -> DataFrame:
    """One row per entity; its names are compared and listed once each, not with every claim and document."""
    told = claims.filter(F.col(by).isNotNull())
    longest = F.max_by("subject_name", F.struct(F.length("subject_name"), _reverse_order("subject_name")))
    names = told.select(by, "subject_name").distinct().groupBy(by).agg(
        longest.alias("canonical_name"), F.array_sort(F.collect_set("subject_name")).alias("name_variants"))
    return told.groupBy(by).agg(
        F.count(F.lit(1)).alias("fact_count"), F.count_distinct("document_id").alias("source_count"),
        hundredths(F.sum("confidence_score"), F.count("confidence_score")).alias("confidence_score")).join(names, by)


def _reverse_order(c: str) -> Column:
    """Sorts texts of one length backwards, so the greatest is the first in order."""
    return F.transform(F.split(F.col(c), ""), lambda x: -F.ascii(x))


def entity_name_sets(claims: DataFrame, by: str = "entity_id") -> DataFrame:
    def names(kind: str) -> Column:
        s = F.array_sort(F.collect_set(F.when(F.col("fact_type") == kind, F.col("fact_value"))))
        return F.when(F.size(s) > 0, s)

    return claims.filter(F.col(by).isNotNull()).groupBy(by).agg(names("person_nickname").alias("nicknames"), names("maiden_name").alias("maiden_names"))


def generate_summary(entities: DataFrame) -> DataFrame:
    return entities.agg(
        F.count(F.lit(1)).alias("total_entities"), F.count(F.when(F.col("source_count") > 1, 1)).alias("multi_source"),
        F.count(F.when(F.size("name_variants") > 1, 1)).alias("with_variants"), F.coalesce(F.sum("fact_count"), F.lit(0)).alias("claims_clustered"))


def top_entities(entities: DataFrame, k: int = 20) -> DataFrame:
    return entities.orderBy(F.desc("source_count"), F.desc("fact_count"), "id").limit(k)


def list_entities(entities: DataFrame, min_sources: int = 1) -> DataFrame:
    some = entities.filter(F.col("source_count") >= min_sources) if min_sources > 1 else entities
    return some.orderBy(F.desc("source_count"), F.desc("fact_count"), "id")


# A10 .. A16: within entities

def claims_by_type(claims: DataFrame, by: str = "entity_id") -> DataFrame:
    row = F.struct("fact_value", "document_id", "confidence_score", "subject_name", "related_name")
    return claims.filter(F.col(by).isNotNull()).groupBy(by, "fact_type").agg(
        F.count(F.lit(1)).alias("fact_count"), F.sort_array(F.collect_list(row)).alias("claims"))


def entity_summary(claims: DataFrame, documents: DataFrame, by: str = "entity_id") -> DataFrame:
    """One row per entity: its claims by type, and the addresses of its documents."""
    kinds = claims_by_type(claims, by).groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fact_type", "claims")))).alias("claims"))
    seen = claims.filter(F.col(by).isNotNull()).select(by, "document_id").distinct().join(documents.select(F.col("id").alias("document_id"), "url"), "document_id")
    return kinds.join(seen.groupBy(by).agg(F.array_sort(F.collect_set("url")).alias("urls")), by, "left")


def entity_conflicts(claims: DataFrame, by: str = "entity_id") -> DataFrame:
    """Types that allow one value but have several, from whichever documents."""
    return claims.filter(F.col("fact_type").isin(*CONFLICT_TYPES) & F.col(by).isNotNull()).groupBy(by, "fact_type").agg(
        F.count(F.lit(1)).alias("fact_count"), F.count_distinct("fact_value").alias("value_count"),
        F.array_sort(F.collect_set("fact_value")).alias("fact_values"),
        F.sort_array(F.collect_list(F.struct("document_id", "fact_value", "confidence_score"))).alias("sources")).filter("fact_count > 1 and value_count > 1")


def entity_corroboration(claims: DataFrame, by: str = "entity_id") -> DataFrame:
    """Claims told by several documents; relations are alike if they say the same of the same person."""
    what, whom = relation_key()
    relation = F.col("fact_type").isin(*RELATION_TYPES)
    order = F.col("id") if "id" in claims.columns else F.struct("document_id", "fact_value")
    keyed = claims.filter(F.col(by).isNotNull()).withColumn("key_value", F.when(relation, what).otherwise(F.col("fact_value"))).withColumn(
        "key_name", F.when(relation, whom)).withColumn("_order", order)
    return keyed.groupBy(by, "fact_type", "key_value", "key_name").agg(
        F.count_distinct("document_id").alias("source_count"), F.min_by("fact_value", "_order").alias("fact_value"),
        mean("confidence_score").alias("avg_confidence"),
        F.sort_array(F.collect_list(F.struct("document_id", "confidence_score"))).alias("sources")).filter("source_count > 1").orderBy(
        by, F.desc("source_count"), "fact_type", "key_value", "key_name")


def corroboration_summary(corroborated: DataFrame) -> DataFrame:
    return corroborated.agg(F.count(F.lit(1)).alias("corroborated_count"), F.coalesce(F.max("source_count"), F.lit(0)).alias("max_sources"))


def document_subjects(claims: DataFrame, document_id: int) -> DataFrame:
    """Claims of one document, in a list per subject."""
    return claims.filter(F.col("document_id") == document_id).groupBy("subject_name").agg(
        F.sort_array(F.collect_list(F.struct("fact_type", "fact_value", "confidence_score"))).alias("claims"))


def linkage_features(claims: DataFrame, by: str = "entity_id") -> DataFrame:
    """The last death date, death age and birth date claimed of each entity, and its relations."""
    def last(kind: str) -> Column:
        return F.max_by(F.when(F.col("fact_type") == kind, F.col("fact_value")), F.when(F.col("fact_type") == kind, F.col("id")))

    what = F.coalesce(filled("relationship_type"), F.col("fact_value"))
    relation = F.when(F.col("fact_type").isin(*RELATION_TYPES), F.struct("id", what.alias("type"), "related_name", F.coalesce(F.col("confidence_score"), F.lit(0).cast("decimal(3,2)")).alias("confidence")))
    return claims.filter(F.col(by).isNotNull()).groupBy(by).agg(
        last("person_death_date").alias("death_date"), last("person_death_age").alias("death_age"), last("person_birth_date").alias("birth_date"),
        F.array_sort(F.collect_list(relation)).alias("relations"))


# filters and projections

def claims_like(claims: DataFrame, name: str) -> DataFrame:
    """Subjects that contain the text whatever its case; % and _ keep their meaning."""
    return claims.filter(F.col("subject_name").ilike(f"%{name}%"))


def documents_page(documents: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    return documents.orderBy("id").offset(offset).limit(limit)


def claim_rows(claims: DataFrame) -> DataFrame:
    """The columns shown of a claim; a confidence of zero is shown as none."""
    names = ("id", "fact_type", "subject_name", "subject_role", "fact_value", "related_name", "relationship_type", "extracted_context", "is_inferred", "inference_basis", "resolution_status")
    shown = [n for n in names if n in claims.columns]
    return claims.select(*shown, F.when(F.col("confidence_score") != 0, F.col("confidence_score").cast("double")).alias("confidence_score"))


def first_per(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order; null keys are a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
