"""From documents to claims: prompts, memoised answers, claim rows, and an offline reader of the usual notation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analyze import filled, first_per

PROMPT_PRICE, COMPLETION_PRICE = "0.01", "0.03"
MENTION = "struct<full_name:string,role:string>"
CLAIM = ("struct<fact_type:string,subject_name:string,subject_role:string,fact_value:string,related_name:string,relationship_type:string,"
         "extracted_context:string,source_sentence:string,is_inferred:boolean,inference_basis:string,confidence_score:decimal(3,2)>")
DEDUP_KEY = ["fact_type", "subject_name", "fact_value", "related_name", "relationship_type"]


def render_prompt(template: str, text: Column, mentions: Column | None = None) -> Column:
    """``template`` with {text} and, for the second pass, {people}: one "- name (role)" line each."""
    out = F.replace(F.lit(template), F.lit("{text}"), text)
    if mentions is None:
        return out
    lines = F.array_join(F.transform(mentions, lambda m: F.concat(F.lit("- "), m["full_name"], F.lit(" ("), m["role"], F.lit(")"))), "\n")
    return F.replace(out, F.lit("{people}"), lines)


def clean_response(c: Column) -> Column:
    """The answer without a code fence: its first and last line go if it starts with one."""
    bare = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(bare.startswith("```"), F.regexp_replace(F.regexp_replace(bare, r"^[^\n]*(\n|$)", ""), r"(^|\n)[^\n]*$", "")).otherwise(bare)


def memo_lookup(prompts: DataFrame, memo: DataFrame) -> DataFrame:
    """``prompts`` (``prompt_hash``, ``provider``) with the first usable answer: ``memo_id``, ``parsed_json``, null on a miss.

    An empty list is an answer; a row that holds an error only is none.
    """
    usable = memo.filter(F.coalesce(F.col("parsed_json") != "", F.lit(False)))
    first = usable.groupBy("prompt_hash", "provider").agg(F.min(F.struct("id", "parsed_json")).alias("m"))
    # rendered prompts are far larger than the files that they come of, so neither side goes through the driver
    return prompts.join(first.hint("merge"), ["prompt_hash", "provider"], "left").select(*prompts.columns, F.col("m.id").alias("memo_id"), F.col("m.parsed_json").alias("parsed_json"))


def call_cost(prompt_tokens: Column, completion_tokens: Column) -> Column:
    price = F.lit(PROMPT_PRICE).cast("decimal(4,2)"), F.lit(COMPLETION_PRICE).cast("decimal(4,2)")
    return ((prompt_tokens * price[0] + completion_tokens * price[1]) / 1000).cast("decimal(10,6)")


def parse_claims(answers: DataFrame) -> DataFrame:
    """One row per claim of ``document_id``, ``memo_id``, ``parsed_json``, with its ``pos``; text that is no JSON list gives none."""
    return answers.select("document_id", "memo_id", F.posexplode(F.from_json("parsed_json", f"array<{CLAIM}>")).alias("pos", "c")).select(
        "document_id", "memo_id", "pos", "c.*")


def default_claims(rows: DataFrame) -> DataFrame:
    """Claims with a type and a subject, their missing parts filled; null is as good as absent."""
    valid = rows.filter(filled("fact_type").isNotNull() & filled("subject_name").isNotNull())
    value = F.coalesce(filled("fact_value"), F.when(F.col("fact_type") == "person_name", F.col("subject_name")).when(
        F.col("fact_type") == "relationship", F.coalesce("relationship_type", F.lit("related"))).otherwise("unknown"))
    return valid.withColumn("fact_value", value).withColumn("subject_role", F.coalesce("subject_role", F.lit("other"))).withColumn(
        "is_inferred", F.coalesce("is_inferred", F.lit(False))).withColumn("confidence_score", F.coalesce("confidence_score", F.lit("0.80").cast("decimal(3,2)")))


def dedup_claims(rows: DataFrame) -> DataFrame:
    """The first of equal claims of a document; nulls are equal."""
    return first_per(rows, ["document_id", *DEDUP_KEY], ["pos"])


def append_claims(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` that the claim table hasn't got, so processing a document again adds nothing."""
    key = ["document_id", *DEDUP_KEY]
    have = claims.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return rows.join(have, on, "left_anti")


def ingest(documents: DataFrame, posted: DataFrame, order: str | None = None) -> DataFrame:
    """Posted rows (``url``, ``text``) of addresses not known yet; of one address the first posted stays.

    ``order``: the column that tells what was posted first (of equals, and
    without one, the first text in order).
    """
    new = posted.withColumn("url_hash", F.sha2("url", 256))
    place = F.struct(*[F.col(order)] if order else [], F.col("url"), F.col("text"))
    new = new.groupBy("url_hash").agg(F.min_by(F.struct("url", "text"), place).alias("p"))
    return new.join(documents.select("url_hash"), "url_hash", "left_anti").select(
        "url_hash", "p.url", F.col("p.text").alias("extracted_text"), F.sha2("p.text", 256).alias("content_hash"), F.lit("processing").alias("processing_status"))


_PERSON = r"[A-Z][\p{L}'-]*(?:\s+[A-Z]\.)?(?:\s+[A-Z][\p{L}'-]*)+"


def read_notation(documents: DataFrame) -> DataFrame:
    """``document_id``, ``pos``, ``full_name``, ``kind``, ``value``: what the usual notation says of people, without a model.

    A (B) C: two people of one surname, spouses. "Nick" in quotes: a nickname.
    (nee X): a maiden name. the late X: dead. Name (5), at the age of N: an age.
    for N years: how long a marriage lasted. died ... on May 1, 2001: a date of
    death. An approximation of what a model reads.
    """
    text = F.col("extracted_text")

    def found(pattern: str, kind: str, name: int, value: int) -> Column:
        # a text is searched once; what matched is short, and matches again by itself
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(
            F.regexp_extract(m, pattern, name).alias("full_name"), F.lit(kind).alias("kind"), F.regexp_extract(m, pattern, value).alias("value")))

    one = r"[A-Z][\p{L}'-]+"
    parts = [
        found(rf"({one})\s+\(({one})\)\s+({one})", "spouse_given", 1, 2),
        found(rf"({one})\s+\({one}\)\s+({one})", "surname", 1, 2),
        found(rf'({one}(?:\s+[A-Z]\.)?)\s+["“]({one})["”]', "nickname", 1, 2),
        found(rf"({_PERSON}|{one})\s+\((?i:nee)\s+({one})\)", "maiden_name", 1, 2),
        found(rf"\bthe late\s+({_PERSON}|{one})()", "deceased", 1, 2),
        found(rf"({one})\s+\((\d{{1,3}})\)", "age", 1, 2),
        found(r"()\bat the age of\s+(\d{1,3})", "death_age", 1, 2),
        found(r"()\b(?:died|passed away|departed)\b[^.;]{0,80}?\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})", "death_date", 1, 2),
        found(r"()\bfor\s+(\d{1,2})\s+years", "marriage_years", 1, 2),
        found(rf"({one})\s+and\s+{one}\s+({one})", "shared_surname", 1, 2),
    ]
    return documents.select(F.col("id").alias("document_id"), F.posexplode(F.concat(*parts)).alias("pos", "m")).select(
        "document_id", "pos", F.nullif("m.full_name", F.lit("")).alias("full_name"), "m.kind", F.nullif("m.value", F.lit("")).alias("value"))
