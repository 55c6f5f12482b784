"""The two passes over a document: people first, then claims about them, each answer remembered.

An answer comes from the memo or, on a miss, from a reader: a function that takes
prompts (``prompt_hash``, ``prompt``, ``extracted_text``, ``people``) and returns
``prompt_hash``, ``response_text``, ``api_error``, and if it knows them
``tokens_prompt``, ``tokens_completion``, ``duration_ms``. The built-in readers
know the usual notation; ``asking`` makes one of a function that calls a model.
``changes.process_documents`` keeps the answers in a store.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import settle
from .extract import MENTION, append_claims, call_cost, clean_response, dedup_claims, default_claims, memo_lookup, parse_claims, read_notation, render_prompt
from .resolve import numbered_by

PEOPLE_PROMPT = "List the people that this text names, as JSON objects with full_name and role.\n\n{text}"
CLAIMS_PROMPT = "State what this text claims of these people, as JSON objects.\n\n{people}\n\n{text}"
Reader = Callable[[DataFrame], DataFrame]
_PRIMARY = r"[A-Z][\p{L}'-]*(?:\s+[A-Z]\.)?(?:\s+[A-Z][\p{L}'-]*)+"


@dataclass
class Processed:
    """``claims`` that the table hasn't got, ``memo`` rows to add, ``mentions`` by document, and ``documents`` (``id``, ``processing_status``, counts)."""

    claims: DataFrame
    memo: DataFrame
    mentions: DataFrame
    documents: DataFrame


def _primary(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, f"({_PRIMARY})", 1), F.lit(""))


def read_people(prompts: DataFrame) -> DataFrame:
    """The one whom the text is about, and others that the notation names."""
    one = _primary(F.col("extracted_text"))
    others = read_notation(prompts.select(F.col("prompt_hash").alias("id"), "extracted_text")).filter(
        F.col("full_name").isNotNull() & ~F.col("kind").isin("age", "shared_surname")).groupBy(F.col("document_id").alias("prompt_hash")).agg(
        F.array_sort(F.collect_set("full_name")).alias("names"))
    x = prompts.join(others, "prompt_hash", "left").withColumn("one", one)
    role = F.transform(F.filter(F.coalesce("names", F.array().cast("array<string>")), lambda n: ~n.eqNullSafe(F.col("one"))), lambda n: F.struct(n.alias("full_name"), F.lit("other").alias("role")))
    first = F.when(F.col("one").isNotNull(), F.array(F.struct(F.col("one").alias("full_name"), F.lit("deceased_primary").alias("role")))).otherwise(F.array().cast(f"array<{MENTION}>"))
    return x.select("prompt_hash", F.to_json(F.concat(first, role)).alias("response_text"), F.lit(None).cast("string").alias("api_error"))


def read_claims(prompts: DataFrame) -> DataFrame:
    """What the notation claims: names, nicknames, maiden names, spouses, date and age of death, length of a marriage."""
    kinds = {"nickname": "person_nickname", "maiden_name": "maiden_name", "spouse_given": "relationship", "death_age": "person_death_age",
             "death_date": "person_death_date", "marriage_years": "marriage_duration"}
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    primary = F.filter("people", lambda p: p["role"] == "deceased_primary")
    who = prompts.select("prompt_hash", F.try_element_at(primary, F.lit(1))["full_name"].alias("one"))
    told = read_notation(prompts.select(F.col("prompt_hash").alias("id"), "extracted_text")).withColumnRenamed("document_id", "prompt_hash").join(who, "prompt_hash")
    fact, spouse = F.try_element_at(table, F.col("kind")), F.col("kind") == "spouse_given"
    told = told.filter(fact.isNotNull()).select(
        "prompt_hash", (F.col("pos") + 1_000_000).alias("pos"), fact.alias("fact_type"), F.coalesce("full_name", "one").alias("subject_name"),
        F.when(spouse, "spouse").when(F.col("kind") == "marriage_years", F.concat("value", F.lit(" years"))).otherwise(F.col("value")).alias("fact_value"),
        F.when(spouse, F.col("value")).alias("related_name"), F.when(spouse, "spouse").alias("relationship_type"), "one")
    named = prompts.select("prompt_hash", F.posexplode("people").alias("pos", "p")).join(who, "prompt_hash").select(
        "prompt_hash", F.col("pos").cast("bigint").alias("pos"), F.lit("person_name").alias("fact_type"), F.col("p.full_name").alias("subject_name"), F.col("p.full_name").alias("fact_value"),
        F.lit(None).cast("string").alias("related_name"), F.lit(None).cast("string").alias("relationship_type"), "one")
    claim = F.struct("pos", "fact_type", "subject_name", F.when(F.col("subject_name") == F.col("one"), "deceased_primary").otherwise("other").alias("subject_role"),
                     "fact_value", "related_name", "relationship_type")
    rows = named.unionByName(told).filter(F.col("subject_name").isNotNull()).groupBy("prompt_hash").agg(F.array_sort(F.collect_list(claim)).alias("c"))
    return prompts.select("prompt_hash").join(rows, "prompt_hash", "left").select(
        "prompt_hash", F.coalesce(F.to_json("c"), F.lit("[]")).alias("response_text"), F.lit(None).cast("string").alias("api_error"))


def asking(answer: Callable[[str], tuple[str, int | None, int | None]]) -> Reader:
    """A reader of a Python function from a prompt to the answer and its prompt and completion tokens.

    Each call is timed; an exception becomes the prompt's error.
    """
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = []
            for key, prompt in zip(x["prompt_hash"], x["prompt"], strict=True):
                began = time.perf_counter()
                try:
                    rows.append((key, *answer(prompt), None))
                except Exception as e:  # noqa: BLE001  whatever a model's client raises is this prompt's error
                    rows.append((key, None, None, None, f"{type(e).__name__}: {e}"))
                rows[-1] += (round(1000 * (time.perf_counter() - began)),)
            yield pd.DataFrame(rows, columns=["prompt_hash", "response_text", "tokens_prompt", "tokens_completion", "api_error", "duration_ms"]).astype(
                {k: "Int32" for k in ("tokens_prompt", "tokens_completion", "duration_ms")})

    return lambda prompts: prompts.select("prompt_hash", "prompt").mapInPandas(
        batches, "prompt_hash string, response_text string, tokens_prompt int, tokens_completion int, api_error string, duration_ms int")


def answer_rows(asked: DataFrame, read: Reader, provider: str, model: str) -> DataFrame:
    """Memo rows without ids of what a reader says to the prompts of ``asked``, errors among them.

    Tokens that a reader doesn't tell are those between blanks; what it doesn't
    time is null. No answer is an error.
    """
    told = read(asked)
    had = set(told.columns)

    def pieces(c: str) -> Column:
        return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\S+"), F.lit(0)))

    own = {"tokens_prompt": pieces("prompt"), "tokens_completion": pieces("response_text"), "duration_ms": F.lit(None)}
    x = asked.select("prompt_hash", "document_id", "prompt").join(told, "prompt_hash", "left")
    for name, value in own.items():
        x = x.withColumn(name, (F.coalesce(F.col(name), value) if name in had else value).cast("int"))
    cleaned = clean_response(F.col("response_text"))
    good = F.coalesce(F.from_json(cleaned, "array<map<string,string>>").isNotNull() & F.col("api_error").isNull(), F.lit(False))
    return x.select(
        "document_id", F.lit(provider).alias("provider"), F.lit(model).alias("model"), "prompt_hash", "response_text", F.when(good, cleaned).alias("parsed_json"),
        "tokens_prompt", "tokens_completion", call_cost(F.col("tokens_prompt"), F.col("tokens_completion")).alias("cost_usd"), "duration_ms",
        F.when(~good, F.coalesce("api_error", F.lit("the answer is no JSON list"))).alias("api_error"))


#: Makes memo rows without ids of prompts, numbers and keeps them; returns the memo with them.
Remember = Callable[[Callable[[DataFrame], DataFrame], DataFrame], DataFrame]


def _answered(prompts: DataFrame, memo: DataFrame, read: Reader, provider: str, model: str, remember: Remember) -> DataFrame:
    """``prompts`` with ``memo_id`` and ``parsed_json`` (null after an error); what the memo lacks is asked for once and remembered."""
    asked = prompts.groupBy("prompt_hash").agg(F.min(F.struct("document_id", "prompt", "extracted_text", "people")).alias("x")).select("prompt_hash", F.lit(provider).alias("provider"), "x.*")
    misses = memo_lookup(asked, memo).filter(F.col("memo_id").isNull()).drop("memo_id", "parsed_json")
    kept = remember(lambda share: answer_rows(share, read, provider, model), settle(misses))
    return memo_lookup(prompts.withColumn("provider", F.lit(provider)), kept).drop("provider")


def processed(documents: DataFrame, memo: Callable[[], DataFrame], people: Reader, facts: Reader, provider: str, model: str, remember: Remember) -> Processed:
    """The two passes; ``memo`` gives the answers known so far, ``remember`` keeps new ones. The claims are all that the answers state."""
    none = F.lit(None).cast(f"array<{MENTION}>")
    first = documents.select(F.col("id").alias("document_id"), "extracted_text", render_prompt(PEOPLE_PROMPT, F.col("extracted_text")).alias("prompt"), none.alias("people")).withColumn(
        "prompt_hash", F.sha2("prompt", 256))
    told = _answered(first.filter("prompt is not null"), memo(), people, provider, model, remember)
    mentions = told.withColumn("people", F.from_json("parsed_json", f"array<{MENTION}>")).select("document_id", "extracted_text", "people")
    second = mentions.filter(F.col("people").isNotNull()).withColumn("prompt", render_prompt(CLAIMS_PROMPT, F.col("extracted_text"), F.col("people"))).withColumn("prompt_hash", F.sha2("prompt", 256))
    answered = _answered(second, memo(), facts, provider, model, remember)
    rows = dedup_claims(default_claims(parse_claims(answered.select("document_id", "memo_id", "parsed_json"))))
    counts = rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("claims"))
    done = documents.select(F.col("id").alias("document_id")).join(answered.select("document_id", F.size("people").alias("people"), F.col("parsed_json").isNotNull().alias("read")), "document_id", "left")
    status = done.join(counts, "document_id", "left").select(
        F.col("document_id").alias("id"), F.when(F.col("read"), "completed").otherwise("failed").alias("processing_status"),
        F.coalesce("people", F.lit(0)).alias("people"), F.coalesce("claims", F.lit(0)).alias("claims"))
    return Processed(rows, memo(), mentions.select("document_id", F.explode("people").alias("p")).select("document_id", "p.*"), status)


def process(documents: DataFrame, memo: DataFrame, claims: DataFrame, people: Reader = read_people, facts: Reader = read_claims,
            provider: str = "reader", model: str = "notation") -> Processed:
    """Both passes over ``documents`` (``id``, ``extracted_text``), with frames instead of a store.

    New answers are settled, so all outputs come from one reading. A document
    whose answer fails in either pass is ``failed`` and adds no claims; its memo
    row holds the error, and is no answer the next time. Documents of one text
    share their prompts, so each is read once. Processing again finds the memo
    and adds nothing. Documents without a text are ``failed`` and not asked for.
    """
    made = []

    def everything() -> DataFrame:
        return reduce(DataFrame.unionByName, made, memo)

    def remember(answers: Callable[[DataFrame], DataFrame], prompts: DataFrame) -> DataFrame:
        last = everything().agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
        # numbering settles the answers first
        made.append(settle(numbered_by(answers(prompts), [F.col("prompt_hash")], last)))
        return everything()

    out = processed(documents, everything, people, facts, provider, model, remember)
    return Processed(append_claims(claims, out.claims), reduce(DataFrame.unionByName, made), out.mentions, out.documents)
