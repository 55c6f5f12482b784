"""Substring dedup by hashing lines, and the sentences in them.

Units are the lines of ``min_words`` words or more and, as a finer level, the
sentences of each line. A sentence of under ``min_words`` words says too
little by itself: it counts as seen if it was seen within a run of neighbours in
its line, before or after it, that has so many. What is hashed is normalised
(lower case, blanks collapsed, marks at the ends dropped) and digested to 128 bits. Digests are counted over
all documents; the earliest occurrence, by document id and offset, stays, and
the others are given back as spans of the original text.

A document is known by its id and a hash of its text, so rows of one id, or
without one, but of unlike texts are separate documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: A digest with more than this share of all repeated units is split over several tasks; so at most twice as many are split.
HOT_SHARES = 20_000

MIN_WORDS = 5
_SENTENCE = re.compile(r"\S[^\n]*?(?:[.!?]+(?=\s)|(?=\n)|\Z)")
_LAST = (1 << 63) - 1


def _digest(words: list[str], short: tuple[int, ...] = ()) -> bytes:
    key = " ".join(words).strip(".,;:!?-\"'() ") + "".join(f"\n{k}" for k in short)
    return xxhash.xxh3_128_digest(key.encode("utf-8", "replace"))


def _windows(line: list[tuple[int, int, list[str]]], min_words: int) -> Iterator[tuple[int, int]]:
    """First and last sentence of the shortest runs of ``min_words`` words from, and up to, each sentence."""
    for i in range(len(line)):
        for step in (1, -1):
            j, n = i, len(line[i][2])
            while n < min_words and 0 <= j + step < len(line):
                j += step
                n += len(line[j][2])
            if n >= min_words and i != j:
                yield min(i, j), max(i, j)


def units(text: str | None, min_words: int = MIN_WORDS) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of lines and sentences of ``min_words`` words or more, and of the shorter sentences of each run; these can overlap."""
    lines: list[list[tuple[int, int, list[str]]]] = []
    last = 0
    for m in _SENTENCE.finditer(text or ""):
        if not lines or "\n" in text[last:m.start()]:
            lines.append([])
        last = m.end()
        lines[-1].append((m.start(), last, m.group().lower().split()))
    out: list[tuple[int, int, bytes]] = []
    for line in lines:
        short = [len(words) < min_words for _, _, words in line]
        if len(line) > 1 and sum(len(words) for _, _, words in line) >= min_words:
            out.append((line[0][0], line[-1][1], _digest([w for _, _, words in line for w in words])))
        out += [(a, z, _digest(words)) for (a, z, words), s in zip(line, short, strict=True) if not s]
        if not any(short):
            continue
        ends: dict[bytes, int] = {}
        for i, j in sorted(set(_windows(line, min_words))):
            inside = [k for k in range(i, j + 1) if short[k]]
            start, end = line[inside[0]][0], line[inside[-1]][1]
            d = _digest([w for _, _, x in line[i:j + 1] for w in x], (inside[0] - i, inside[-1] - i))
            # a run that repeats within itself is one
            if start >= ends.get(d, 0):
                ends[d] = end
                out.append((start, end, d))
    return sorted(out)


def unit_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``id``, ``th`` (hash of the text), ``start``, ``end``, ``h1``, ``h2`` of each unit of each document."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, start, end, digests = [], [], [], []

            def flush() -> pa.RecordBatch:
                h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                out = pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at, pa.int64())), b.column(1).take(pa.array(at, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()),
                     pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))],
                    ["id", "th", "start", "end", "h1", "h2"])
                for x in (at, start, end, digests):
                    x.clear()
                return out

            for i, t in enumerate(b.column(2).to_pylist()):
                for a, z, d in units(t, min_words):
                    at.append(i)
                    start.append(a)
                    end.append(z)
                    digests.append(d)
                if len(at) >= 100_000:
                    yield flush()
            if at:
                yield flush()

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("t")).mapInArrow(
        batches, "id long, th long, start int, end int, h1 long, h2 long")


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                   hot_shares: int = HOT_SHARES) -> DataFrame:
    """Spans to remove: ``id``, ``th``, ``spans`` (sorted array of start, end), one row per document that has any.

    The first shuffle counts 64 bits of each digest, pre-aggregated, and keeps
    those seen twice; only their units are ranked by the full digest. Units of
    a digest that holds more than one in ``hot_shares`` of all repeated units
    are dealt over as many tasks as it holds shares, in both joins; the list of
    such digests has at most ``hot_shares`` rows. Earliest is the least id,
    rows without an id last, then the least text hash and offset; repeated rows
    of one id and text rank alike and stay together.
    """
    u = unit_rows(docs, id_col, text_col, min_words)
    often = settle(u.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    share = (often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] or 0) / hot_shares
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(max(1.0, share)))).cast("int")
    hot = F.broadcast(often.filter(F.col("n") > max(1.0, share) * 2).select(F.col("h1").alias("hot"), parts.alias("parts")))
    often = often.select(F.col("h1").alias("k1"), F.when(F.col("n") > max(1.0, share) * 2, parts).otherwise(1).alias("all_parts"))

    def spread(keyed: DataFrame) -> DataFrame:
        return keyed.withColumn("kpart", F.explode(F.sequence(F.lit(0), F.col("all_parts") - 1)))

    dealt = u.join(hot, F.col("h1") == F.col("hot"), "left").withColumn(
        "part", F.pmod(F.xxhash64("id", "th", "start"), F.coalesce("parts", F.lit(1))).cast("int")).drop("hot", "parts")
    # read twice below, and far smaller than the texts it comes from
    again = settle(dealt.join(spread(often), (F.col("h1") == F.col("k1")) & (F.col("part") == F.col("kpart"))).drop("k1", "kpart"))
    rank = F.struct(F.coalesce("id", F.lit(_LAST)).alias("id"), F.col("th"), F.col("start"))
    first = spread(again.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.max("all_parts").alias("all_parts"))).select(
        F.col("h1").alias("k1"), F.col("h2").alias("k2"), "kpart", "first")
    drop = again.join(first, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("part") == F.col("kpart"))).filter(F.col("first") != rank)
    joined = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "end"))), F.array().cast("array<struct<start:int,end:int>>"),
        lambda s, x: F.when((F.size(s) > 0) & (F.element_at(s, -1)["end"] > x["start"]), F.concat(
            F.slice(s, 1, F.size(s) - 1), F.array(F.struct(F.element_at(s, -1)["start"].alias("start"), F.greatest(F.element_at(s, -1)["end"], x["end"]).alias("end"))))
        ).otherwise(F.concat(s, F.array(x))))
    return drop.groupBy("id", "th").agg(joined.alias("spans"))


def _with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``__spans`` of each row, null where there are none."""
    known = spans.select(F.col("id").alias("__span_id"), F.col("th").alias("__span_th"), F.col("spans").alias("__spans"))
    mine = (F.xxhash64(F.col(text_col).cast("string")) == F.col("__span_th")) & F.col(id_col).cast("long").eqNullSafe(F.col("__span_id"))
    return docs.join(known, mine, "left")


def dedup_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, ``n_chars``, ``n_removed``, ``removed_chars``, ``removed`` (start:end joined by commas) of each row.

    Null and empty texts have no units; an empty table gives no rows; rows
    without an id rank last, by text hash; repeated rows are returned each; texts
    of any length are read whole.
    """
    spans = repeated_units(docs, id_col, text_col, min_words)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("__th"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars"))
    known = spans.select(F.col("id").alias("__id"), F.col("th").alias("__k"), "spans")
    return rows.join(known, (F.col("__th") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left").select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]), F.lit(0)).cast("long").alias("removed_chars"),
        F.coalesce(F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ","), F.lit("")).alias("removed"))


def remove_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated units cut out of the text; other columns and all rows as they are.

    Null and empty texts stay; repeated rows are cut alike; an empty table gives no rows.
    """
    step = F.aggregate(
        F.col("__spans"), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, x: F.struct(F.concat(s["out"], F.substring(F.col(text_col), s["at"] + 1, x["start"] - s["at"])).alias("out"), x["end"].alias("at")),
        lambda s: F.concat(s["out"], F.substring(F.col(text_col), s["at"] + 1, F.length(F.col(text_col)))))
    joined = _with_spans(docs, repeated_units(docs, id_col, text_col, min_words), id_col, text_col)
    return joined.withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(step)).select(docs.columns)
