"""SimHash near-duplicates through a segment-popcount grid.

A 64-bit fingerprint is embedded as the bit counts of its segments. Flipping one
bit moves one count by one, so the Manhattan distance of two embeddings is a
lower bound of the Hamming distance: pairs within ``max_bits`` are within that
range on the integer grid. A range of two is joined by meeting half-way: each
point visits its own cell and those one step away, two points in range share
the cell between them, and of several ways to meet one is taken as canonical.
The XOR of the fingerprints then verifies each pair exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, settle, small, words_of

SEED = 42
SEGMENTS = 16
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned SimHash of one text: a bit is 1 if set in over half the hashes.

    Shingles keep repeats; a text of fewer words is one shingle; no words give 0.
    """
    words = words_of(text)
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        bits = np.unpackbits(hashes[at:at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id``, a 64-bit hash ``h`` of the text and the fingerprint ``fp`` (as a signed long) of each row."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["id", "h", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("t")).mapInArrow(
        batches, "id long, h long, fp long")


def _counts(fp: Column) -> list[Column]:
    width = 64 // SEGMENTS
    mask = (1 << width) - 1
    return [F.bit_count(F.shiftrightunsigned(fp, width * k).bitwiseAND(F.lit(mask))) for k in range(SEGMENTS)]


def grid_links(fps: DataFrame) -> DataFrame:
    """Pairs ``u`` < ``v`` of different fingerprints (column ``fp``, distinct) within 2 bits."""
    width = 64 // SEGMENTS
    base = width + 1
    moves = [F.struct(F.lit(0).alias("move"), F.lit(0).cast("long").alias("by"))]
    for k in range(1, SEGMENTS + 1):
        step, c = base ** (k - 1), F.col("c")[k - 1]
        moves.append(F.when(c < width, F.struct(F.lit(k).alias("move"), F.lit(step).cast("long").alias("by"))))
        moves.append(F.when(c > 0, F.struct(F.lit(-k).alias("move"), F.lit(-step).cast("long").alias("by"))))
    cells = (
        fps.select("fp", F.array(*_counts(F.col("fp"))).alias("c"))
        .select("fp", sum(F.col("c")[k] * F.lit(base**k).cast("long") for k in range(SEGMENTS)).alias("key"),
                F.explode(F.array_compact(F.array(*moves))).alias("s"))
        .select("fp", (F.col("key") + F.col("s.by")).alias("cell"), F.col("s.move").cast("byte").alias("move"))
    )
    a = cells.select(F.col("cell"), F.col("fp").alias("u"), F.col("move").alias("a"))
    b = cells.select(F.col("cell").alias("cell_b"), F.col("fp").alias("v"), F.col("move").alias("b"))
    canonical = F.expr(
        "(a >= 0 and b = 0) or (a = 0 and b > 0) or (a > 0 and b < 0 and a <= -b)"
        " or (a < 0 and b > 0 and -a <= b) or (a > 0 and b > 0 and a <> b)")
    return a.join(b, (F.col("cell") == F.col("cell_b")) & (F.col("u") < F.col("v")) & canonical
                  & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)).select("u", "v")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``id``, ``h``, ``fp``, ``root`` (a name of the component) and ``component_id`` of each row."""
    marked = settle(fingerprints(docs, id_col, text_col, shingle))
    nodes = settle(marked.groupBy("fp").agg(F.min("id").alias("rep")))
    roots = components(grid_links(nodes.select("fp")))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return marked.join(named.join(least, "root").select("fp", "root", "component_id"), "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of each row.

    Rows of equal fingerprint are one node, so a group of copies costs one row
    after a pre-aggregated minimum; only different fingerprints are compared.
    Nulls and empty texts have fingerprint zero and link like any other; an
    empty table gives no rows; repeated rows are returned as often as they come;
    a null id is kept and never is a component's name unless no other id is there.
    """
    return _grouped(docs, id_col, text_col, shingle).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row (all columns) of each group of ``docs``: that of least id, rows without an id last.

    Groups are those of ``simhash_groups``: at most two bits of 64 apart, link by
    link. A row is known by id and text, so rows of one id but unlike texts are
    separate documents; of repeated rows that are kept, one stays. Texts without
    words, null ones too, are one group; an empty table stays empty. Texts of
    any length are read whole. The texts of kept rows move once.
    """
    groups = _grouped(docs.select(id_col, text_col), id_col, text_col, shingle)
    rows = groups.groupBy("root", "id", "h").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("without"), "id", "h", "n")).alias("x"))
    kept = settle(first.select(F.col("x.id").alias("__kept_id"), F.col("x.h").alias("__kept_h"), F.col("x.n").alias("__times")))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__kept_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__kept_h"))
    once = docs.join(kept.filter("__times = 1"), same, "left_semi")
    again = docs.join(small(kept.filter("__times > 1")), same, "left_semi").dropDuplicates([id_col, text_col])
    return once.unionByName(again)
