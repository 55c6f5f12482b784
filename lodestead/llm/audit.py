"""How corpus filters interact: what each removes in every order of applying them.

Four filters judge a text alone; the fifth asks whether a smaller id has the same
text anywhere in the table. That is decided in radix tries over whole texts.

* A task first puts its own texts into a trie (emptied when it holds
  ``LOCAL_BYTES``), so a text that fills a third of the table leaves each task
  once. A terminal holds the least id of its text; every other row of it is a
  duplicate already.
* What is left is dealt by text prefixes, each a range of texts. Prefixes grow
  only where a range holds more than ``RANGE_BYTES``, or the 200,000th part of
  all bytes, so ranges are bounded and so is the number of those that grow. A
  range that is one text however often copied doesn't grow; its rows meet in
  ``SHARES`` tries first, then in one.
* A second trie for each range settles the least ids; its traversal tells the
  rows that hold them, all others are duplicates.

Each row comes out as a mask of the filters that it fails; all orders are sums
over masks.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

FILTERS = "ABCDE"
#: Bytes of texts in a task's own trie before it is emptied.
LOCAL_BYTES = 32 << 20
#: Bytes of a range of texts that one trie holds.
RANGE_BYTES = 64 << 20
#: Ranges whose prefix is told apart by a broadcast table, at most.
LONG_RANGES = 200_000
SHARES = 32
FIRST_PREFIX, GROWTH = 4, 4
_UPPER = bytes(range(65, 91))
_MARKS = re.compile(rb"[#$%&*|]")
_BATCH_BYTES = 8 << 20
_DUPLICATE = 16


def text_mask(text: str) -> int:
    """Bits 1, 2, 4, 8 for the filters A to D that a text fails: few words, repeated words, capitals, marks."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    return ((n < 50) | (100 * len(set(words)) < 65 * n) << 1
            | (100 * (len(raw) - len(raw.translate(None, _UPPER))) > 5 * len(text)) << 2 | (_MARKS.search(raw) is not None) << 3)


class Trie:
    """A compressed trie: an edge holds a run of characters, a terminal the least id of its text and the rows that have it."""

    def __init__(self) -> None:
        self.root: list = [{}, None]
        self.held = 0

    def terminal(self, text: str) -> list:
        """The node of ``text``, made where it is missing, as [edges, [least id, mask, rows] or None]."""
        node, at, n = self.root, 0, len(text)
        while at < n:
            edge = node[0].get(text[at])
            if edge is None:
                leaf: list = [{}, None]
                node[0][text[at]] = [text[at:], leaf]
                self.held += n - at
                return leaf
            label = edge[0]
            if not text.startswith(label, at):
                low, high = 1, min(len(label), n - at)
                while low < high:
                    half = (low + high + 1) // 2
                    if text.startswith(label[:half], at):
                        low = half
                    else:
                        high = half - 1
                edge[0], edge[1] = label[:low], [{label[low]: [label[low:], edge[1]]}, None]
                label = edge[0]
            node, at = edge[1], at + len(label)
        return node

    def add(self, text: str, key: int, mask: int | None, row: tuple, n: int, duplicate) -> None:
        """Insert a row; ``duplicate(mask, row, n)`` is told of rows that a smaller id precedes."""
        node = self.terminal(text)
        held = node[1]
        if held is None:
            node[1] = [key, text_mask(text) if mask is None else mask, Counter({row: n})]
        elif key < held[0]:
            for other, m in held[2].items():
                duplicate(held[1], other, m)
            held[0], held[2] = key, Counter({row: n})
        elif key == held[0]:
            held[2][row] += n
        else:
            duplicate(held[1], row, n)

    def walk(self) -> Iterator[tuple[str, list]]:
        """Every text with its terminal, in no order."""
        todo = [(self.root, "")]
        while todo:
            node, text = todo.pop()
            if node[1] is not None:
                yield text, node[1]
            todo += [(child, text + label) for label, child in node[0].values()]


class _Rows:
    """Output rows, handed out as batches."""

    names = ["text", "doc_id", "part", "mask", "n"]
    types = [pa.large_string(), pa.int64(), pa.string(), pa.int32(), pa.int64()]

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.size = 0

    def put(self, text: str | None, mask: int, row: tuple, n: int) -> None:
        self.rows.append((text, *row, mask, n))
        self.size += 64 + len(text or "")

    def duplicate(self, mask: int, row: tuple, n: int) -> None:
        self.put(None, mask | _DUPLICATE, row, n)

    def batches(self, rest: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (rest or self.size > _BATCH_BYTES):
            columns = zip(*self.rows, strict=True)
            arrays = [pa.array(c, t) for c, t in zip(columns, self.types, strict=True)]
            arrays[0] = arrays[0].cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, self.names)
            self.rows, self.size = [], 0


_SCHEMA = "text string, doc_id long, part string, mask int, n long"


def _local(limit: int):
    """Rows (``doc_id``, ``text``, ``part``) of a task to the first of each text (with it) and duplicates (without)."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(), _Rows()

        def empty() -> Iterator[pa.RecordBatch]:
            for text, (_, mask, rows) in trie.walk():
                for row, n in rows.items():
                    out.put(text, mask, row, n)
                yield from out.batches()

        for b in it:
            for key, text, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key is None:
                    out.put(None, text_mask(text), (None, part), 1)
                else:
                    trie.add(text, key, None, (key, part), 1, out.duplicate)
                if trie.held > limit:
                    yield from empty()
                    trie = Trie()
            yield from out.batches()
        yield from empty()
        yield from out.batches(True)

    return run


def _ranged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``leaf``: one trie a leaf; rows of one share of a single text keep it, as they have to meet once more."""
    trie, out, at, open_ = Trie(), _Rows(), None, False

    def empty() -> Iterator[pa.RecordBatch]:
        for text, (_, mask, rows) in trie.walk():
            for row, n in rows.items():
                out.put(text if open_ else None, mask, row, n)
            yield from out.batches()

    for b in it:
        for text, key, part, mask, n, leaf, shared in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if text is None:
                out.put(None, mask, (key, part), n)
                continue
            if (leaf, shared) != (at, open_):
                yield from empty()
                trie, at, open_ = Trie(), leaf, shared
            trie.add(text, key, mask, (key, part), n, out.duplicate)
        yield from out.batches()
    yield from empty()
    yield from out.batches(True)


def long_ranges(docs: DataFrame, range_bytes: int = RANGE_BYTES, parts: int = 1) -> tuple[list[tuple[int, DataFrame]], int]:
    """The prefixes whose texts outgrow a range, as (length, ``h``, ``deeper``) by length; and the bytes of all texts.

    Of a small table a range holds half of what each of ``parts`` tasks would.
    ``h`` is a hash of the prefix, as it only tells where a text goes;
    ``deeper`` is false where all texts behind it are one. All lengths are summed
    in one pass: a text has a prefix of each length until one holds it whole.
    """
    texts = docs.select("text", F.octet_length("text").cast("long").alias("bytes"))
    total = texts.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("s")).first()["s"]
    most = max(min(range_bytes, total // (2 * parts)), total // LONG_RANGES, 1)
    # the longest text there can be has 2^31 characters
    sizes = [FIRST_PREFIX * GROWTH ** k for k in range(15)]
    prefixes = F.array(*[F.when((F.length("text") >= size // GROWTH) | F.lit(size == FIRST_PREFIX), F.struct(F.lit(size).alias("size"), F.xxhash64(F.substring("text", 1, size)).alias("h"))) for size in sizes])
    held = texts.select("bytes", F.xxhash64("text").alias("whole"), F.explode(F.array_compact(prefixes)).alias("p")).groupBy("p.size", "p.h").agg(
        F.sum("bytes").alias("bytes"), (F.min("whole") != F.max("whole")).alias("deeper"))
    hot = settle(held.filter(F.col("bytes") > most).select("size", "h", "deeper"))
    levels = sorted((r["size"], r["deeper"]) for r in hot.groupBy("size").agg(F.max("deeper").alias("deeper")).collect())
    # behind a length at which every range is one text there is nothing to part
    last = next((k for k, (_, deeper) in enumerate(levels) if not deeper), len(levels))
    return [(size, hot.filter(F.col("size") == size).select("h", "deeper")) for size, _ in levels[:last + 1]], total


def filter_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
                 range_bytes: int = RANGE_BYTES, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """``doc_id``, ``part``, ``mask``, ``n``: the filters that each document fails (bits 1 to 16 for A to E).

    ``n`` counts repeated equal rows, which share an id and so aren't duplicates
    of each other. A null id is no smaller and no larger than another, so such a
    row neither is nor makes a duplicate. Null texts are empty ones, null parts
    the empty string. Texts of any length are held whole. An empty table gives no
    rows; further columns aren't read.
    """
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                    F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    parts = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    levels, total = long_ranges(x, range_bytes, parts)
    parts = max(parts, -(-total // range_bytes))
    firsts = x.select("doc_id", "text", "part").mapInArrow(_local(local_bytes), _SCHEMA)
    depth, open_, shared = F.lit(FIRST_PREFIX), F.col("text").isNotNull(), F.lit(False)
    for size, hot in levels:
        known = hot.select(F.col("h").alias(f"h{size}"), F.col("deeper").alias(f"d{size}"))
        firsts = firsts.withColumn(f"h{size}", F.xxhash64(F.substring("text", 1, size))).join(F.broadcast(known), f"h{size}", "left")
        deeper = open_ & F.coalesce(F.col(f"d{size}"), F.lit(False))
        shared = shared | (open_ & F.coalesce(~F.col(f"d{size}"), F.lit(False)))
        depth, open_ = F.when(deeper, size * GROWTH).otherwise(depth), deeper
    firsts = firsts.withColumn("depth", depth).withColumn("shared", shared)
    share = F.when(F.col("shared"), F.pmod(F.spark_partition_id(), F.lit(SHARES))).otherwise(0)
    # duplicates without a text go anywhere
    leaf = F.when(F.col("text").isNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64(F.expr("substring(text, 1, depth)"), share))

    def meet(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "leaf").sortWithinPartitions("leaf", "shared").select(*_Rows.names, "leaf", "shared").mapInArrow(_ranged, _SCHEMA)

    met = meet(firsts.withColumn("leaf", leaf))
    if levels:
        met = settle(met)
        again = met.filter("text is not null").withColumn("leaf", F.xxhash64("text")).withColumn("shared", F.lit(False))
        met = met.filter("text is null").union(meet(again))
    return met.select("doc_id", "part", "mask", "n")


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask``, ``n``, ``good``, ``toxic``: documents by mask, and those of them that ``labels`` calls good or toxic."""
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("quality"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    x = masks.join(known, "doc_id", "left")
    return x.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.coalesce(F.col(k), F.lit(0)) * F.col("n")).alias(name) for k, name in (("quality", "good"), ("toxic", "toxic"))])


def _steps() -> list[tuple]:
    """Of every mask, order and step: is such a document kept, removed, redundant, failed by this filter alone; in how many orders this filter removes it."""
    out = []
    for order in itertools.permutations(range(5)):
        name, before = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            bit = 1 << f
            for mask in range(32):
                fails, gone = bool(mask & bit), bool(mask & before)
                out.append((mask, name, step, int(not (gone or fails)), int(fails and not gone), int(fails and gone), int(mask == bit), 120 // mask.bit_count() if fails else 0))
            before |= bit
    return out


def interactions(counts: DataFrame) -> DataFrame:
    """The audit of every part, order and step from ``mask_counts``; a part without documents has no rows."""
    steps = counts.sparkSession.createDataFrame(_steps(), "mask int, filter_order string, step int, kept int, removed int, redundant int, only int, orders int")
    n = F.col("n")
    sums = {"kept": F.col("kept") * n, "removed": F.col("removed") * n, "redundant": F.col("redundant") * n, "unique_fails": F.col("only") * n,
            "good_lost": F.col("removed") * F.col("good"), "toxic_lost": F.col("removed") * F.col("toxic"), "shapley": F.col("orders") * n}
    return counts.join(F.broadcast(steps), "mask").groupBy("part", "filter_order", "step").agg(
        *[F.sum(c).cast("long").alias(name) for name, c in sums.items()])
