"""What several corpus operators share: word rules and components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import ensure_checkpoint_dir, settle

__all__ = ["ASCII_LOWER", "SMALL_ROWS", "WORD", "components", "ensure_checkpoint_dir", "settle", "small", "words_of"]

#: Rows of some tens of bytes that are broadcast at most.
SMALL_ROWS = 200_000

#: A word is a run of anything but the ASCII blanks 0x20 and 0x09-0x0D;
#: ``bytes.split()`` without arguments cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"

#: Lower-cases A-Z and nothing else, on UTF-8 bytes.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, as UTF-8 bytes; null is empty."""
    return text.encode("utf-8", "replace").translate(ASCII_LOWER).split() if text else []


def small(df: DataFrame) -> DataFrame:
    """``df`` computed once, and sent to every task while it has at most ``SMALL_ROWS`` rows; beyond, joins shuffle."""
    df = settle(df)
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.lit(0)).alias("s"),
    ).first()
    return row["n"], row["s"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by alternating star contraction.

    ``edges``: columns ``u``, ``v`` (long), in any direction, loops and repeats
    allowed. Returns ``node``, ``component`` (the least node reachable) for each
    node of an edge between two different nodes; an empty graph gives no rows.

    Each round connects every node's larger neighbours to its least neighbour,
    then every node's smaller neighbours likewise; minima are pre-aggregated and
    joined back, so a star centre with a third of the edges is an ordinary
    skewed join. Each round is checkpointed to the shared folder.
    """
    edges = settle(edges.filter("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _fingerprint(edges)
    if not before[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        edges = settle(small)
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
