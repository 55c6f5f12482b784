"""Mixing sources to target weights by Sainte-Lague apportionment, JVM only.

Blocks of equal size are handed to sources by highest quotients, then within a
source to its shards likewise, which gives each shard an integer quota. A shard
is a stream of its documents in seeded order; a quota of q blocks reads the
stream from its start, round and round, so a document is taken as often as the
quota passes it. Nothing is collected: all steps are joins, aggregates and
windows over bounded groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 20
#: Least documents of a shard, before their number grows with the root of the source's.
SHARD_ROWS = 64
#: Names of the columns that the mix adds.
ADDED = ("size", "source_size", "target", "taken")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEAT) -> DataFrame:
    """Adds ``weight`` and ``target`` to rows of ``source``, ``source_size``.

    Targets share the sum of all sizes by weight; none is above ``cap`` times its
    source's size, and what such sources leave is shared again by weight. In the
    order of cap per weight the capped sources are a prefix, so running sums
    find the level at once.
    """
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*map(F.lit, weights)), F.pmod(n, F.lit(len(weights))) + 1)
    order = Window.orderBy(F.col("limit") / F.col("weight"), "weight", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    x = sources.withColumn("weight", pick).withColumn("limit", F.col("source_size") * cap)
    x = x.withColumn("total", F.sum("source_size").over(everything))
    x = x.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0))).cast("double")
                     / F.sum("weight").over(after))
    x = x.withColumn("capped", F.col("limit") < F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(everything)
    x = x.withColumn("_level", level["level"])
    target = F.when(F.col("capped"), F.col("limit").cast("double")).otherwise(
        F.least(F.col("limit").cast("double"), F.col("_level") * F.col("weight")))
    return x.withColumn("target", F.coalesce(target, F.lit(0.0))).drop("limit", "total", "level", "capped", "_level")


def apportion(parties: DataFrame, votes: str, seats: Column, by: list[str], order: list[str], out: str) -> DataFrame:
    """Sainte-Lague seats of each row within its group ``by``; ties go by ``order``.

    The divisor that gives all seats lies within half a seat per party of the
    plain one, so only the quotients between those bounds compete: about two per
    party, however many seats there are.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    x = parties.withColumn("_v", F.col(votes).cast("double")).withColumn("_seats", seats)
    x = x.withColumn("_n", F.count(F.lit(1)).over(group)).withColumn("_sum", F.sum("_v").over(group))
    share = F.when(F.col("_sum") > 0, F.col("_v") / F.col("_sum")).otherwise(F.lit(0.0))
    low = F.greatest(F.lit(0), F.floor((F.col("_seats") - F.col("_n") / 2 - 1) * share + 0.5))
    high = F.greatest(low, F.ceil((F.col("_seats") + F.col("_n") / 2 + 1) * share + 0.5))
    x = x.withColumn("_low", low.cast("long")).withColumn("_high", high.cast("long"))
    x = x.withColumn("_rest", F.col("_seats") - F.sum("_low").over(group))
    seat = F.explode_outer(F.when((F.col("_high") > F.col("_low")) & (F.col("_v") > 0), F.sequence(F.col("_low") + 1, F.col("_high"))))
    q = x.withColumn("_seat", seat).withColumn("_quotient", F.col("_v") / (2 * F.col("_seat") - 1))
    rank = F.row_number().over(group.orderBy(F.col("_quotient").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in order], "_seat"))
    q = q.withColumn("_won", ((rank <= F.col("_rest")) & F.col("_seat").isNotNull()).cast("long"))
    keys = [*by, *[c for c in parties.columns if c not in by]]
    return q.groupBy(*keys, "_low").agg(F.sum("_won").alias("_w")).withColumn(
        out, F.col("_low") + F.col("_w")).drop("_low", "_w")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEAT, block: int = 64, seed: int = SEED,
        carry: list[str] | None = None) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` of each row.

    With ``carry``, those columns of ``docs`` come in place of ``doc_id``; one
    that has the name of an added column, whatever its case, comes as
    ``<name>_before``.

    ``size`` is the number of words (null text: 0). A quota is ``block`` words
    times its blocks, held to ``cap`` times the shard's size, so no document is
    taken more than ``cap`` times. Null sources are one source, ordered last;
    null ids form streams like any other; repeated rows are separate documents;
    documents of one draw are ordered by id and size, and only rows equal in id
    and text can tie, so reruns agree; an empty table gives no rows; with no
    words at all every target is zero. Texts of any length are counted whole.
    """
    carried = [F.struct(*carry).alias("_carried")] if carry else []
    text = F.col(text_col).cast("string")
    # 120 bits of the seed, id and text: 60 order a stream, 60 deal the shards
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    sized = docs.select(
        *carried, F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), digest.alias("_digest"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = source_targets(sources, weights, cap)
    blocks = F.round(F.sum("target").over(Window.partitionBy(F.lit(1))) / block).cast("long")
    sources = apportion(sources, "target", blocks, [], ["source"], "source_blocks")
    shards_of = F.ceil(F.col("n_docs") / F.greatest(F.lit(float(SHARD_ROWS)), F.sqrt("n_docs"))).cast("long")
    sources = small(sources.withColumn("n_shards", F.greatest(F.lit(1).cast("long"), shards_of)).select(
        F.col("source").alias("_source"), "source_size", "target", "source_blocks", "n_shards"))
    rows = sized.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    part = [F.conv(F.substring("_digest", at, 15), 16, 10).cast("long") for at in (1, 16)]
    rows = rows.withColumn("draw", part[0]).withColumn("shard", F.pmod(part[1], F.col("n_shards"))).drop("_digest")
    shards = rows.groupBy("source", "shard").agg(
        F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks"))
    quotas = small(apportion(shards, "shard_size", F.col("source_blocks"), ["source"], ["shard"], "quota").select(
        F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size",
        F.least(F.col("quota") * block, F.col("shard_size") * cap).alias("words")))
    rows = rows.join(quotas, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    stream = Window.partitionBy("source", "shard").orderBy("draw", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(
        Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(stream), F.lit(0))
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(F.lit(0))
    rest = F.col("words") - rounds * F.col("shard_size")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    first = [F.col("_carried").getField(c).alias(f"{c}_before" if c.lower() in ADDED else c) for c in carry] if carry else ["doc_id"]
    return rows.withColumn("taken", taken.cast("long")).select(*first, *ADDED)
