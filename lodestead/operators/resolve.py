"""Entity resolution: candidate pairs by blocking, a score ladder, and star clusters.

The names are scored pair by pair in the order of their rank (the least claim
id). Greedy star clustering visits names by rank: one not yet absorbed is a seed
and absorbs the unabsorbed names that match it. That is the lexicographically
first maximal independent set of the match graph, which is found in parallel
rounds (Blelloch, Fineman, Shun 2012); members then join their least seed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import settle, small
from ..functions.names import first_token, last_token, nickname_groups, normalize_name
from ..functions.phonetics import phonetic_codes
from ..functions.similarity import similarity
from .analyze import entity_name_sets, entity_stats

THRESHOLD = 0.85


def name_features(names: DataFrame, entries: dict[str, list[str]] | None = None) -> DataFrame:
    """``name``, ``rank`` with what scoring needs of a name, made once per name and phonetics once per token."""
    x = names.select("name", "rank").withColumn("norm", normalize_name(F.col("name"))).withColumn(
        "first", first_token(F.col("name"))).withColumn("last", last_token(F.col("name")))
    x = x.withColumn("last_norm", normalize_name(F.col("last"))).withColumn(
        "spoken", F.when(F.col("first") != "", F.col("first")).otherwise(F.col("name"))).withColumn(
        "groups", nickname_groups(F.col("first"), entries))
    codes = x.select(F.explode(F.array("last", "spoken")).alias("token")).distinct().withColumn("code", phonetic_codes("token"))
    last = codes.select(F.col("token").alias("last"), F.col("code.primary").alias("last_p"), F.col("code.secondary").alias("last_s"))
    spoken = codes.select(F.col("token").alias("spoken"), F.col("code.primary").alias("first_p"), F.col("code.secondary").alias("first_s"))
    return x.join(last, "last").join(spoken, "spoken")


def candidate_pairs(features: DataFrame, bare_names: str = "close", cut: float = 0.0) -> DataFrame:
    """``rank_a`` < ``rank_b`` of all pairs that the ladder compares as names of one surname, match or not.

    Such pairs have one normal form, or last tokens of one form or sound; each
    case is an equi-join. A name of one token (a bare name) may match any other:
    ``bare_names="close"`` adds the pairs of bare names that can match, at
    whatever threshold; ``"none"`` leaves that case out; ``"every"`` pairs them
    with all names, also those that only score without a match, which is a
    product of two tables. ``matching_pairs`` makes only pairs that can match.
    """
    x = settle(features.select("rank", "name", *_COMPARED))
    full, bare = x.filter("last <> ''"), x.filter("last = ''")
    parts = [_met(x, x, "norm", "norm"), _met(full, full, "last_norm", "last_norm"), _met(full, full, "last_p", "last_p"), _met(full, full, "last_p", "last_s")]
    if bare_names == "every":
        alone = bare.select(F.col("rank").alias("a")).join(x.select(F.col("rank").alias("b")), F.col("a") != F.col("b"))
        parts.append(alone.select(F.least("a", "b").alias("rank_a"), F.greatest("a", "b").alias("rank_b")))
    elif bare_names == "close":
        alone = bare.select(F.col("rank").alias("bare"))
        close = _bare_pairs(x).union(_high_pairs(x, cut).select("rank_a", "rank_b"))
        parts += [close.join(alone, F.col("bare") == F.col(side), "left_semi") for side in ("rank_a", "rank_b")]
    return reduce(DataFrame.union, parts).distinct()


_COMPARED = ("norm", "first", "last", "last_norm", "last_p", "last_s", "first_p", "first_s", "groups")
#: Rows of one key that meet in one tile at most.
TILE = 2000
#: The score from which names match whatever they sound like.
HIGH = 90


def _met(left: DataFrame, right: DataFrame, key_a: str, key_b: str) -> DataFrame:
    a = left.select(F.col("rank").alias("a"), F.col(key_a).alias("k"))
    b = right.select(F.col("rank").alias("b"), F.col(key_b).alias("k"))
    return a.join(b, "k").filter("a <> b").select(F.least("a", "b").alias("rank_a"), F.greatest("a", "b").alias("rank_b"))


def _new_pairs(rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """As ``tiled_pairs``, but only pairs with a row of ``fresh`` (``rank``); that side is the small one of each key."""
    rows = rows.distinct()
    a = rows.join(fresh, "rank", "left_semi").select("k", F.col("rank").alias("a"), F.col("role").alias("role_a"))
    b = rows.select("k", F.col("rank").alias("b"), F.col("role").alias("role_b"))
    return a.join(b, "k").filter("a <> b and role_a + role_b < 2").select(F.least("a", "b").alias("rank_a"), F.greatest("a", "b").alias("rank_b"))


def tiled_pairs(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """``rank_a`` < ``rank_b`` of rows (``rank``, ``k``, ``role``) of one key that aren't both of role 1.

    A key of more than ``tile`` rows is dealt into shares; each pair of shares
    meets by itself, so no task holds a whole key.
    """
    rows = rows.distinct()
    hot = rows.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("shares")).filter("shares > 1")
    x = rows.join(hot, "k", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    mine, every = F.pmod(F.xxhash64("rank"), F.col("shares")).cast("int"), F.sequence(F.lit(0), F.col("shares") - 1)
    a = x.select("k", mine.alias("i"), F.explode(every).alias("j"), F.col("rank").alias("rank_a"), F.col("role").alias("role_a"))
    b = x.select("k", F.explode(every).alias("i"), mine.alias("j"), F.col("rank").alias("rank_b"), F.col("role").alias("role_b"))
    return a.join(b, ["k", "i", "j"]).filter("rank_a < rank_b and role_a + role_b < 2").select("rank_a", "rank_b")


def _firsts() -> Column:
    """What two names of one surname match by, whatever their letters: groups of nicknames, and sounds of the first token."""
    sounds = F.filter(F.array_distinct(F.array("first_p", "first_s")), lambda c: c != "")
    return F.concat(F.transform("groups", lambda g: F.concat(F.lit("nick|"), g)), F.transform(sounds, lambda c: F.concat(F.lit("sound|"), c)))


def _bare_pairs(x: DataFrame) -> DataFrame:
    """Bare names with all names that share a group of nicknames or a sound of the first token."""
    keys = x.select("rank", "last", F.explode(_firsts()).alias("k"))
    return _met(keys.filter("last = ''"), keys, "k", "k")


def _grams(c: Column, q: int) -> Column:
    every = F.transform(F.sequence(F.lit(1), F.length(c) - (q - 1)), lambda i: F.substring(c, i, F.lit(q)))
    return F.when(F.length(c) >= q, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def _lost(kind: str, q: int, t: float) -> Column:
    """How many pieces of ``q`` letters of the shorter of two forms, of n letters, the longer one can lack at a score of ``t``.

    With L common letters of n and m = n + d, 2 L >= t (n + m); the shorter loses
    x = n - L letters, the longer has x + d others. A lost letter breaks q pieces,
    one put in q - 1. The part of a longer name that the partial score takes is
    as long as the shorter, so d is 0 there.
    """
    if kind == "part":
        return F.floor(F.col("n") * (1 - t) + 1e-9) * (2 * q - 1)
    spare = f"cast(floor((2 * n + d) * {1 - t} + 1e-9) as int)"
    return F.expr(f"array_max(transform(sequence(0, cast(ceil(n * {2 * (1 - t) / t}) as int)), d -> if(d <= {spare}, {2 * q - 1} * ((({spare}) - d) div 2) + {q - 1} * d, 0)))")


def _high_pairs(x: DataFrame, cut: float = 0.0, fresh: DataFrame | None = None) -> DataFrame:
    """Pairs whose score can be ``HIGH`` (or 100 ``cut``, if more): a similarity join on each of the three forms that are scored.

    The longer form lacks at most ``_lost`` pieces of the shorter, so of any one
    more it holds one. A form asks by pieces of one, two or three letters,
    whichever are rarest in sum. What meets is filtered by all pieces that are
    lacking, and by length and edit distance or containment, before it is scored
    as text.
    """
    t = (max(HIGH, 100 * cut) - 0.5) / 100
    words = F.array_join(F.array_sort(F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), " ")
    forms = x.select("rank", F.explode(F.array(
        F.struct(F.lit("norm").alias("kind"), F.col("norm").alias("form")), F.struct(F.lit("sorted").alias("kind"), words.alias("form")),
        F.struct(F.lit("part").alias("kind"), F.lower("name").alias("form")))).alias("f")).select("rank", "f.*").filter("form <> ''").withColumn("n", F.length("form"))
    held = settle(reduce(DataFrame.union, [forms.select("rank", "kind", "n", F.lit(q).alias("q"), F.explode(_grams(F.col("form"), q)).alias("piece")) for q in (1, 2, 3)]))
    often = held.groupBy("kind", "q", "piece").agg(F.count(F.lit(1)).alias("often"))
    lost = reduce(lambda c, kq: c.when((F.col("kind") == kq[0]) & (F.col("q") == kq[1]), _lost(*kq, t)), [(k, q) for k in ("norm", "sorted", "part") for q in (1, 2, 3)], F)
    ranked = held.join(often, ["kind", "q", "piece"]).groupBy("rank", "kind", "n", "q").agg(F.array_sort(F.collect_list(F.struct("often", "piece"))).alias("pieces")).withColumn("ask", (lost + 1).cast("int"))
    # letters always do: all of them are asked for if so many can be lost
    ranked = ranked.filter((F.col("ask") <= F.size("pieces")) | (F.col("q") == 1)).withColumn("pieces", F.slice("pieces", 1, F.least("ask", F.size("pieces"))))
    cost = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda s, p: s + p["often"])
    best = ranked.groupBy("rank", "kind", "n").agg(F.min_by(F.struct("q", "pieces"), F.struct(cost, "q")).alias("b"))
    asked = best.select(F.col("rank").alias("a"), "kind", F.col("n").alias("n_a"), F.col("b.q").alias("q"), F.explode("b.pieces.piece").alias("piece"))
    spare = F.floor((F.col("n_a") + F.col("n_b")) * (1 - t) + 1e-9).cast("int")
    holding = held.select(F.col("rank").alias("b"), "kind", F.col("n").alias("n_b"), "q", "piece")
    key = ["kind", "q", "piece"]
    if fresh is None:
        met = asked.join(holding, key)
    else:
        ask, hold = fresh.withColumnRenamed("rank", "a"), fresh.withColumnRenamed("rank", "b")
        met = asked.join(ask, "a", "left_semi").join(holding, key).select("kind", "a", "b", "n_a", "n_b").union(
            asked.join(holding.join(hold, "b", "left_semi"), key).select("kind", "a", "b", "n_a", "n_b"))
    met = met.filter(
        (F.col("a") != F.col("b")) & (F.col("n_a") <= F.col("n_b")) & ((F.col("kind") == "part") | (F.col("n_b") - F.col("n_a") <= spare))).select("kind", "a", "b", "n_a", "n_b").distinct()
    text = forms.select("kind", "rank", "form", *[_grams(F.col("form"), q).alias(f"g{q}") for q in (2, 3)])
    a, b = (text.select("kind", F.col("rank").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("form", "g2", "g3")]) for k in "ab")
    met = met.withColumnsRenamed({"n_a": "n"}).join(a, ["kind", "a"]).join(b, ["kind", "b"])
    # all the pieces that the longer one lacks, not only those asked for; an edit distance is no more than the letters that two forms don't share
    few = reduce(lambda x, y: x & y, [F.size(F.array_except(f"g{q}_a", f"g{q}_b")) <= reduce(lambda c, k: c.when(F.col("kind") == k, _lost(k, q, t)), ("norm", "sorted", "part"), F) for q in (2, 3)])
    near = F.levenshtein("form_a", "form_b") <= F.floor((F.col("n") + F.col("n_b")) * (1 - t) + 1e-9)
    inside = F.col("form_b").contains(F.col("form_a")) | (F.floor(F.col("n") * (1 - t) + 1e-9) > 0)
    return met.filter(few & F.when(F.col("kind") == "part", inside).otherwise(near)).select(F.least("a", "b").alias("rank_a"), F.greatest("a", "b").alias("rank_b")).distinct()


def matching_pairs(features: DataFrame, cut: float = 0.0, bare: bool = True, tile: int = TILE, fresh: DataFrame | None = None) -> DataFrame:
    """``rank_a`` < ``rank_b`` of the pairs that can match with a confidence of ``cut``, at any threshold.

    A match has one normal form; or a shared group of nicknames, or a sound of
    the first token (below ``HIGH`` the ladder asks for it), beside a surname of
    one form or sound or none; or a score of ``HIGH``. The first cases are
    equi-joins, of crowded keys in tiles, the last a similarity join; so a
    surname that a third of the names have pairs only those that may match.
    ``bare=False``: names of one token match their normal form only. ``fresh``
    (``rank``): only pairs with one of these.
    """
    fresh = None if fresh is None else settle(fresh.select("rank").distinct())
    x = settle(features.select("rank", "name", *_COMPARED))
    full = x if bare else x.filter("last <> ''")
    surnames = F.array(*[F.struct(F.concat(F.lit(f"{kind}|"), F.col(c)).alias("s"), F.lit(role).alias("role")) for kind, c, role in (("form", "last_norm", 0), ("sound", "last_p", 0), ("sound", "last_s", 1))])
    keyed = x.filter("last <> ''").select("rank", F.explode(_firsts()).alias("first"), surnames.alias("surnames")).select("rank", "first", F.explode("surnames").alias("s"))
    rows = [x.select("rank", F.col("norm").alias("k"), F.lit(0).alias("role")), keyed.select("rank", F.concat_ws("|", "first", "s.s").alias("k"), "s.role")]
    parts = [tiled_pairs(r, tile) if fresh is None else _new_pairs(r, fresh) for r in rows] + [_high_pairs(full, cut, fresh)]
    if bare:
        parts.append(_bare_pairs(x))
        if fresh is not None:
            parts[-1:] = [parts[-1].join(fresh.withColumnRenamed("rank", side), side, "left_semi").select("rank_a", "rank_b") for side in ("rank_a", "rank_b")]
    pairs = reduce(DataFrame.union, parts).distinct()
    # of names with two different surnames only those that sound alike are compared
    side = x.select("rank", "last", "last_norm", "last_p", "last_s", "norm")
    a, b = (side.select(*[F.col(c).alias(f"{c}_{k}") for c in side.columns]) for k in "ab")
    alike = (F.col("last_p_a") == F.col("last_p_b")) | (F.col("last_p_a") == F.col("last_s_b")) | (F.col("last_s_a") == F.col("last_p_b"))
    apart = (F.col("last_a") != "") & (F.col("last_b") != "") & (F.col("last_norm_a") != F.col("last_norm_b")) & ~alike
    return pairs.join(a, "rank_a").join(b, "rank_b").filter(~apart | (F.col("norm_a") == F.col("norm_b"))).select("rank_a", "rank_b")


def score_pairs(pairs: DataFrame, a: DataFrame, b: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The ladder over pairs (``rank_a``, ``rank_b``) with the features of either side.

    Adds ``score`` (0-100), ``method``, ``confidence`` (0-1) and a struct of
    details. The first three rungs are plain expressions; only pairs that pass
    them undecided are compared as strings.
    """
    cols = ("name", "norm", "first", "last", "last_norm", "groups", "last_p", "last_s", "first_p", "first_s")
    left = a.select(F.col("rank").alias("rank_a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    right = b.select(F.col("rank").alias("rank_b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    x = pairs.join(left, "rank_a").join(right, "rank_b")
    same = F.col("norm_a") == F.col("norm_b")
    alike = (F.col("last_p_a") == F.col("last_p_b")) | (F.col("last_p_a") == F.col("last_s_b")) | (F.col("last_s_a") == F.col("last_p_b"))
    apart = (F.col("last_a") != "") & (F.col("last_b") != "") & (F.col("last_norm_a") != F.col("last_norm_b")) & ~alike
    nick = (F.col("first_a") != "") & (F.col("first_b") != "") & F.arrays_overlap("groups_a", "groups_b")
    x = x.withColumn("rung", F.when(same, 1).when(apart, 2).when(nick, 3).otherwise(4))

    def sounds(p: str, q: str) -> Column:
        return (F.col(f"{p}_a") != "") & (F.col(f"{p}_a") == F.col(f"{q}_b"))

    phonetic = reduce(lambda m, n: m | n, [sounds(p, q) for p in ("first_p", "first_s") for q in ("first_p", "first_s")])
    plain = x.filter("rung < 4").withColumn("sim", F.lit(None).cast("struct<ratio:int,token_sort:int,partial:int>"))
    text = x.filter("rung = 4").withColumn("sim", similarity("norm_a", "norm_b", "name_a", "name_b"))
    x = plain.unionByName(text).withColumn("phonetic_match", phonetic).withColumn("fuzzy", F.greatest("sim.ratio", "sim.token_sort", "sim.partial"))
    rung = F.col("rung")
    spoken = F.col("phonetic_match") & (F.col("fuzzy") >= threshold * 100)
    high = F.col("fuzzy") >= 90
    method = (F.when(rung == 1, "exact_normalized").when(rung == 2, "different_surname").when(rung == 3, "known_nickname")
              .when(spoken, "fuzzy_with_phonetic").when(high, "fuzzy_high_confidence").otherwise("no_match"))
    score = F.when(rung == 1, 100).when(rung == 2, 0).when(rung == 3, 95).otherwise(F.col("fuzzy"))
    confidence = F.when(rung == 1, 1.0).when(rung == 2, 0.0).when(rung == 3, 0.95).when(spoken | high, F.col("fuzzy") / 100).otherwise(0.0)
    details = F.struct(
        F.when(rung == 1, F.col("norm_a")).alias("normalized_name"),
        F.when(rung == 2, F.col("last_a")).alias("surname_a"), F.when(rung == 2, F.col("last_b")).alias("surname_b"),
        F.when(rung == 3, F.col("first_a")).alias("first_a"), F.when(rung == 3, F.col("first_b")).alias("first_b"),
        F.when(rung == 3, F.when(F.col("last_a") != "", F.col("last_a")).otherwise(F.col("last_b"))).alias("surname"),
        F.col("sim.ratio").alias("ratio"), F.col("sim.token_sort").alias("token_sort"), F.col("sim.partial").alias("partial"),
        F.when(rung == 4, F.col("phonetic_match")).alias("phonetic_match"))
    return x.select("rank_a", "rank_b", "name_a", "name_b", score.cast("int").alias("score"), method.alias("method"),
                    confidence.cast("double").alias("confidence"), details.alias("details"))


def match_names(names_a: DataFrame, names_b: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Scores of given pairs of names from two sides, each of ``name`` and ``rank``."""
    return score_pairs(pairs, name_features(names_a), name_features(names_b), threshold)


def potential_matches(target: DataFrame, candidates: DataFrame, min_confidence: float = THRESHOLD, threshold: float = THRESHOLD) -> DataFrame:
    """Candidates that match the one target name, best first; the same text is no candidate."""
    pairs = target.select(F.col("rank").alias("rank_a"), F.col("name").alias("_t")).join(
        candidates.select(F.col("rank").alias("rank_b"), F.col("name").alias("_c")), F.col("_t") != F.col("_c")).select("rank_a", "rank_b")
    scored = match_names(target, candidates, pairs, threshold)
    return scored.filter(F.col("confidence") >= min_confidence).orderBy(F.desc("score"), "rank_b")


def star_clusters(names: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``rank``, ``seed`` of every name, from edges ``rank_a`` < ``rank_b``.

    Each round makes seeds of the undecided names without an undecided neighbour
    of lower rank, and drops the seeds' neighbours. Members join after the last
    round, when every seed is known.
    """
    edges = settle(edges.select("rank_a", "rank_b"))
    names = settle(names.select("rank"))
    left, seeds = names, None
    live = edges
    for _ in range(max_rounds):
        waiting = live.select(F.col("rank_b").alias("rank")).distinct()
        new = left.join(waiting, "rank", "left_anti")
        seeds = settle(new if seeds is None else seeds.union(new))
        dropped = live.join(new.select(F.col("rank").alias("rank_a")), "rank_a", "left_semi").select(F.col("rank_b").alias("rank")).distinct()
        left = settle(left.join(new, "rank", "left_anti").join(dropped, "rank", "left_anti"))
        if left.isEmpty():
            break
        live = settle(live.join(left.select(F.col("rank").alias("rank_a")), "rank_a", "left_semi").join(
            left.select(F.col("rank").alias("rank_b")), "rank_b", "left_semi"))
    else:
        raise RuntimeError(f"clusters did not settle in {max_rounds} rounds")
    joined = edges.join(seeds.select(F.col("rank").alias("rank_a")), "rank_a", "left_semi").groupBy(F.col("rank_b").alias("rank")).agg(F.min("rank_a").alias("seed"))
    members = joined.join(seeds, "rank", "left_anti")
    return members.union(seeds.select("rank", F.col("rank").alias("seed")))


def resolve(claims: DataFrame, threshold: float = THRESHOLD, cut: float = THRESHOLD, require_surname: bool = False) -> DataFrame:
    """``name``, ``rank``, ``seed`` of each distinct subject of ``claims`` (``id``, ``subject_name``).

    ``require_surname``: names of one token only match their equals.
    """
    names = settle(claims.filter(F.col("subject_name").isNotNull()).groupBy(F.col("subject_name").alias("name")).agg(F.min("id").alias("rank")))
    features = settle(name_features(names))
    scored = score_pairs(matching_pairs(features, cut, bare=not require_surname), features, features, threshold).filter((F.col("confidence") >= cut) & (F.col("confidence") > 0))
    clusters = star_clusters(names, scored.filter("rank_a <> rank_b"))
    return names.join(clusters, "rank").select("name", "rank", "seed")


@dataclass
class Resolution:
    """``names`` (``name``, ``rank``, ``seed``: the seed's name) and the matches between them, ``edges`` (``name_a``, ``name_b``)."""

    names: DataFrame
    edges: DataFrame


def _no_resolution(spark: SparkSession) -> Resolution:
    return Resolution(spark.createDataFrame([], "name string, rank bigint, seed string"), spark.createDataFrame([], "name_a string, name_b string"))


def repair_seeds(names: DataFrame, edges: DataFrame, dirty: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``name``, ``rank``, ``is_seed`` of all names, from what held before a change and the names that it touches.

    ``names``: ``name``, ``rank``, ``was_seed`` (null for new ones); ``edges``:
    ``name_a``, ``name_b``; ``dirty``: names that are new, or whose neighbours or
    order changed. Whether a name is a seed depends on its neighbours of lower
    rank only. So the dirty ones are decided beside all others as they were;
    those above a name that came out otherwise are decided next, until none does.
    """
    rank = names.select("name", "rank")
    both = edges.union(edges.select("name_b", "name_a")).toDF("a", "b").distinct()
    below = settle(both.join(rank.toDF("a", "rank_a"), "a").join(rank.toDF("b", "rank_b"), "b").filter("rank_a < rank_b").select(F.col("a").alias("low"), F.col("b").alias("high")))
    state, dirty = settle(names.select("name", F.col("was_seed").alias("seed"))), settle(dirty.select("name").distinct())
    for _ in range(max_rounds):
        if dirty.isEmpty():
            return names.select("name", "rank").join(state.select("name", F.col("seed").alias("is_seed")), "name")
        others = state.join(dirty, "name", "left_anti")
        seeds, left = others.filter("seed").select("name"), dirty
        chosen = dirty.limit(0)
        for _ in range(max_rounds):
            covered = below.join(seeds.withColumnRenamed("name", "low"), "low", "left_semi").select(F.col("high").alias("name")).distinct()
            left = settle(left.join(covered, "name", "left_anti"))
            if left.isEmpty():
                break
            waiting = below.join(left.withColumnRenamed("name", "low"), "low", "left_semi").select(F.col("high").alias("name")).distinct()
            seeds = settle(left.join(waiting, "name", "left_anti"))
            chosen = settle(chosen.union(seeds))
            left = left.join(seeds, "name", "left_anti")
        else:
            raise RuntimeError(f"seeds did not settle in {max_rounds} rounds")
        decided = dirty.join(chosen.withColumn("seed", F.lit(True)), "name", "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
        before = state.select("name", F.coalesce("seed", F.lit(False)).alias("was"))
        otherwise = decided.join(before, "name").filter("seed <> was").select(F.col("name").alias("low"))
        state = settle(others.unionByName(decided))
        dirty = settle(below.join(otherwise, "low", "left_semi").select(F.col("high").alias("name")).distinct().join(dirty, "name", "left_anti"))
    raise RuntimeError(f"seeds did not settle in {max_rounds} rounds")


def resolve_more(before: Resolution | None, claims: DataFrame, threshold: float = THRESHOLD, cut: float = THRESHOLD, require_surname: bool = False) -> Resolution:
    """What ``resolve`` would say of all claims so far, from what it said before and the new ones (``id``, ``subject_name``).

    Only pairs with a new name are made and scored. Names are new, or move if a
    new claim of theirs has a lower id; clusters are repaired from these. Claims
    may come in any order and more than once.
    """
    before = before or _no_resolution(claims.sparkSession)
    told = claims.filter(F.col("subject_name").isNotNull()).groupBy(F.col("subject_name").alias("name")).agg(F.min("id").alias("new_rank"))
    old = before.names.select("name", F.col("rank").alias("old_rank"), (F.col("seed") == F.col("name")).alias("was_seed"))
    names = settle(old.join(told, "name", "full").select("name", F.least("old_rank", "new_rank").alias("rank"), "old_rank", "was_seed"))
    fresh, moved = names.filter("old_rank is null"), names.filter("old_rank is not null and rank < old_rank").select("name")
    # ids of names for this run only; ranks move
    numbered = settle(numbered_by(names.select("name"), [F.col("name")]).withColumnRenamed("id", "rank"))
    features = settle(name_features(numbered))
    made = matching_pairs(features, cut, bare=not require_surname, fresh=numbered.join(fresh.select("name"), "name", "left_semi"))
    scored = score_pairs(made, features, features, threshold).filter((F.col("confidence") >= cut) & (F.col("confidence") > 0) & (F.col("rank_a") != F.col("rank_b")))
    edges = settle(before.edges.union(scored.select("name_a", "name_b")))
    near = edges.union(edges.select("name_b", "name_a")).toDF("name", "by").join(moved.withColumnRenamed("name", "by"), "by", "left_semi").select("name")
    seeds = settle(repair_seeds(names, edges, fresh.select("name").union(moved).union(near)))
    both = edges.union(edges.select("name_b", "name_a")).toDF("name", "by")
    joined = both.join(seeds.filter("is_seed").select(F.col("name").alias("by"), F.col("rank").alias("by_rank")), "by").groupBy("name").agg(F.min_by("by", "by_rank").alias("by"))
    out = seeds.join(joined, "name", "left").select("name", "rank", F.when(F.col("is_seed"), F.col("name")).otherwise(F.col("by")).alias("seed"))
    return Resolution(settle(out), edges)


def numbered_by(rows: DataFrame, order: list[Column], after: int = 0) -> DataFrame:
    """``rows`` with ``id``, their place in a total ``order`` counted on from ``after``: sorted in ranges, each numbered after the rows of those before it."""
    rows = settle(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    # one row per range
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.alias("x").join(sizes.alias("y"), F.col("y._part") < F.col("x._part"), "left").groupBy("x._part").agg(F.coalesce(F.sum("y._n"), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.join(F.broadcast(before), "_part").withColumn("id", (F.col("_before") + inside + after).cast("bigint")).drop("_part", "_before")


def generate(claims: DataFrame, threshold: float = THRESHOLD, cut: float = THRESHOLD, require_surname: bool = False) -> tuple[DataFrame, DataFrame]:
    """Claims and entities after resolving all subjects anew."""
    return materialise(claims, resolve(claims, threshold, cut, require_surname))


def materialise(claims: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New claims and entities: ids number the clusters by documents, then claims, then seed.

    Claims lose any earlier cluster and become clustered; an entity is verified
    if several documents speak of it. Registry ids on claims stay; claims
    without a subject stay too, unresolved.
    """
    seeds = settle(clusters.select(F.col("name").alias("_name"), "seed"))
    told = claims.drop("seed").join(small(seeds), F.col("subject_name") == F.col("_name")).drop("_name")
    given = entity_name_sets(told.filter(F.col("fact_type").isin("person_nickname", "maiden_name")), "seed")
    stats = settle(entity_stats(told, "seed").join(given, "seed", "left"))
    numbered = numbered_by(stats.select("seed", "source_count", "fact_count"), [F.desc("source_count"), F.desc("fact_count"), F.asc("seed")]).select("seed", "id")
    entities = stats.join(numbered, "seed").select(
        "id", "canonical_name", "name_variants", "nicknames", "maiden_names", F.lit(None).cast("string").alias("registry_person_id"),
        "confidence_score", F.col("source_count").cast("int").alias("source_count"), F.col("fact_count").cast("int").alias("fact_count"),
        F.when(F.col("source_count") > 1, "verified").otherwise("unverified").alias("entity_status"))
    # claims go to their entity by name, in one join
    ids = settle(seeds.join(numbered, "seed").select("_name", F.col("id").alias("entity_id")))
    new = claims.drop("entity_id").join(small(ids), F.col("subject_name") == F.col("_name"), "left").drop("_name").withColumn(
        "resolution_status", F.when(F.col("entity_id").isNotNull(), "clustered").otherwise("unresolved"))
    return new.select(*claims.columns) if "entity_id" in claims.columns else new, entities


def name_scores(names_a: DataFrame, names_b: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Only the confidence of each pair."""
    return match_names(names_a, names_b, pairs, threshold).select("rank_a", "rank_b", "confidence")


def matching_persons(target: DataFrame, candidates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``name`` and ``score`` (0-1) of the candidates that match the target, best first."""
    return potential_matches(target, candidates, threshold, threshold).select(F.col("name_b").alias("name"), F.col("confidence").alias("score"))
