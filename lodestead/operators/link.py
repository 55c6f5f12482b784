"""Linking entities to an external registry of people, given as snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import settle
from ..functions.names import partial_date, squeeze, tokens
from .analyze import first_per, linkage_features
from .resolve import name_features, score_pairs

NAME_POINTS, DEATH_POINTS, BIRTH_POINTS = 40, 30, 20
MATCHED, CANDIDATE, PER_VARIANT = 0.85, 0.5, 5


def _part(name: str) -> tuple[Column, Column]:
    """Given name and first surname of a person's name, empty where missing."""
    return (F.coalesce(F.col(f"{name}.given"), F.lit("")),
            F.coalesce(F.try_element_at(F.col(f"{name}.surnames"), F.lit(1)), F.lit("")))


def search_people(people: DataFrame, query: str | None = None, surname: str | None = None, given: str | None = None, limit: int = 10) -> DataFrame:
    """People whose primary name contains the texts whatever their case, in registry order."""
    g, s = (F.lower(c) for c in _part("primary_name"))
    found = people
    if given:
        found = found.filter(g.contains(given.lower()))
    if surname:
        found = found.filter(s.contains(surname.lower()))
    if query:
        found = found.filter(F.concat(g, F.lit(" "), s).contains(query.lower()))
    return found.orderBy("registry_id").limit(limit)


def get_person(people: DataFrame, identifier: str) -> DataFrame:
    return people.filter((F.col("registry_id") == identifier) | (F.col("handle") == identifier))


def person_events(people: DataFrame, events: DataFrame) -> DataFrame:
    """``registry_id``, ``pos``, ``type``, ``dateval``, ``place``: events in a person's order; unknown references are skipped."""
    refs = people.select("registry_id", F.posexplode("event_refs").alias("pos", "handle"))
    return refs.join(events, "handle").select("registry_id", "pos", "type", "dateval", "place")


def person_families(people: DataFrame, families: DataFrame) -> DataFrame:
    """``registry_id``, ``as_parent`` and ``as_child``: sorted family ids."""
    def of(column: str, name: str) -> DataFrame:
        rows = families.select("registry_id", F.explode(column).alias("handle")).withColumnRenamed("registry_id", "family")
        return rows.groupBy("handle").agg(F.array_sort(F.collect_set("family")).alias(name))

    none = F.array().cast("array<string>")
    return people.select("registry_id", "handle").join(of("parents", "as_parent"), "handle", "left").join(of("children", "as_child"), "handle", "left").select(
        "registry_id", F.coalesce("as_parent", none).alias("as_parent"), F.coalesce("as_child", none).alias("as_child"))


def person_names(people: DataFrame) -> DataFrame:
    """``registry_id``, ``pos``, ``full``: the primary name, then the alternate ones."""
    every = F.concat(F.array("primary_name"), F.coalesce("alternate_names", F.expr("array()").cast("array<struct<given:string,surnames:array<string>>>")))
    x = people.select("registry_id", F.posexplode(every).alias("pos", "name"))
    g, s = _part("name")
    return x.select("registry_id", "pos", F.trim(F.concat(g, F.lit(" "), s)).alias("full"))


def person_facts(people: DataFrame, events: DataFrame) -> DataFrame:
    """``registry_id``, ``gender``, birth and death date and place: the last event that has one wins, even if its date formats to null."""
    e = person_events(people, events).withColumn("kind", F.lower("type"))
    has_date, has_place = F.coalesce(F.size("dateval") > 0, F.lit(False)), F.coalesce(F.col("place") != "", F.lit(False))

    def last(kind: str, value: Column, has: Column) -> Column:
        when = F.when((F.col("kind") == kind) & has, F.col("pos"))
        return F.max_by(F.struct(value.alias("v")), when)["v"]

    date = partial_date(F.col("dateval"))
    facts = e.groupBy("registry_id").agg(
        last("birth", date, has_date).alias("birth_date"), last("birth", F.col("place"), has_place).alias("birth_place"),
        last("death", date, has_date).alias("death_date"), last("death", F.col("place"), has_place).alias("death_place"))
    return people.select("registry_id", "gender").join(facts, "registry_id", "left")


def best_names(variants: DataFrame, names: DataFrame, pairs: DataFrame) -> DataFrame:
    """The best name pair of each (``entity_id``, ``registry_id``) of ``pairs``.

    ``variants``: ``entity_id``, ``v_pos``, ``variant``; ``names``: ``registry_id``,
    ``pos``, ``full``. Of equals the first variant, then the first name.
    """
    ours = variants.select(F.col("variant").alias("name")).distinct().withColumn("rank", F.xxhash64("name"))
    theirs = names.select(F.col("full").alias("name")).distinct().withColumn("rank", F.xxhash64("name"))
    # people of one name are compared once, and only what scored meets an entity's variants again
    named = pairs.join(names, "registry_id").select("entity_id", "registry_id", "pos", F.xxhash64("full").alias("rank_b"))
    asked = settle(named.select("entity_id", "rank_b").distinct())
    held = variants.select("entity_id", "v_pos", F.xxhash64("variant").alias("rank_a"))
    compared = asked.join(held, "entity_id").select("rank_a", "rank_b").distinct()
    scored = settle(score_pairs(compared, name_features(ours), name_features(theirs)).filter("confidence > 0").select("rank_a", "rank_b", "confidence", "method"))
    told = first_per(asked.join(scored, "rank_b").join(held, ["entity_id", "rank_a"]), ["entity_id", "rank_b"], [F.desc("confidence"), "v_pos"])
    best = first_per(named.join(told, ["entity_id", "rank_b"]), ["entity_id", "registry_id"], [F.desc("confidence"), "v_pos", "pos"])
    return pairs.join(best.select("entity_id", "registry_id", F.col("confidence").alias("name_score"), F.col("method").alias("name_method")),
                      ["entity_id", "registry_id"], "left").select(
        "entity_id", "registry_id", F.coalesce("name_score", F.lit(0.0)).alias("name_score"), F.coalesce("name_method", F.lit("none")).alias("name_method"))


def linkage_scores(scored: DataFrame) -> DataFrame:
    """Adds ``confidence``, ``reasons``, ``conflicts`` to rows with ``name_score``, ``name_method`` and either side's dates.

    A date counts if either side has it; it scores only if both are the same
    text. The confidence is rounded half up to hundredths.
    """
    def has(c: str) -> Column:
        return F.coalesce(F.col(c) != "", F.lit(False))

    points, most, reasons, conflicts = F.col("name_score") * NAME_POINTS, F.lit(NAME_POINTS), [], []
    reasons.append(F.when(F.col("name_score") > MATCHED, F.concat(F.lit("name: "), F.col("name_method"))))
    for kind, worth in (("death", DEATH_POINTS), ("birth", BIRTH_POINTS)):
        ours, theirs = has(f"{kind}_date"), has(f"registry_{kind}_date")
        same = ours & theirs & (F.col(f"{kind}_date") == F.col(f"registry_{kind}_date"))
        points = points + F.when(same, worth).otherwise(0)
        most = most + F.when(ours | theirs, worth).otherwise(0)
        reasons.append(F.when(same, f"{kind} date equal").when(ours & ~theirs, f"{kind} date new to the registry"))
        conflicts.append(F.when(ours & theirs & ~same, F.concat(
            F.lit(f"{kind} date: claimed "), F.col(f"{kind}_date"), F.lit(", registry "), F.col(f"registry_{kind}_date"))))
    confidence = F.floor(points / most * 100 + 0.5) / 100
    return scored.withColumn("confidence", confidence.cast("double")).withColumn(
        "reasons", F.array_compact(F.array(*reasons))).withColumn("conflicts", F.array_compact(F.array(*conflicts)))


def _grams(c: str) -> Column:
    """The different pieces of one to three letters of a text."""
    return F.expr(f"array_distinct(flatten(transform(sequence(1, 3), k -> if(length({c}) >= k, transform(sequence(1, length({c}) - k + 1), i -> substring({c}, i, k)), array()))))")


def containing(texts: DataFrame, known: DataFrame) -> DataFrame:
    """``texts`` (``given``, ``surname``) with each row of ``known`` (``g``, ``s``) whose texts contain both.

    What contains a surname contains its pieces, so an asked one meets the
    different surnames that hold its rarest piece of three letters (or itself,
    if shorter) by an equi-join, and is verified there.
    """
    held = known.select("s").distinct().withColumn("gram", F.explode(_grams("s")))
    often = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    asked = texts.filter("surname <> ''").withColumn("gram", F.explode(F.filter(_grams("surname"), lambda x: F.length(x) == F.least(F.lit(3), F.length("surname")))))
    rarest = asked.join(often, "gram").groupBy("given", "surname").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    surnames = rarest.join(held, "gram").filter(F.col("s").contains(F.col("surname"))).select("given", "surname", "s")
    return surnames.join(known, "s").filter(F.col("g").contains(F.col("given")))


def search_many(people: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """``query_id``, ``registry_id``, ``place``: for each query (``query``, ``surname``, ``given``) the first ``limit`` people that ``search_people`` finds.

    A null or empty text asks nothing; a query that asks nothing finds everyone.
    Queries of the same texts are searched once, and people of the same name are
    met once: the first ``limit`` of each name hold the first of every query, so
    what meets is as large as the different queries and names, not as all people
    that answer. Texts are met by an index of the different given names, surnames
    and full names by their pieces of one to three letters: a query goes by the
    rarest piece of three letters (or a whole shorter text) in what it asks, and
    is verified on what holds it.
    """
    g, s = (F.lower(c) for c in _part("primary_name"))
    every = ["query", "surname", "given"]
    asked = queries.select("query_id", *[F.nullif(F.lower(c), F.lit("")).alias(c) for c in every])
    nothing = F.coalesce(*every).isNull()
    asks = settle(asked.filter(~nothing).select(*every).distinct().withColumn("ask", F.to_json(F.struct(*every))))
    firsts = settle(_first_of_names(people.select("registry_id", g.alias("given"), s.alias("surname")), ["given", "surname"], limit))
    names = firsts.select("given", "surname").distinct().withColumn("query", F.concat("given", F.lit(" "), "surname"))
    texts = names.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in every])).alias("x")).select("x.*").distinct()
    held = texts.withColumn("gram", F.explode(_grams("text")))
    often = held.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n"))
    parts = asks.select("ask", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("wanted")) for c in every])).alias("x")).select("ask", "x.*").filter("wanted is not null")
    grams = parts.withColumn("gram", F.explode(F.filter(_grams("wanted"), lambda x: F.length(x) == F.least(F.lit(3), F.length("wanted")))))
    # a piece that no text holds counts as the rarest, and finds nothing
    rarest = grams.join(often, ["field", "gram"], "left").groupBy("ask").agg(F.min_by(F.struct("field", "gram", "wanted"), F.struct(F.coalesce("n", F.lit(0)), "field", "gram")).alias("r")).select("ask", "r.*")
    held_by = rarest.join(held, ["field", "gram"]).filter(F.col("text").contains(F.col("wanted"))).select("ask", "field", "text")
    theirs = names.select(*[F.col(c).alias(f"their_{c}") for c in every])
    where = theirs.select("*", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"their_{c}").alias("text")) for c in every])).alias("x")).select(*theirs.columns, "x.*")
    met = held_by.join(where, ["field", "text"]).join(asks, "ask")
    for c in every:
        met = met.filter(F.col(c).isNull() | F.col(f"their_{c}").contains(F.col(c)))
    hits = met.select("ask", F.col("their_given").alias("given"), F.col("their_surname").alias("surname")).join(firsts, ["given", "surname"])
    found = _first_of_names(hits, ["ask"], limit).select("ask", "registry_id", "place")
    told = asked.filter(~nothing).select("query_id", F.to_json(F.struct(*every)).alias("ask")).join(found, "ask")
    first = people.select("registry_id").orderBy("registry_id").limit(limit)  # ``limit`` rows
    open_ = asked.filter(nothing).select("query_id").crossJoin(F.broadcast(first.withColumn("place", F.row_number().over(Window.orderBy("registry_id")))))
    return told.select("query_id", "registry_id", "place").union(open_.select("query_id", "registry_id", "place"))


def _first_of_names(rows: DataFrame, key: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each ``key`` by ``registry_id`` with their ``place``; those beyond it go within each task before any move."""
    first = Window.partitionBy(*key).orderBy("registry_id")
    return rows.drop("place").withColumn("place", F.row_number().over(first)).filter(F.col("place") <= limit)


def find_matches(entities: DataFrame, claims: DataFrame, people: DataFrame, events: DataFrame,
                 keep: float = CANDIDATE, per_variant: int = PER_VARIANT) -> DataFrame:
    """Registry candidates of each entity above ``keep``, best first.

    A variant of two tokens or more proposes the first ``per_variant`` people, by
    registry id, whose given name contains all but its last token and whose
    surname contains the last.
    """
    variants = entities.select(F.col("id").alias("entity_id"), F.posexplode("name_variants").alias("v_pos", "variant"))
    t = tokens(F.col("variant"))
    asked = variants.filter(F.size(t) >= 2).select(
        "entity_id", "v_pos", F.lower(F.element_at(t, -1)).alias("surname"), F.lower(F.array_join(F.slice(t, 1, F.size(t) - 1), " ")).alias("given"))
    g, s = (F.lower(c) for c in _part("primary_name"))
    # the first of each name hold the first of every question
    firsts = settle(_first_of_names(people.select("registry_id", g.alias("g"), s.alias("s")), ["g", "s"], per_variant))
    hits = _first_of_names(containing(asked.select("given", "surname").distinct(), firsts), ["given", "surname"], per_variant)
    pairs = asked.join(hits, ["given", "surname"]).select("entity_id", "registry_id").distinct()
    best = best_names(variants, person_names(people), pairs)
    facts = person_facts(people, events).select(
        "registry_id", F.col("death_date").alias("registry_death_date"), F.col("birth_date").alias("registry_birth_date"))
    features = linkage_features(claims).select("entity_id", "death_date", "birth_date")
    scored = linkage_scores(best.join(facts, "registry_id").join(features, "entity_id", "left")).filter(F.col("confidence") > keep)
    first = person_names(people).filter("pos = 0").select("registry_id", F.coalesce(F.nullif(squeeze(F.col("full")), F.lit("")), F.lit("Unknown")).alias("registry_name"))
    return scored.join(first, "registry_id", "left").orderBy("entity_id", F.desc("confidence"), "registry_id")
