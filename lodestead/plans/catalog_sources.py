"""More registered queries: sources, settings, prompts, nicknames, registry pages and searches, each over given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..checkpoints import ensure_checkpoint_dir, settle
from ..functions import names as N
from ..operators import analyze as A
from ..operators import cite as K
from ..operators import extract as L
from ..operators import link as R
from ..operators import resolve as C
from ..sources import adapters as T
from ..sources import delivery as Y
from ..sources import registry as J
from ..sources import store as S
from .catalog import CI, CL, DO, ME, _FEATURES, _LADDER, _PEOPLE, _WANTED, _nickname_values, _own_entities, _planned, _registry_sources, _store, query


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""WITH {_PEOPLE}, f AS (SELECT 'F' || CAST(c_custkey AS VARCHAR) AS family, c_custkey AS k FROM customer),
  p AS (SELECT family, k AS handle FROM f UNION ALL SELECT family, 2 * k FROM f), c AS (SELECT family, 3 * k AS handle FROM f),
  a AS (SELECT handle, string_agg(DISTINCT family, ',' ORDER BY family) AS fs FROM p GROUP BY 1), b AS (SELECT handle, string_agg(DISTINCT family, ',' ORDER BY family) AS fs FROM c GROUP BY 1)
  SELECT registry_id, coalesce(a.fs, '') AS as_parent, coalesce(b.fs, '') AS as_child FROM people LEFT JOIN a ON a.handle = p_partkey LEFT JOIN b ON b.handle = p_partkey""")
def registry_families(spark, d):
    """The families of each person, as parent and as child."""
    k = F.col("c_custkey")
    families = T.table(spark, d, "customer").select(
        F.concat(F.lit("F"), k.cast("string")).alias("registry_id"), F.concat(F.lit("f"), k.cast("string")).alias("handle"),
        F.array(k.cast("string"), (2 * k).cast("string")).alias("parents"), F.array((3 * k).cast("string")).alias("children"))
    return R.person_families(T.people(spark, d), families).select("registry_id", F.array_join("as_parent", ",").alias("as_parent"), F.array_join("as_child", ",").alias("as_child"))


@query(f"WITH {_PEOPLE} SELECT registry_id, given, surname, CAST(p_partkey AS VARCHAR) AS handle FROM people WHERE registry_id = 'I000000007' OR p_partkey IN (7, 12)")
def registry_person(spark, d):
    """People by registry id, and by handle."""
    people = T.people(spark, d)
    found = R.get_person(people, "I000000007").union(R.get_person(people, "12"))
    return found.select("registry_id", F.col("primary_name.given").alias("given"), F.element_at("primary_name.surnames", 1).alias("surname"), "handle")


@query("SELECT page_id, sha256(html || chr(10)) AS digest FROM pages")
def text_files(spark, d):
    """Pages written as one text file each, read back whole.

    A file's first line is the page's id, the rest its text (none at all for a
    null one). Each task fills one folder and moves its files there itself, so
    the driver neither makes nor looks for a folder a page.
    """
    path, tasks = _folder(spark, "texts"), 4 * spark.sparkContext.defaultParallelism
    line = F.concat_ws("\n", F.col("page_id").cast("string"), "html")
    T.table(spark, d, "pages").repartition(tasks, "page_id").select(F.spark_partition_id().alias("folder"), line.alias("value")).write.option("maxRecordsPerFile", 1).option(
        "mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("folder").text(path)
    rest = F.expr("substring(text, locate('\n', text) + 1)")
    return S.read_texts(spark, f"{path}/*").select(F.substring_index("text", "\n", 1).cast("bigint").alias("page_id"), F.when(rest != "", F.sha2(rest, 256)).alias("digest"))


@query(f"""{CL} SELECT 'documents' AS "table", (SELECT COUNT(*) FROM orders) AS removed UNION ALL SELECT 'memo', 0 UNION ALL SELECT 'claims', (SELECT COUNT(*) FROM claims)
  UNION ALL SELECT 'entities', (SELECT COUNT(*) FROM supplier)""")
def reset_counts(spark, d):
    """What emptying a store removes."""
    store = _store(spark, documents=T.documents(spark, d), claims=T.claims(spark, d), entities=_own_entities(spark, d))
    return store.reset()


@query(f"""{CL} SELECT entity_id, CAST(to_json(list_sort(list(DISTINCT subject_name))) AS VARCHAR) AS variants FROM claims GROUP BY 1""")
def variants_as_json(spark, d):
    return A.entity_stats(T.claims(spark, d)).select("entity_id", S.json_list(F.col("name_variants")).alias("variants"))


@query(f"""WITH {CI}, {DO} SELECT id, strftime(created_timestamp, '%Y-%m-%d %H:%M:%S.%f') AS at FROM citations_of UNION ALL SELECT -id, strftime(fetch_timestamp, '%Y-%m-%d %H:%M:%S.%f') FROM documents_of""")
def stored_times(spark, d):
    """Times of citations, and below zero of documents, as they come back from the store."""
    store = _store(spark, citations=T.citations(spark, d), documents=T.documents(spark, d))
    at = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return store.read("citations").select("id", F.date_format("created_timestamp", at).alias("at")).union(
        store.read("documents").select(-F.col("id"), F.date_format("fetch_timestamp", at)))


@query(r"""SELECT conv_id, turn, sha256('People:' || chr(10) || '- ' || role || ' (other)' || chr(10) || '- turn ' || CAST(turn AS VARCHAR) || ' (child)' || chr(10) || 'Text: ' || text) AS digest FROM conversations""")
def rendered_prompts(spark, d):
    c = T.table(spark, d, "conversations")
    people = F.array(F.struct(F.col("role").alias("full_name"), F.lit("other").alias("role")), F.struct(F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("full_name"), F.lit("child").alias("role")))
    return c.select("conv_id", "turn", F.sha2(L.render_prompt("People:\n{people}\nText: {text}", F.col("text"), people), 256).alias("digest"))


@query(r"""SELECT conv_id, turn, sha256(CASE turn % 3 WHEN 2 THEN '' ELSE text END) AS digest FROM conversations""")
def cleaned_answers(spark, d):
    """Answers in fences, between blanks, and of a fence alone."""
    k, text = F.pmod("turn", F.lit(3)), F.col("text")
    c = T.table(spark, d, "conversations")
    answer = F.when(k == 0, F.concat(F.lit(" \n```json\n"), text, F.lit("\n``` \n"))).when(k == 1, F.concat(F.lit(" \t\n"), text, F.lit("  \n"))).otherwise("```\n```")
    return c.select("conv_id", "turn", F.sha2(L.clean_response(answer), 256).alias("digest"))


@query(f"""WITH {ME}, k AS (SELECT document_id, fact_type, subject_name, fact_value, related_name, relationship_type FROM mentions WHERE id % 3 = 0)
  SELECT id, document_id, fact_type, subject_name, fact_value FROM mentions m WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.document_id = m.document_id AND k.fact_type = m.fact_type
    AND k.subject_name = m.subject_name AND k.fact_value = m.fact_value AND k.related_name IS NOT DISTINCT FROM m.related_name AND k.relationship_type = m.relationship_type)""")
def appended_claims(spark, d):
    """The mentions that a claim table of every third of them lacks."""
    m = T.mentions(spark, d)
    return L.append_claims(m.filter("id % 3 = 0"), m).select("id", "document_id", "fact_type", "subject_name", "fact_value")


@query("SELECT DISTINCT split_part(p_name, ' ', 1) AS formal, split_part(p_name, ' ', -1) AS alias FROM part")
def nickname_source(spark, d):
    """A nickname file written from the words of part names, read back as pairs."""
    words = T.table(spark, d, "part").select(F.substring_index("p_name", " ", 1).alias("f"), F.substring_index("p_name", " ", -1).alias("a"))
    path = _folder(spark, "nicknames")
    lists = words.groupBy("f").agg(F.array_sort(F.collect_set("a")).alias("a"))
    lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("f", "a")))).alias("value")).write.text(path)
    return S.read_nicknames(spark, f"{path}/*.txt")


_GIVEN = f"""n(formal, alias) AS (VALUES {_nickname_values()}), g AS (SELECT formal AS name FROM n UNION SELECT alias FROM n),
  given AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS k, (SELECT COUNT(*) FROM g) AS size FROM g),
  who AS (SELECT DISTINCT name, c_mktsegment AS surname FROM customer JOIN given ON c_custkey % size = k)"""


def _given_names(spark, d):
    """The names of the nickname list dealt over customers, with their segments as surnames."""
    names = sorted({n for f, short in N.NICKNAMES.items() for n in (f, *short)})
    given = F.element_at(F.array(*map(F.lit, names)), (F.pmod("c_custkey", F.lit(len(names))) + 1).cast("int"))
    return T.table(spark, d, "customer").select(given.alias("name"), F.col("c_mktsegment").alias("surname")).distinct()


@query(f"""WITH {_GIVEN}, t AS (SELECT formal AS g, formal AS name FROM n UNION SELECT formal, alias FROM n)
  SELECT DISTINCT a.surname, a.name AS name_a, b.name AS name_b FROM who a JOIN who b ON a.surname = b.surname AND a.name < b.name JOIN t x ON x.name = a.name JOIN t y ON y.name = b.name AND x.g = y.g""")
def nickname_tests(spark, d):
    """Customers of one segment whose given names are nicknames of each other."""
    x = _given_names(spark, d).withColumn("g", F.explode(N.nickname_groups(F.col("name"))))
    return x.select("surname", F.col("name").alias("name_a"), "g").join(x.select("surname", F.col("name").alias("name_b"), "g"), ["surname", "g"]).filter(
        "name_a < name_b").select("surname", "name_a", "name_b").distinct()


@query(f"""WITH {_GIVEN}, t AS (SELECT formal AS g, formal AS name FROM n UNION SELECT formal, alias FROM n),
  nick AS (SELECT DISTINCT x.name AS a, y.name AS b FROM t x JOIN t y ON x.g = y.g),
  full_names AS (SELECT name || ' ' || surname AS name, name AS given, surname FROM who)
  SELECT least(x.name, y.name) AS name_a, greatest(x.name, y.name) AS name_b, CAST(95 AS INTEGER) AS score, 'known_nickname' AS method, 0.95::DOUBLE AS confidence
  FROM full_names x JOIN full_names y ON x.surname = y.surname AND x.name < y.name JOIN nick ON a = x.given AND b = y.given
  UNION ALL SELECT least(x.name, y.name), greatest(x.name, y.name), 95, 'known_nickname', 0.95 FROM (SELECT DISTINCT name FROM who) x JOIN full_names y ON TRUE JOIN nick ON a = x.name AND b = y.given""")
def nickname_ladder(spark, d):
    """The third rung over full names, and over given names alone, from the pairs that blocking makes of customers."""
    who = _given_names(spark, d)
    names = who.select(F.concat_ws(" ", "name", "surname").alias("name")).union(who.select("name")).distinct().withColumn("rank", F.xxhash64("name"))
    f = C.settle(C.name_features(names))
    scored = C.score_pairs(C.matching_pairs(f, 0.95), f, f).filter("method = 'known_nickname'")
    one, two = F.split("name_a", " "), F.split("name_b", " ")
    # two given names alone also match; the pairs asked for have a full name at least on one side
    return scored.filter((F.size(one) > 1) | (F.size(two) > 1)).select(
        F.least("name_a", "name_b").alias("name_a"), F.greatest("name_a", "name_b").alias("name_b"), "score", "method", "confidence")


@query("""SELECT 'nation_' || CAST(n_nationkey AS VARCHAR) AS setting_key, CASE WHEN n_nationkey % 4 = 0 THEN CAST(n_regionkey AS BIGINT) END AS as_integer,
  CASE WHEN n_nationkey % 4 = 1 THEN n_regionkey + 0.5 END::DOUBLE AS as_float, CASE WHEN n_nationkey % 4 = 2 THEN n_regionkey % 2 = 0 END AS as_boolean,
  CASE WHEN n_nationkey % 4 = 3 THEN n_name END AS as_text FROM nation""")
def stored_settings(spark, d):
    """Settings written from nations to the store, each read back in its type."""
    k, r = F.pmod("n_nationkey", F.lit(4)), F.col("n_regionkey")
    value = F.when(k == 0, r.cast("string")).when(k == 1, F.concat(r.cast("string"), F.lit(".5"))).when(k == 2, F.when(r % 2 == 0, "Yes").otherwise("off")).otherwise(F.col("n_name"))
    kind = F.element_at(F.array(*map(F.lit, ("integer", "float", "boolean", "string"))), (k + 1).cast("int"))
    rows = T.table(spark, d, "nation").select(F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("setting_key"), value.alias("setting_value"), kind.alias("setting_type"))
    return S.typed_settings(_store(spark, settings=rows).read("settings")).select("setting_key", "as_integer", "as_float", "as_boolean", "as_text")


@query(f"""WITH names AS (SELECT DISTINCT p_name AS name, CAST('0x' || substr(md5(p_name), 1, 12) AS BIGINT) AS rank FROM part), {_FEATURES},
  pairs AS (SELECT DISTINCT CAST('0x' || substr(md5(a.p_name), 1, 12) AS BIGINT) AS rank_a, CAST('0x' || substr(md5(b.p_name), 1, 12) AS BIGINT) AS rank_b
    FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1), {_LADDER} SELECT name_a, name_b, score, method, confidence, confidence >= 0.85 AS is_match FROM scored""")
def part_name_tests(spark, d):
    """What the names of each part and the next say of each other."""
    rank = F.conv(F.substring(F.md5("name"), 1, 12), 16, 10).cast("bigint")
    p = T.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name")).withColumn("rank", rank)
    names = p.select("name", "rank").distinct()
    pairs = p.select("p_partkey", F.col("rank").alias("rank_a")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("rank").alias("rank_b")), "p_partkey").select("rank_a", "rank_b").distinct()
    return C.match_names(names, names, pairs).select("name_a", "name_b", "score", "method", "confidence", (F.col("confidence") >= C.THRESHOLD).alias("is_match"))


_TOLD = """t AS (SELECT p_partkey AS document_id, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] AS g, upper(split_part(p_name, ' ', -1)[1]) || split_part(p_name, ' ', -1)[2:] AS s,
  CAST(5 + p_partkey % 90 AS VARCHAR) AS a, CAST(1 + p_partkey % 60 AS VARCHAR) AS y, 'May ' || CAST(1 + p_partkey % 28 AS VARCHAR) || ', ' || CAST(1950 + p_partkey % 50 AS VARCHAR) AS died FROM part)"""


@query(f"""WITH {_TOLD} SELECT document_id, g AS full_name, 'spouse_given' AS kind, s AS value FROM t UNION ALL SELECT document_id, g, 'surname', 'Mills' FROM t
  UNION ALL SELECT document_id, g, 'nickname', 'Bee' FROM t UNION ALL SELECT document_id, 'Lena', 'maiden_name', s FROM t UNION ALL SELECT document_id, g || ' ' || s, 'deceased', NULL FROM t
  UNION ALL SELECT document_id, 'Kit', 'age', a FROM t UNION ALL SELECT document_id, NULL, 'death_age', a FROM t UNION ALL SELECT document_id, NULL, 'death_date', died FROM t
  UNION ALL SELECT document_id, NULL, 'marriage_years', y FROM t UNION ALL SELECT document_id, g, 'shared_surname', s FROM t""")
def notation_kinds(spark, d):
    """All ten things that the notation says, of a text made of each part."""
    k = F.col("p_partkey")
    g, s = F.initcap(F.substring_index("p_name", " ", 1)), F.initcap(F.substring_index("p_name", " ", -1))
    age = (5 + k % 90).cast("string")
    text = F.concat(g, F.lit(" ("), s, F.lit(") Mills met "), g, F.lit(' "Bee" and Lena (nee '), s, F.lit(") with the late "), g, F.lit(" "), s, F.lit("; Kit ("), age, F.lit(") said "), g, F.lit(" and Ann "), s,
                    F.lit(" were wed for "), (1 + k % 60).cast("string"), F.lit(" years; at the age of "), age, F.lit(" one died on May "), (1 + k % 28).cast("string"), F.lit(", "), (1950 + k % 50).cast("string"), F.lit("."))
    parts = T.dealt(T.table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    return L.read_notation(parts.select(k.alias("id"), text.alias("extracted_text"))).select("document_id", "full_name", "kind", "value")


def _pages(spark, d):
    """Registry pages of a hundred people, events or families written as JSON, lists and objects by turns, and one page that is cut off."""
    p, c = T.table(spark, d, "part"), T.table(spark, d, "customer")
    k, key = F.col("p_partkey"), F.col("c_custkey")
    name = F.struct(F.initcap(F.substring_index("p_name", " ", 1)).alias("first_name"), F.array(F.struct(F.initcap(F.substring_index("p_name", " ", -1)).alias("surname"))).alias("surname_list"))
    refs = F.array(*[F.struct(F.concat(F.lit("e"), x.cast("string")).alias("ref")) for x in (k, 3 * k)])
    people = p.select(F.floor(k / 100).alias("page"), F.to_json(F.struct(F.concat(F.lit("I"), F.lpad(k.cast("string"), 9, "0")).alias("gramps_id"), k.cast("string").alias("handle"), F.lit(1).alias("gender"), name.alias("primary_name"), refs.alias("event_ref_list"))).alias("record"))
    e = T.registry_events(spark, d)
    events = e.select(F.floor(F.substring("handle", 2, 20).cast("bigint") / 100).alias("page"), F.to_json(F.struct("handle", F.struct(F.col("type").alias("string")).alias("type"), F.struct("dateval").alias("date"), "place")).alias("record"))
    families = c.select(F.floor(key / 100).alias("page"), F.to_json(F.struct(F.concat(F.lit("F"), key.cast("string")).alias("gramps_id"), key.cast("string").alias("father_handle"), F.array(F.struct((key + 1).cast("string").alias("ref"))).alias("child_ref_list"))).alias("record"))
    path = _folder(spark, "registry")
    rows = people.withColumn("of", F.lit("people")).unionByName(events.withColumn("of", F.lit("events"))).unionByName(families.withColumn("of", F.lit("families")))
    listed = rows.groupBy("of", "page").agg(F.concat(F.lit("["), F.array_join(F.collect_list("record"), ","), F.lit("]")).alias("list"))
    text = F.when(F.col("page") % 2 == 0, F.col("list")).otherwise(F.concat(F.lit('{"data": '), F.col("list"), F.lit("}")))
    cut = listed.filter("of = 'people' and page = 0").select("of", F.lit(-1).cast("bigint").alias("page"), F.expr("substring(list, 1, length(list) - 2)").alias("value"))
    listed.select("of", "page", text.alias("value")).unionByName(cut).repartition("of", "page").write.partitionBy("of", "page").text(path)
    return J.read_registry(spark, path)


@query(f"WITH {_PEOPLE} SELECT registry_id, CAST(p_partkey AS VARCHAR) AS handle, given, surname, 'e' || CAST(p_partkey AS VARCHAR) || ',e' || CAST(p_partkey * 3 AS VARCHAR) AS events FROM people")
def registry_page_people(spark, d):
    """People read from pages of JSON."""
    return _pages(spark, d).people.select("registry_id", "handle", F.col("primary_name.given").alias("given"), F.element_at("primary_name.surnames", 1).alias("surname"), F.array_join("event_refs", ",").alias("events"))


@query("""SELECT 'e' || CAST(c_custkey AS VARCHAR) AS handle, CASE WHEN c_custkey % 2 = 0 THEN 'Birth' ELSE 'Death' END AS type, c_mktsegment AS place,
  concat_ws(',', c_custkey % 29, c_custkey % 13, CASE WHEN c_custkey % 11 > 0 THEN 1900 + c_custkey % 100 ELSE 0 END) AS dateval FROM customer""")
def registry_page_events(spark, d):
    """Events read from pages of JSON."""
    return _pages(spark, d).events.select("handle", "type", "place", F.array_join(F.transform("dateval", lambda x: x.cast("string")), ",").alias("dateval"))


@query("""SELECT 'F' || CAST(c_custkey AS VARCHAR) AS registry_id, CAST(c_custkey AS VARCHAR) AS parents, CAST(c_custkey + 1 AS VARCHAR) AS children FROM customer""")
def registry_page_families(spark, d):
    """Families read from pages of JSON."""
    return _pages(spark, d).families.select("registry_id", F.array_join("parents", ",").alias("parents"), F.array_join("children", ",").alias("children"))


_ASKED = f"""{_PEOPLE}, q AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 5 = 0 THEN lower(given[-2:] || ' ' || surname[:p_partkey % 3]) END AS query,
    CASE WHEN p_partkey % 5 <> 0 THEN upper(surname[1 + p_partkey % 2:2 + p_partkey % 3]) END AS surname, CASE WHEN p_partkey % 4 = 0 THEN given[:1 + p_partkey % 2] WHEN p_partkey % 4 = 1 THEN '' END AS given FROM people),
  hits AS (SELECT query_id, registry_id, row_number() OVER (PARTITION BY query_id ORDER BY registry_id) AS place FROM q JOIN people p
    ON (query IS NULL OR contains(lower(p.given || ' ' || p.surname), query)) AND (q.surname IS NULL OR contains(lower(p.surname), lower(q.surname))) AND (q.given IS NULL OR contains(lower(p.given), lower(q.given))))"""


@query(f"WITH {_ASKED} SELECT query_id, registry_id, CAST(place AS INTEGER) AS place FROM hits WHERE place <= 4")
def registry_searches(spark, d):
    """A search of the registry for each part, by surname, given name or both as written, all at once."""
    people, k = T.people(spark, d), F.col("handle").cast("bigint")
    given, surname = F.col("primary_name.given"), F.element_at("primary_name.surnames", 1)
    asked = people.select(
        k.alias("query_id"), F.when(k % 5 == 0, F.lower(F.concat(F.substring(given, -2, 2), F.lit(" "), F.expr("substring(element_at(primary_name.surnames, 1), 1, cast(handle as int) % 3)")))).alias("query"),
        F.when(k % 5 != 0, F.upper(F.expr("substring(element_at(primary_name.surnames, 1), 1 + cast(handle as int) % 2, 2 + cast(handle as int) % 3 - cast(handle as int) % 2)"))).alias("surname"),
        F.when(k % 4 == 0, F.expr("substring(primary_name.given, 1, 1 + cast(handle as int) % 2)")).when(k % 4 == 1, "").alias("given"))
    return R.search_many(people, asked, 4)


@query(f"""WITH {_WANTED}, known AS (SELECT url, arg_min(CAST(page_id AS VARCHAR), 'S' || CAST(page_id AS VARCHAR)) AS handle FROM pages WHERE page_id % 2 = 0 GROUP BY url),
  n AS (SELECT DISTINCT registry_person_id, document_id, url FROM w ANTI JOIN c USING (registry_person_id, document_id) LEFT JOIN pages ON document_id = page_id),
  made AS (SELECT DISTINCT n.url, 'source-' || sha256('source|' || coalesce(n.url, ''))[:24] AS handle FROM n LEFT JOIN known ON n.url = known.url WHERE known.url IS NULL),
  cited AS (SELECT n.*, 'citation-' || sha256('citation|' || registry_person_id || '|' || CAST(document_id AS VARCHAR))[:24] AS handle, coalesce(known.handle, made.handle) AS refers_to
    FROM n LEFT JOIN known ON n.url = known.url LEFT JOIN made ON n.url IS NOT DISTINCT FROM made.url)
  SELECT 'source' AS kind, url, NULL AS registry_person_id, NULL AS document_id, handle, NULL AS refers_to FROM made
  UNION ALL SELECT 'citation', url, registry_person_id, document_id, handle, refers_to FROM cited
  UNION ALL SELECT 'attach', url, registry_person_id, document_id, 'attach-' || sha256('attach|' || registry_person_id || '|' || CAST(document_id AS VARCHAR))[:24], handle FROM cited""")
def delivered_writes(spark, d):
    """The outbox of all wanted citations, sent by a run that knows half of it and again by one that knows the whole."""
    folder, sources = _folder(spark, "sent"), _registry_sources(spark, d)
    # planned once: both runs read it for each kind
    outbox = settle(_planned(spark, d)[2].withColumn("key", K.write_key()))
    Y.deliver(outbox.filter("document_id % 3 = 0"), folder, sources)
    sent = Y.deliver(outbox, folder, sources)
    return sent.select("kind", "url", "registry_person_id", F.when(F.col("kind") != "source", F.col("document_id")).alias("document_id"), "handle", "refers_to")
