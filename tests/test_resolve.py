"""Star clusters against the sequential model, blocking against all pairs, and what is made of clusters."""

import itertools
import random

import pytest

from lodestead.operators import analyze as A
from lodestead.operators import cite as K
from lodestead.operators import extract as L
from lodestead.operators import link as R
from lodestead.operators import resolve as C
from lodestead.sources.store import Store, default_settings, typed_settings


def _sequential(n, edges):
    near = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    seed = {}
    for i in range(n):
        if i not in seed:
            seed[i] = i
            for j in range(n):
                if j not in seed and (i, j) in near:
                    seed[j] = i
    return seed


@pytest.mark.parametrize("case", range(4))
def test_star_clusters(spark, case):
    rnd = random.Random(case)
    n = 12
    edges = [p for p in itertools.combinations(range(n), 2) if rnd.random() < 0.15 * (case + 1) / 2]
    names = spark.createDataFrame([(i,) for i in range(n)], "rank bigint")
    got = C.star_clusters(names, spark.createDataFrame(edges, "rank_a bigint, rank_b bigint"))
    assert {r.rank: r.seed for r in got.collect()} == _sequential(n, edges)


def test_blocking_loses_nothing(spark):
    names = ["Ann Cole", "Anne Cole", "Ann Kohl", "Bill Cole", "William B. Cole", "Cole", "Ann", "Bob Smith", "Robert Smyth", "R. Schmidt", "X Æ", "Ann Cole Jr."]
    frame = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "name string, rank bigint")
    f = C.name_features(frame).cache()
    every = spark.createDataFrame(list(itertools.combinations(range(len(names)), 2)), "rank_a bigint, rank_b bigint")
    above = {(r.rank_a, r.rank_b) for r in C.score_pairs(every, f, f).filter("score > 0").collect()}
    assert above <= {(r.rank_a, r.rank_b) for r in C.candidate_pairs(f, bare_names="every").collect()}


def test_close_bare_names_lose_no_match(spark):
    rnd = random.Random(21)
    base = ["Ann", "Anna", "Bill", "Margaret", "Peggy", "Cole", "Al", "X", "Christophersen", "Maria-Luise", "O'Brien", "Zoë", "Li"]
    names = base + [f"{rnd.choice(base)} {rnd.choice(['Cole', 'Smith', 'Annason', 'Christopherson', 'Lix'])}" for _ in range(14)]
    for n in list(base):
        k = rnd.randrange(len(n))
        names += [n[:k] + rnd.choice("aeio") + n[k:], n[:k] + n[k + 1:] + "s", n.upper() + " Jr."]
    names = [n for n in dict.fromkeys(names) if n.strip()]
    frame = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "name string, rank bigint")
    f = C.name_features(frame).cache()
    every = spark.createDataFrame(list(itertools.combinations(range(len(names)), 2)), "rank_a bigint, rank_b bigint")
    matches = {(r.rank_a, r.rank_b) for r in C.score_pairs(every, f, f).filter("confidence > 0").collect()}
    close = {(r.rank_a, r.rank_b) for r in C.candidate_pairs(f).collect()}
    assert matches <= close and len(close) < 0.7 * every.count()


def _claims(spark):
    rows = [(1, 10, "person_name", "Ann Cole", "deceased_primary", "Ann Cole", None, None, "1.00"),
            (2, 10, "person_death_date", "Ann Cole", "deceased_primary", "1 May 2001", None, None, "0.90"),
            (3, 11, "person_death_date", "Anne Cole", "other", "2 May 2001", None, None, "0.80"),
            (4, 11, "relationship", "Bob Smith", "other", "child", "Ann Cole", "son", "0.90")]
    return spark.createDataFrame([(*r[:8], __import__("decimal").Decimal(r[8])) for r in rows],
                                 "id bigint, document_id bigint, fact_type string, subject_name string, subject_role string, fact_value string, "
                                 "related_name string, relationship_type string, confidence_score decimal(3,2)")


def test_materialise(spark):
    claims = _claims(spark)
    new, entities = C.materialise(claims, C.resolve(claims))
    e = {r.id: r for r in entities.collect()}
    assert e[1].canonical_name == "Anne Cole" and e[1].source_count == 2 and e[1].entity_status == "verified"
    assert e[2].name_variants == ["Bob Smith"] and e[2].entity_status == "unverified"
    assert A.entity_conflicts(new).count() == 1
    linked, entities2 = K.link(new.withColumn("registry_person_id", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("string")), entities, 1, "I1")
    assert linked.filter("resolution_status = 'resolved'").count() == 3
    assert entities2.filter("registry_person_id = 'I1'").count() == 1


def test_links_are_checked(spark):
    entities = spark.createDataFrame([(1, None, "unverified"), (2, "I2", "verified")], "id bigint, registry_person_id string, entity_status string")
    claims = spark.createDataFrame([(1, None, "clustered")], "entity_id bigint, registry_person_id string, resolution_status string")
    for entity, person in ((7, "I9"), (1, "I2"), (7, "I2")):
        with pytest.raises(ValueError):
            K.link(claims, entities, entity, person)
    assert K.link(claims, entities, 1, "I9")[0].first().resolution_status == "resolved"
    assert K.link(claims, entities, 2, "I2")[1].filter("registry_person_id = 'I2'").count() == 1
    cited = spark.createDataFrame([(2,), (2,), (1,)], "entity_id bigint")
    assert [tuple(r) for r in K.unlink_summary(entities, cited, 2).collect()] == [("I2", 2)]


def test_linkage_numbers(spark):
    rows = [("a", 1.0, None, None, None, None), ("b", 1.0, "x", "y", None, None), ("c", 1.0, "x", "y", "x", "y"), ("d", 0.95, "x", "x", None, None)]
    x = spark.createDataFrame(rows, "k string, name_score double, death_date string, registry_death_date string, birth_date string, registry_birth_date string")
    x = x.selectExpr("*", "'m' as name_method")
    assert {r.k: r.confidence for r in R.linkage_scores(x).collect()} == {"a": 1.0, "b": 0.57, "c": 0.44, "d": 0.97}


def test_extraction(spark):
    memo = spark.createDataFrame([(1, "h", "p", None), (2, "h", "p", "[]"), (3, "h", "p", "[1]")], "id bigint, prompt_hash string, provider string, parsed_json string")
    asked = spark.createDataFrame([("h", "p"), ("g", "p")], "prompt_hash string, provider string")
    assert {r.prompt_hash: r.memo_id for r in L.memo_lookup(asked, memo).collect()} == {"h": 2, "g": None}
    answer = '```json\n[{"fact_type":"person_name","subject_name":"Ann"},{"fact_type":"person_name","subject_name":"Ann"},{"fact_type":"","subject_name":"B"},{"fact_type":"relationship","subject_name":"Ann"}]\n```'
    rows = spark.createDataFrame([(1, 1, answer)], "document_id bigint, memo_id bigint, t string").select("document_id", "memo_id", L.clean_response(__import__("pyspark.sql.functions", fromlist=["col"]).col("t")).alias("parsed_json"))
    claims = L.dedup_claims(L.default_claims(L.parse_claims(rows)))
    got = {(r.fact_type, r.fact_value, float(r.confidence_score)) for r in claims.collect()}
    assert got == {("person_name", "Ann", 0.8), ("relationship", "related", 0.8)}
    assert L.append_claims(claims, claims).count() == 0
    docs = spark.createDataFrame([(1, 'Pat (Stan) Mills, Lena R. "Bee" Poe (nee Ash), the late Omar Poe, Kit (5), for 40 years, at the age of 81')], "id bigint, extracted_text string")
    kinds = {(r.kind, r.value) for r in L.read_notation(docs).collect()}
    assert {("spouse_given", "Stan"), ("surname", "Mills"), ("maiden_name", "Ash"), ("age", "5"), ("marriage_years", "40"), ("death_age", "81"), ("nickname", "Bee")} <= kinds


def test_process_remembers(spark):
    from lodestead.operators import process as P
    from lodestead.schemas import empty

    texts = [(1, 'Lena R. Poe "x" died on June 3, 1999 at the age of 81. Kit R. "Bee" Ash (nee Orr) was wed for 40 years.'), (2, "no names in here"), (3, "no names in here"), (4, None)]
    docs = spark.createDataFrame(texts, "id bigint, extracted_text string")
    memo, claims = empty(spark, "memo"), empty(spark, "claims")
    out = P.process(docs, memo, claims)
    got = {(r.document_id, r.fact_type, r.subject_name, r.fact_value) for r in out.claims.collect()}
    assert {(1, "person_name", "Lena R. Poe", "Lena R. Poe"), (1, "person_death_date", "Lena R. Poe", "June 3, 1999"), (1, "person_death_age", "Lena R. Poe", "81"),
            (1, "marriage_duration", "Lena R. Poe", "40 years"), (1, "person_nickname", "Kit R.", "Bee")} <= got
    status = {r.id: (r.processing_status, r.claims) for r in out.documents.collect()}
    assert status[1][0] == status[2][0] == "completed" and status[2][1] == 0 and set(status) == {1, 2, 3, 4}
    kept = spark.createDataFrame(out.memo.collect(), out.memo.schema)
    assert kept.groupBy("prompt_hash").count().filter("count > 1").count() == 0
    again = P.process(docs.filter("id < 4"), kept, spark.createDataFrame(out.claims.collect(), out.claims.schema))
    assert again.memo.count() == 0 and again.claims.count() == 0

    def broken(prompts):
        return prompts.selectExpr("prompt_hash", "if(document_id = 2, 'I can not say', '[]') as response_text", "cast(null as string) as api_error")

    failed = P.process(docs.filter("id < 3"), memo, claims, facts=broken)
    assert {r.id: r.processing_status for r in failed.documents.collect()} == {1: "completed", 2: "failed"}
    errors = failed.memo.filter("api_error is not null").collect()
    assert len(errors) == 1 and errors[0].document_id == 2 and errors[0].parsed_json is None


def test_first_posted_stays(spark):
    posted = spark.createDataFrame([("u", "b", 1), ("u", "a", 2), ("v", "c", 3)], "url string, text string, n int")
    known = spark.createDataFrame([], "url_hash string")
    assert {(r.url, r.extracted_text) for r in L.ingest(known, posted, "n").collect()} == {("u", "b"), ("v", "c")}


def test_containing_loses_nothing(spark):
    import random

    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abc") for _ in range(n))
    texts = list({(word(rnd.randint(0, 3)), word(rnd.randint(1, 5))) for _ in range(60)})
    known = [(str(i), word(rnd.randint(0, 6)), word(rnd.randint(0, 9))) for i in range(120)]
    got = R.containing(spark.createDataFrame(texts, "given string, surname string"), spark.createDataFrame(known, "registry_id string, g string, s string")).collect()
    assert sorted((r.given, r.surname, r.registry_id) for r in got) == sorted((g, s, i) for g, s in texts for i, kg, ks in known if s in ks and g in kg)


def test_numbers_follow_a_total_order(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 500, 1, 7).withColumn("k", F.col("id") * 37 % 101).withColumnRenamed("id", "r").repartition(5)
    got = {r.r: r.id for r in C.numbered_by(rows, [F.desc("k"), F.asc("r")]).collect()}
    want = sorted(range(500), key=lambda r: (-(r * 37 % 101), r))
    assert [got[r] for r in want] == list(range(1, 501))


def test_store_and_stream(spark, tmp_path):
    from lodestead.streaming.ingest import start_ingest

    store = Store(spark, str(tmp_path / "store"))
    assert not store.healthy() and store.read("claims").count() == 0
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("u1", "one"), ("u1", "two"), ("u2", "three")], "url string, text string").write.mode("append").json(str(tmp_path / "in"))
    posted = spark.readStream.schema("url string, text string").json(str(tmp_path / "in"))
    for _ in range(2):
        start_ingest(posted, store, str(tmp_path / "cp")).awaitTermination()
    assert {r.url for r in store.read("documents").collect()} == {"u1", "u2"} and store.read("documents").count() == 2
    assert {r.table: r.removed for r in store.reset().collect()}["documents"] == 2 and store.read("documents").count() == 0
    assert typed_settings(default_settings(spark)).filter("as_integer = 365").count() == 1


def _names_like(seed, n):
    rnd = random.Random(seed)
    base = ["Ann", "Anna", "Bill", "William", "Margaret", "Peggy", "Al", "X", "Christophersen", "Maria-Luise", "O'Brien", "Zoë", "Li", "J. R.", "Kathryn", "Catherine"]
    last = ["Cole", "Cohl", "Smith", "Smyth", "Christopherson", "Lix", "", "Jr.", "Æ", "Montgomery"]
    names = [f"{rnd.choice(base)} {rnd.choice([*base, '', ''])} {rnd.choice(last)}".strip() for _ in range(n)]
    for k in range(0, len(names), 3):
        i = rnd.randrange(len(names[k]))
        names[k] = (names[k][:i] + rnd.choice("aeio ") + names[k][i:], names[k][:i] + names[k][i + 1:] + "s", names[k].upper(), names[k] + " Jr.")[k % 4]
    return [n for n in dict.fromkeys(names) if n.strip()]


@pytest.mark.parametrize("threshold, cut", [(0.85, 0.85), (0.6, 0.6), (0.7, 0.0), (0.97, 0.95), (0.3, 0.3)])
def test_matching_pairs_lose_no_match_at_any_threshold(spark, threshold, cut):
    names = _names_like(int(100 * threshold), 70)
    frame = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "name string, rank bigint")
    f = C.name_features(frame).cache()
    every = spark.createDataFrame(list(itertools.combinations(range(len(names)), 2)), "rank_a bigint, rank_b bigint")

    def matches(pairs):
        return {tuple(r) for r in C.score_pairs(pairs, f, f, threshold).filter(f"confidence > 0 and confidence >= {cut}").select("rank_a", "rank_b", "confidence").collect()}

    want, made = matches(every), C.matching_pairs(f, cut, tile=7)
    assert matches(made) == want and len(want) > 20
    assert made.count() == made.distinct().count() < 0.5 * every.count()
    bare = {n for n, name in enumerate(names) if len(name.split()) < 2}
    close = {(r.rank_a, r.rank_b) for r in C.candidate_pairs(f, cut=cut).collect()}
    assert {(a, b) for a, b, _ in want if a in bare or b in bare} <= close
    norm = {r["rank"]: r.norm for r in f.collect()}
    alone = {(a, b, c) for a, b, c in want if not (a in bare or b in bare) or norm[a] == norm[b]}
    assert matches(C.matching_pairs(f, cut, bare=False)) == alone


def test_tiles_make_each_pair_once(spark):
    rows = [(i, "hot", int(i % 5 == 0)) for i in range(60)] + [(i, f"k{i % 7}", 0) for i in range(30)]
    got = [tuple(r) for r in C.tiled_pairs(spark.createDataFrame(rows, "rank bigint, k string, role int"), tile=9).collect()]
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if a % 5 or b % 5}
    few = {(a, b) for a, b in itertools.combinations(range(30), 2) if a % 7 == b % 7}
    assert len(got) == len(want) + len(few) and set(got) == want | few


def _seed_flags(order, edges):
    """Greedy, one name after the other in order of rank."""
    near = {frozenset(e) for e in edges}
    seeds = []
    for n in sorted(order, key=order.get):
        if not any(frozenset((n, s)) in near for s in seeds):
            seeds.append(n)
    return set(seeds)


def test_repair_equals_a_full_run(spark):
    rnd = random.Random(17)
    order, edges, flags = {}, set(), {}
    for batch in range(4):
        old = dict(order)
        for _ in range(rnd.randint(1, 6)):
            n = f"n{len(order)}" if rnd.random() < 0.7 or not order else rnd.choice(list(order))
            order[n] = min(order.get(n, 10**9), rnd.randrange(10**6))
        fresh, moved = order.keys() - old.keys(), {n for n in old if order[n] < old[n]}
        edges |= {(a, b) for a in fresh for b in order if a != b and (a < b or b not in fresh) and rnd.random() < 0.25}
        dirty = fresh | moved | {b for e in edges for a, b in (e, e[::-1]) if a in moved}
        names = spark.createDataFrame([(n, r, flags.get(n)) for n, r in order.items()], "name string, rank bigint, was_seed boolean")
        frame = spark.createDataFrame(sorted(edges), "name_a string, name_b string")
        got = {r.name: r.is_seed for r in C.repair_seeds(names, frame, spark.createDataFrame([(n,) for n in dirty], "name string")).collect()}
        assert {n for n, s in got.items() if s} == _seed_flags(order, edges) and got.keys() == order.keys(), batch
        flags = got


def test_more_claims_equal_all_claims(spark):
    rnd = random.Random(23)
    names = ["Ann Cole", "Anne Cole", "ANN COLE", "Ann Q. Cole", "Anna Cole", "Bob Smith", "Robert Smith", "Bobby Smith", "Rob Smyth", "Smith", "Bob", "Kathryn Poe", "Catherine Poe",
             "Cathy Poe", "Kate Poe Jr.", "Al Lix", "Ali Lix", "Alan Lix"]
    claims = [(i, rnd.choice(names)) for i in rnd.sample(range(1000), 59)] + [(5000, None)]
    rnd.shuffle(claims)
    state, so_far = None, []
    for k in range(0, len(claims), 30):
        batch = claims[k:k + 30]
        so_far += batch
        state = C.resolve_more(state, spark.createDataFrame(batch, "id bigint, subject_name string"))
    want = {r.name: (r["rank"], r.seed) for r in C.resolve(spark.createDataFrame(so_far, "id bigint, subject_name string")).collect()}
    got = state.names.collect()
    rank = {r.name: r["rank"] for r in got}
    assert {r.name: (r["rank"], rank[r.seed]) for r in got} == want and any(r.seed != r.name for r in got)
