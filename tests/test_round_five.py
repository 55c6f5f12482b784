"""Jobs whose work must be dealt over the cores, and must not grow faster than their input."""

from pyspark.sql import functions as F

from lodestead.operators import extract as L
from lodestead.operators import resolve as C
from lodestead.plans import catalog


def most_moved(spark, work):
    """The rows of the frames that ``work`` makes, and the most that any exchange of the runs behind them wrote."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    rows = [frame.collect() for frame in work()]
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    runs, most = store.executionsList(), 0
    for k in range(before, runs.size()):
        run = runs.apply(k)
        values = store.executionMetrics(run.executionId())
        for i in range(run.metrics().size()):
            m = run.metrics().apply(i)
            told = values.get(m.accumulatorId())
            if m.name() == "shuffle records written" and told.isDefined():
                most = max(most, int(told.get().replace(",", "")))
    return rows, most


def test_notation_of_one_file_is_read_by_all_cores(spark, tmp_path):
    spark.range(400).select(F.col("id").alias("p_partkey"), F.concat(F.lit("hot bolt"), F.lit("")).alias("p_name")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    frame = catalog.queries()["notation_kinds"](spark, str(tmp_path))
    tasks = frame.groupBy(F.spark_partition_id().alias("task")).count().collect()
    # all ten things of each text, in no single task
    assert len(tasks) >= spark.sparkContext.defaultParallelism and sum(r["count"] for r in tasks) == 4000


def test_notation_searches_a_text_once(spark):
    texts = [(1, 'Ann (Bo) Cole and Cy Dee, the late Eve F. Gray, Hal (7), Ida "Jo" (nee Kay) wed for 20 years; died, at the age of 90, on May 1, 2001'), (2, None), (3, ""),
             (4, 'Ann (Bo) Cole (Di) Els; the late Fay and Gil Hoy; "Ike" Jan "Kim"; Lee (nee Moe) (nee Nye); for 1 years for 22 years; passed away June 3 2004. died. July 4, 2005')]
    docs = spark.createDataFrame(texts, "id bigint, extracted_text string")
    got = L.read_notation(docs)
    rows = {(r.document_id, r.full_name, r.kind, r.value) for r in got.collect()}
    assert rows == {(1, "Ann", "spouse_given", "Bo"), (1, "Ann", "surname", "Cole"), (1, "Ida", "nickname", "Jo"), (1, "Eve F. Gray", "deceased", None), (1, "Hal", "age", "7"),
                    (1, None, "death_age", "90"), (1, None, "death_date", "May 1, 2001"), (1, None, "marriage_years", "20"), (1, "Cole", "shared_surname", "Dee"),
                    (4, "Ann", "spouse_given", "Bo"), (4, "Ann", "surname", "Cole"), (4, "Jan", "nickname", "Kim"), (4, "Lee", "maiden_name", "Moe"), (4, "Fay", "deceased", None),
                    (4, None, "marriage_years", "1"), (4, None, "marriage_years", "22"), (4, None, "death_date", "June 3 2004"), (4, "Fay", "shared_surname", "Hoy")}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 10


def test_claims_go_to_their_entities_where_they_lie(spark):
    n = 6000
    claims = spark.range(n).select(
        "id", (F.col("id") % 3).alias("document_id"), F.when(F.col("id") % 100 == 99, F.lit(None)).when(F.col("id") % 2 == 0, "Ann Cole").otherwise("Anne Cole").alias("subject_name"),
        F.when(F.col("id") == 4, "person_nickname").otherwise("relationship").alias("fact_type"), F.lit("Nan").alias("fact_value"), F.lit("0.50").cast("decimal(3,2)").alias("confidence_score"),
        F.lit(7).cast("bigint").alias("entity_id"), F.lit("old").alias("resolution_status"))
    clusters = spark.createDataFrame([("Ann Cole", 0, 0), ("Anne Cole", 1, 0)], "name string, rank bigint, seed bigint")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        (new, entities), most = most_moved(spark, lambda: C.materialise(claims, clusters))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert len(new) == n and {(r.subject_name, r.entity_id, r.resolution_status) for r in new} == {("Ann Cole", 1, "clustered"), ("Anne Cole", 1, "clustered"), (None, None, "unresolved")}
    e = entities[0]
    assert len(entities) == 1 and (e.canonical_name, e.name_variants, e.nicknames, e.maiden_names) == ("Anne Cole", ["Ann Cole", "Anne Cole"], ["Nan"], None)
    assert (e.fact_count, e.source_count, str(e.confidence_score)) == (n - n // 100, 3, "0.50")
    # names and sums of each task, but no claim by itself
    assert most < 200


def test_an_outbox_is_planned_once(spark, small):
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    sent = catalog.queries()["delivered_writes"](spark, small)
    assert sent.count() == sent.select("handle").distinct().count() > 0
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    plans = [runs.apply(k).physicalPlanDescription() for k in range(before, runs.size())]
    # not anew for every kind and run
    assert sum("orders.parquet" in p for p in plans) == 1


def test_prompts_do_not_go_through_the_driver(spark, tmp_path):
    memo = spark.createDataFrame([(1, "h1", "reader", "[]")], "id bigint, prompt_hash string, provider string, parsed_json string")
    spark.range(50).select(F.concat(F.lit("h"), "id").alias("prompt_hash"), F.lit("reader").alias("provider")).write.parquet(f"{tmp_path}/prompts")
    found = L.memo_lookup(spark.read.parquet(f"{tmp_path}/prompts"), memo).filter("parsed_json is not null")
    assert [(r.prompt_hash, r.memo_id) for r in found.collect()] == [("h1", 1)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
