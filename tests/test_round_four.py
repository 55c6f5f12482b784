"""Searches, lookups and jobs whose work must not grow with the square of a group."""

import duckdb

from lodestead.operators import link as R
from lodestead.plans import catalog
from lodestead.schemas import SCHEMAS


def most_rows(spark, work):
    """The rows of the frame that ``work`` makes, and the most that any operator of the runs behind it made."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    rows = work().collect()
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    runs, most = store.executionsList(), 0
    for k in range(before, runs.size()):
        run = runs.apply(k)
        values = store.executionMetrics(run.executionId())
        for i in range(run.metrics().size()):
            m = run.metrics().apply(i)
            told = values.get(m.accumulatorId())
            if m.name() == "number of output rows" and told.isDefined():
                most = max(most, int(told.get().replace(",", "")))
    return rows, most


def people(spark, names):
    return spark.createDataFrame([(f"I{k:06}", str(k), 1, (g, [s]), [], [], []) for k, (g, s) in enumerate(names)], SCHEMAS["registry_people"])


def test_many_searches_of_one_name(spark):
    registry = people(spark, [("Ann", "Cole")] * 600 + [("Joan", "Coleman")] * 600)
    asked = spark.createDataFrame([(k, None, "COLE" if k % 2 else "man", "") for k in range(900)], "query_id bigint, query string, surname string, given string")
    rows, most = most_rows(spark, lambda: R.search_many(registry, asked, 2))
    assert {(r.query_id, r.registry_id, r.place) for r in rows} == {(k, f"I{p + i:06}", i + 1) for k in range(900) for p in [0 if k % 2 else 600] for i in range(2)}
    # not every query with every person that answers it
    assert most < 10_000


def test_source_lookup_of_shared_addresses(spark, tmp_path):
    pages = [(1, "a"), (2, "a"), (4, "a"), (4, "a"), (3, "b"), (6, "c"), (5, "d"), (7, "d"), (8, None), (9, None)]
    spark.createDataFrame([(*p, "") for p in pages], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = db.execute(catalog.oracle_sql()["source_lookup"]).fetchall()
    got = [tuple(r) for r in catalog.queries()["source_lookup"](spark, str(tmp_path)).select("url", "registry_id").collect()]
    assert len(got) == 8 and sorted(map(str, got)) == sorted(map(str, want))


def test_text_files_fill_few_folders(spark, tmp_path):
    pages = [(k, f"page {k}\r\nof two lines") for k in range(60)] + [(60, ""), (61, None), (62, "\n")]
    spark.createDataFrame(pages, "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    frame = catalog.queries()["text_files"](spark, str(tmp_path))
    assert sorted(map(str, frame.select("page_id", "digest").toPandas().values.tolist())) == sorted(map(str, db.execute(catalog.oracle_sql()["text_files"]).df().values.tolist()))
    files = frame.inputFiles()
    # a file a page, but not a folder a page
    assert len(files) == 63 and len({f.rsplit("/", 1)[0] for f in files}) <= 4 * spark.sparkContext.defaultParallelism


def test_matches_of_many_people_of_one_name(spark):
    registry = people(spark, [("Ann", "Cole")] * 3000)
    variants = [f"{g} {s}" for g in ("A", "An", "Ann", "N", "Nn") for s in ("C", "Co", "Col", "Cole", "O", "Ol", "Ole", "L", "Le", "E")]
    entities = spark.createDataFrame([(1, variants)], "id bigint, name_variants array<string>")
    none = [spark.createDataFrame([], SCHEMAS[t]) for t in ("claims", "registry_events")]
    rows, most = most_rows(spark, lambda: R.find_matches(entities, none[0], registry, none[1], keep=0.0))
    assert [r.registry_id for r in rows] == [f"I{k:06}" for k in range(5)]
    assert most < 20_000
