"""The pipeline's stages, one after the other, against their own operators."""

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from lodestead.llm import decontaminate, pii, queries, simhash


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, small).cache()
        assert after.columns == docs.columns
        a, b = ({r.doc_id for r in x.select("doc_id").collect()} for x in (after, before))
        assert a <= b
        if name == "simhash":
            assert a == {r.doc_id for r in simhash.simhash_groups(before).filter("doc_id = component_id").collect()}
        if name == "decontamination":
            assert b - a == {r.doc_id for r in decontaminate.leaks(before, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
        if name == "pii":
            assert a == b and all(not pii.find_all(r.text)[1] for r in after.collect())
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, small)
    assert set(last.columns) == {*docs.columns, "size", "source_size", "target", "taken"}
    assert last.count() == corpus_pipeline.run(spark, small).count()


def test_labels_of_rejected(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, small).select("doc_id").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.2 * max(1, sum(q == 0 for q in labels.values()))


def test_every_query_is_there():
    assert [n.split("_")[0] for n in queries.queries() if n.startswith("op")] == [f"op{k}" for k in range(1, 14)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = db.execute(queries.oracle_sql()[name]).fetchdf()
    got = queries.queries()[name](spark, folder).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    key = got.columns[0]
    got, want = (x.sort_values(key).reset_index(drop=True)[sorted(got.columns)] for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_exact=True)
