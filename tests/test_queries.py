"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from lodestead.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def _plain(df):
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        if str(df[k].dtype).startswith("float"):
            df[k] = df[k].map(lambda x: None if x != x else repr(round(float(x), 9)))
        df[k] = df[k].map(lambda x: None if x is None or x != x else str(x))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, db, small, name):
    mine, other = _plain(catalog.queries()[name](spark, small).toPandas()), _plain(db.execute(catalog.oracle_sql()[name]).df())
    assert list(mine.columns) == list(other.columns)
    assert mine.equals(other)


def test_orders(spark, small):
    rows = catalog.corroborated_claims(spark, small).collect()
    assert [(-r.source_count, -r.avg_confidence) for r in rows] == sorted((-r.source_count, -r.avg_confidence) for r in rows)
    queue = [r.confidence_score for r in catalog.review_queue(spark, small).select("confidence_score").collect()]
    assert queue == sorted(queue)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
