"""Every registered query against its SQL on the smallest data folder."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from verify import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
SLOW = {"m02_train_compare", "m03_score_batch", "m05_top_drivers", "m06_feature_importance"}
QUERIES = {n: q for n, q in entry_points.queries().items() if n not in entry_points.LLM_QUERIES}
SQL = {n: q for n, q in entry_points.oracle_sql().items() if n in QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    return con


def test_entry_point(spark):
    assert entry_points.entry(spark).count() == 5


def test_only_queries_without_sql_form_lack_sql():
    assert set(QUERIES) - set(SQL) == SLOW


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(SQL[name])
    assert got == rows_of([c[0] for c in cursor.description], cursor.fetchall())
