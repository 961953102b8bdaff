"""Every catalogue query with SQL gives the same rows as DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from tablewise.catalog import all_queries, all_sql
from tools.check_sql import TABLES, rows_of

QUERIES, SQL = all_queries(), all_sql()  # the training-data queries are tested in tests/llm


@pytest.fixture(scope="module")
def db(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, folder, db, name):
    df = QUERIES[name](spark, folder)
    result = db.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"churn_scores"}))
def test_query_without_sql(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
