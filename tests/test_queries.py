"""Every query with SQL gives the rows that DuckDB gives for it on the same tables."""

import datetime
import os

import duckdb
import pytest

from vergence.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return f"{float(v):.6f}"


def _rows(rows):
    return sorted(tuple(map(_cell, r)) for r in rows)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_same_rows_as_sql(spark, duck, name):
    query, sql = QUERIES[name]
    df, expected = query(spark, SF), duck.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    assert _rows(df.select(*columns).collect()) == _rows([[r[i] for i in at] for r in expected.fetchall()])


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_runs_without_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    assert QUERIES[name][0](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["query_id", "rank", "asset_id", "seq", "overlap", "score"]
