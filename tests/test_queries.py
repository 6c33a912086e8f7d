"""Every query with SQL against DuckDB over a small copy of the test tables' layout."""

import os

import pytest

import __spark_entry__
from graphloom import queries as core

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def canonical(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(df.where(df.notna(), None).astype(str).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_against_sql(spark, tables, name):
    got = core.QUERIES[name](spark, SF).toPandas()
    want = tables.execute(core.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(core.QUERIES) <= set(__spark_entry__.queries())
