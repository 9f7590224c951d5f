"""Each query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return None if pd.isna(v) else int(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and v == int(v) else v


def rows(df):
    return sorted(repr(tuple(map(plain, r))) for r in df[sorted(df.columns)].astype(object).values)


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith("op")))
def test_same_rows(spark, duck, tables, name):
    got, want = entry.queries()[name](spark, tables).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
