"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from lexigrain import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = pd.to_numeric(df[c]).round(6) if df[c].dtype.kind in "if" else df[c].map(lambda x: None if x is None or x != x else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = normal(queries.QUERIES[name](spark, SF).toPandas()), normal(duck.execute(queries.SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_entry(spark):
    assert set(__spark_entry__.entry(spark).columns) == {"label", "n", "pct"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
