"""Registered queries against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from docmill.plans.catalogue import oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f + '/*.parquet' if os.path.isdir(f) else f}')")
    return con


def values(df):
    cell = lambda v: "" if pd.isna(v) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, name):
    assert values(queries()[name](spark, SF).toPandas()) == values(duck.execute(oracle_sql()[name]).df())
