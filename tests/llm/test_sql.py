"""Operator queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from docmill.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries()[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())
