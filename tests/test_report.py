"""Registered report queries against their SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from corvane.plans import oracle, queries


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(oracle.SQL)


@pytest.mark.parametrize("name", [n for n in queries.NAMES if n not in ("brief_areas", "health")])
def test_query(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.sql(oracle.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()))
    assert rows(got) == rows(want)
