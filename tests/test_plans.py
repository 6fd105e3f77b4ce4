"""Registered layout queries against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest
from conftest import SMALL

from gridloom.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(names, data):
    order = [names.index(n) for n in sorted(names)]
    show = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)
    return sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    want = duck.execute(SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())
