"""Queries against DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from specweave.plans.catalogue import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem documents embeddings pages benchmark".split()


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return float(x) if isinstance(x, int | float) and not isinstance(x, bool) else x


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, small, duck, name):
    got = QUERIES[name](spark, small)
    found = duck.execute(ORACLE[name])
    cols = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(cols)
    want = sorted(repr(tuple(plain(x) for x in r)) for r in found.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in cols)) for r in got.collect()) == want
