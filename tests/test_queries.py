"""Every registered query of the movement operators against its SQL on the smallest driver tables."""

import os

import duckdb
import pytest

from kinetiq.plans.registry import ORACLES, QUERIES

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="driver tables are not here")


def rows(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.astype(object).where(df.notna(), None).values.tolist():
        out.append(tuple(None if v is None else float(v) + 0.0 if not isinstance(v, str) else v for v in r))
    return sorted(out, key=str)


#: Queries without SQL; other tests hold their values, here they have to run.
NO_SQL = sorted(set(QUERIES) - set(ORACLES))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(TABLES):
        c.execute(f"create view {name.split('.')[0]} as select * from '{TABLES}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, TABLES).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or abs(u - v) <= 1e-9 * max(1.0, abs(u)), (x, y)


@pytest.mark.parametrize("name", NO_SQL)
def test_query_without_sql_runs(spark, name):
    found = QUERIES[name](spark, TABLES)
    assert found.columns and found.toPandas() is not None
