"""Every reference query against its SQL in DuckDB, at the smallest scale."""

import os

import pytest

from quarrywell.plans import queries as plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 5) + 0.0
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return x if isinstance(x, (int, bool, type(None))) else str(x)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(plans.SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
