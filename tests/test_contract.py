"""Every query of the library against its SQL on the smallest tables."""

import math
import os

import pytest

import tarnfield.plans.queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the generated tables are not here")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(x):
    return None if isinstance(x, float) and math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_sql(spark, con, name):
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    expect = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in result.fetchall()), key=str)
    assert len(got) == len(expect)
    for a, b in zip(got, expect):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=1.1e-4)) for x, y in zip(a, b)), (a, b)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
