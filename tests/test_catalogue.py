"""Every catalogue query against its SQL, in another engine."""

import math

import duckdb
import pytest

from tessera.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, con, name):
    df = QUERIES[name](spark, data)
    got = df.collect()
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    rows = sorted(([plain(r[n]) for n in names] for r in got), key=repr)
    assert rows == sorted(([plain(v) for v in r] for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs_and_repeats(spark, data, name):
    a, b = QUERIES[name](spark, data).collect(), QUERIES[name](spark, data).collect()
    assert a and sorted(map(repr, a)) == sorted(map(repr, b))


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
