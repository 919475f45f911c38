"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from lodestar.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ in ("bool",):
        return int(v)
    return round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, con, name):
    found, want = QUERIES[name](spark, sf), con.sql(SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    clean = lambda rows, names: sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rows), key=repr)
    assert clean(map(tuple, found.collect()), found.columns) == clean(want.fetchall(), want.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
