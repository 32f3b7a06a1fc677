"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import datetime
import decimal
import os

import pytest

from loomnote.plans import registry

D = os.environ.get("LOOMNOTE_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="the test tables aren't here")


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, D)
    got, rel = df.collect(), duck.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    want = [tuple(norm(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()]
    assert sorted((tuple(norm(r[c]) for c in cols) for r in got), key=repr) == sorted(want, key=repr)
