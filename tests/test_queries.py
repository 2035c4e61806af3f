"""Every registered query of the library's own operators against its oracle, on the small tables."""

import datetime
import math

import duckdb
import pytest

from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 3) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in catalogue.ORACLES:
        assert got
        return
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == columns
    want = [tuple(plain(dict(zip(rel.columns, r))[c]) for c in columns) for r in rel.fetchall()]
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=repr), sorted(want, key=repr)):
        for a, b in zip(g, w):
            assert a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-3 + 1e-6 * abs(b), (g, w)
