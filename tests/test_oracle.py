"""Every registered vehicle query against DuckDB on the same files."""

import datetime
import decimal
import math

import duckdb
import pytest

from motorcade.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = ordered(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLE:
        assert rows
        return
    rel = duck.execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    got = rel.fetchall()
    assert sorted(names) == cols
    order = sorted(range(len(names)), key=names.__getitem__)
    assert rows == ordered(tuple(plain(r[i]) for i in order) for r in got)
