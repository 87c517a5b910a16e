"""Every registered query against its oracle in DuckDB, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest

from larder.plans.all import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, decimal.Decimal | float):
        return "nan" if math.isnan(v) else round(float(v), 6)
    if isinstance(v, list | tuple):
        return tuple(map(norm, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no shared tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in frame.collect()), key=repr)
    if name not in ORACLES:
        return
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted((tuple(norm(r[k]) for k in order) for r in result.fetchall()), key=repr)
