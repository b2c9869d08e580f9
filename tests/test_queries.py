"""Every registered query with SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from ensemblar.plans import ORACLE, QUERIES

from conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    cur = duck.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    got = QUERIES[name](spark, SMALL)
    out = got.collect()
    # the smallest table has no window with eight cells
    assert got.columns and len(set(map(repr, out))) == len(out) and (out or name == "x2_stream_events")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "age" and df.count() > 0


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.basename(entry.__file__) == "__spark_entry__.py"
