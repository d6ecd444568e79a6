"""Every core query against its DuckDB oracle on the smallest tables, and the driver contract."""

import math
import os

import pytest

import __spark_entry__ as entry_points
from strataseek.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name in ORACLES:
        rel = duck.sql(ORACLES[name])
        at = [rel.columns.index(c) for c in columns]
        assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
    else:
        assert rows


def test_entry(spark):
    assert entry_points.entry(spark).columns
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
