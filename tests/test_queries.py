"""Every registered query against its DuckDB SQL at the smallest scale."""

import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as driver
from textloom import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([plain(x) for x in v])
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in registry.ORACLE_SQL:
        assert df.columns
        return
    want = duck.sql(registry.ORACLE_SQL[name])
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    places = [want.columns.index(c) for c in names]
    assert sorted(tuple(plain(r[c]) for c in names) for r in rows) == sorted(tuple(plain(r[i]) for i in places) for r in want.fetchall())


def test_entry(spark, sf):
    assert driver.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())
