"""Every registered query against its SQL at the smallest scale."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tessera.plans.all_queries import ORACLE, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([plain(x) for x in v])
    if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return "null"
    if isinstance(v, (float, np.floating)):
        return f"{v:.6g}"
    return str(v)


def rows(df):
    names = sorted(df.columns)
    numeric = df[names].apply(lambda c: c.astype(float) if pd.api.types.is_numeric_dtype(c) and not pd.api.types.is_bool_dtype(c) else c)
    return names, sorted(tuple(map(plain, r)) for r in numeric.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).columns


def test_entry(spark):
    assert entry.entry(spark).columns and set(entry.oracle_sql()) <= set(entry.queries())
