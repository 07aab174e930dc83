"""Every catalogue query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from sigmaspark.plans import catalog, media  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, (float, np.floating)):
        return repr(round(float(v), 6) + 0.0)
    return str(int(v)) if isinstance(v, np.integer) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    a, b = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = [sorted(tuple(map(cell, r)) for r in d[sorted(d.columns)].astype(object).itertuples(index=False, name=None)) for d in (a, b)]
    assert rows[0] == rows[1] and rows[0]


def test_only_folds_of_state_have_no_sql():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"idle_evictions"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
