"""Every query that has SQL gives the rows of that SQL, on the smallest tables."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, np.generic):
        x = x.item()
    return None if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)) else x


def rows(frame, columns):
    return sorted((tuple(map(plain, r)) for r in frame[columns].values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
