"""Every registered query outside the optional folder against its oracle, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from provena import catalog


def plain(v):
    if isinstance(v, (list, dict)):
        return v
    if pd.isna(v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return int(v) if isinstance(v, float) and v.is_integer() else round(v, 9) if isinstance(v, float) else v


def lines(frame):
    columns = sorted(frame.columns)
    return sorted(str(tuple(map(plain, r))) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, data, duck, name):
    got = catalog.queries()[name](spark, data).toPandas()
    if name not in catalog.oracle_sql():
        assert len(got.columns) > 0
        return
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert lines(got) == lines(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
