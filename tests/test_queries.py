"""Every registered query with SQL gives the rows that DuckDB gives; the others run."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from plumbline import plans


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float | np.floating) and v != v:
        return None
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, float | np.floating | int | np.integer):
        return round(float(v), 8)
    return str(v)


def rows(df: pd.DataFrame, columns: list[str]) -> list[tuple]:
    return sorted((tuple(plain(v) for v in r) for r in df[columns].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_matches_sql(spark, sf, db, name):
    want = db.sql(plans.ORACLE[name]).df()
    got = plans.QUERIES[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_query_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["o_orderpriority", "n"]
