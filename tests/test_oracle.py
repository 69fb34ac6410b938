"""Every registered job with oracle SQL equals DuckDB on the small driver tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from civlens.sources.tables import TABLES

SF_SMALL = "/root/testdata/sf0.001"

SQL = E.oracle_sql()


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, con, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = con.sql(SQL[name]).df()
    c1, r1 = _rows(got)
    c2, r2 = _rows(want)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["year", "count", "count_previous_year", "perc_diff"]
    assert df.count() > 0


def test_every_registered_name_is_unique_and_documented():
    from civlens.plans import catalog

    catalog.load_all()
    assert len(catalog.QUERIES) >= 90
    assert all(catalog.DESCRIPTIONS[n] for n in catalog.QUERIES)
