"""Every job query against DuckDB on the smallest tables, and the contract of the entry module."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from jobweave import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda x: "NULL" if pd.api.types.is_scalar(x) and pd.isna(x) else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(show, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got, want = catalogue.queries()[name](spark, SF).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_runs(spark):
    assert len(__spark_entry__.entry(spark).collect()) > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
