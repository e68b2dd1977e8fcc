"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import pandas as pd
import pytest

from centavo.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"create view {name} as from '{SF}/{name}.parquet'")
    return con


def cell(value):
    if value is None or (not isinstance(value, (list, tuple)) and pd.isna(value)):
        return None
    if isinstance(value, (pd.Timestamp, datetime.datetime, datetime.date)):
        return str(value)[:10]
    if isinstance(value, (bool, str)):
        return str(value)
    return f"{decimal.Decimal(str(value)):.6f}"


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(map(str, ([cell(v) for v in row] for row in frame[columns].astype(object).values.tolist())))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
