"""Each query against its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from roadlark.queries.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    return value if isinstance(value, (str, bool)) else round(float(value), 6)


def rows(table: pd.DataFrame) -> list:
    table = table[sorted(table.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in table.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, db, name):
    got, expected = QUERIES[name](spark, FOLDER).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
