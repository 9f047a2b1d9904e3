"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from swinglake.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or hasattr(v, "dtype") and v.dtype == bool:
        return bool(v)
    return float(v) if isinstance(v, (int, float)) or hasattr(v, "item") else v


def rows(df: pd.DataFrame, columns: list[str]) -> list[tuple]:
    return sorted((tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf, duck, name):
    got, expected = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert sorted(expected.columns) == columns
    assert rows(got, columns) == rows(expected, columns)


def test_flagship():
    assert FLAGSHIP in QUERIES
