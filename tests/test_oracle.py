"""Every query of the drawing operators against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from plumbline.plans import catalog, oracle
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = oracle.ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        if pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float).round(6) + 0.0
    return df.astype(object).where(df.notna(), "").astype(str).sort_values(list(df.columns)).reset_index(drop=True)


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal_rows(spark, duck, name):
    pd.testing.assert_frame_equal(rows(catalog.QUERIES[name](spark, SF).toPandas()), rows(duck.execute(SQL[name]).df()))
