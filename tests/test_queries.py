"""Queries against their DuckDB SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from halyard.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(df):
    cols = sorted(df.columns)

    def text(x):
        if x is None or pd.isna(x):
            return "~"
        try:
            return str(x) if isinstance(x, (bool, str)) or type(x).__name__ == "bool_" else f"{float(x) + 0.0:.8g}"
        except (TypeError, ValueError):
            return str(x)[:10]

    return sorted(tuple(text(x) for x in r) for r in df[cols].itertuples(index=False)), cols


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_oracle(spark, duck, name):
    got, cols = rows_of(QUERIES[name](spark, SF).toPandas())
    want, names = rows_of(duck.execute(ORACLE_SQL[name]).fetchdf())
    assert cols == names and got == want


def test_contract():
    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(q) and "forecast_quantiles" in q and math.isfinite(len(q))
