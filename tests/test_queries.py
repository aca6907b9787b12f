"""Every registered query of the library against its SQL, on the smallest tables."""
import os

import duckdb
import pandas as pd
import pytest

from shelfmark import plans

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = plans.collect()


def rows(df: pd.DataFrame) -> list:
    def shown(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float):  # pandas shows whole numbers beside nulls as floats
            return str(int(v)) if v.is_integer() else repr(round(float(v), 6))
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(shown, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, FOLDER).toPandas()) == rows(duck.execute(ORACLE[name]).fetchdf())


def test_every_query_is_named_once_and_most_have_sql():
    assert ORACLE.keys() <= QUERIES.keys()
    assert QUERIES.keys() - ORACLE.keys() == {"daily_stable_shuffle", "detector_consensus"}
