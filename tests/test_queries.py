"""Every point-cloud query against its SQL, at the smallest scale."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from orbweave import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    columns = sorted(frame.columns)
    return sorted(str(tuple(None if pd.isna(v) else float(v) if isinstance(v, float) else v for v in r)) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, duck, sf_dir, name):
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    got = {r["k"]: r["v"] for r in __spark_entry__.entry(spark).collect()}
    assert sorted(got) == list(range(16)) and got[15] == 1.0
