"""Every query of the catalogue against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from loomspark.operators.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    shown = lambda x: round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x).removesuffix(" 00:00:00")
    return sorted((tuple(map(shown, r)) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        p = f"{DATA}/{name}"
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got, want = QUERIES[name].run(spark, DATA).toPandas(), duck.execute(QUERIES[name].sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
