"""The operators over literal inputs, each against the rows that its case states."""

import literal_runs
import pandas as pd
import pytest
from literal_cases import SQL, QUERIES

duckdb = pytest.importorskip("duckdb")


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    cell = lambda v: "NULL" if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


def test_both_modules_have_their_cases():
    assert literal_runs.QUERIES is QUERIES and len(QUERIES) == len(SQL) > 100


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_case(spark, name):
    got, want = QUERIES[name](spark, "").toPandas(), duckdb.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
