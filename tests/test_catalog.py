"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

NAMES = [n for n in entry.queries() if n in entry.oracle_sql()]


def normal(df: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in sorted(df.columns):
        numbers = pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c])
        out[c] = df[c].astype(float).round(4).fillna(-9e99) if numbers else df[c].map(lambda x: "<null>" if x is None or x != x else str(x))
    return pd.DataFrame(out).sort_values(sorted(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for f in Path(tiny).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, tiny, name):
    got, want = entry.queries()[name](spark, tiny).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(normal(got), normal(want), check_dtype=False)


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "copies", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
