"""Every registered query against its SQL in DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from voltaspan.plans.catalog import CATALOG

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        return round(value, 3) + 0.0
    return tuple(map(plain, value)) if isinstance(value, list) else value


def rows(frame: pd.DataFrame):
    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.sql])
def test_query_matches_sql(spark, db, name):
    found = CATALOG[name].run(spark, str(SF)).toPandas()
    want = db.execute(CATALOG[name].sql).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found) == rows(want)


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if not q.sql])
def test_query_gives_rows(spark, name):
    assert CATALOG[name].run(spark, str(SF)).count() > 0
