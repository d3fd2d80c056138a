"""Queries against their SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from sheetwise.plans.oracles import ORACLE_SQL
from sheetwise.plans.queries import QUERIES

DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DIR.exists(), reason="needs the test tables")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "None"
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DIR.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, str(DIR))
    columns = sorted(df.columns)
    ours = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=str)
    theirs = con.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert ours == sorted((tuple(map(plain, r)) for r in theirs), key=str)
