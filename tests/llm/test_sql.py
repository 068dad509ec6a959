"""The training-data queries that have SQL, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from lattica.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, db, name):
    got = queries.queries()[name](spark, SF)
    want = db.sql(queries.oracle_sql()[name])
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
