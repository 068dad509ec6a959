"""Every registered query against its SQL in DuckDB on the smallest tables; the others at least run."""

import math
from pathlib import Path

import duckdb
import pytest

from lattica import evidence_queries, more_queries  # noqa: F401
from lattica.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(float(v)) if hasattr(v, "as_tuple") else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in SQL:
        assert got.columns
        return
    want = db.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(tuple(plain(r[c]) for c in sorted(got.columns)) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
