"""Every registered query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = entry.queries()[name](spark, SF).toArrow()
    want = duck.execute(entry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    rows = lambda t: sorted(zip(*(map(str, t[c].to_pylist()) for c in sorted(t.column_names))))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 50
