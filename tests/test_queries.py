"""Every registered query with SQL, against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from loomflow.plans import catalog, catalog_exploratory  # noqa: F401

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    frame = frame[cols].astype(object).where(frame[cols].notna(), None)
    return cols, sorted(str(tuple(r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = rows(catalog.QUERIES[name](spark, FOLDER).toPandas()), rows(duck.execute(catalog.ORACLES[name]).df())
    assert got[0] == want[0] and len(want[1]) > 0
    assert got[1] == want[1]


def test_portfolios_do_not_depend_on_the_name_of_the_folder(spark, tmp_path):
    other = tmp_path / "sf0.001"
    other.symlink_to("/root/testdata/sf0.01")
    assert rows(catalog.QUERIES["portfolios"](spark, str(other)).toPandas()) == rows(catalog.QUERIES["portfolios"](spark, FOLDER).toPandas())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["time_range_scan"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<ts:timestamp_ntz,value:double>" in plan
