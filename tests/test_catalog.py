"""Registered queries against their SQL. CATALOG=all runs every query, the default a cross-section."""

import os
import re

import pytest

import __spark_entry__ as entry
from check_queries import TABLES, rows_of
from turnledger.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
CROSS_SECTION = [
    "daily_rollup", "dedup_last_wins", "price_resolution", "session_rollup", "anchored_windows", "project_rollup", "cwd_labels",
    "skill_breakdown", "turn_tools", "tool_error_storm", "reinflation_cycles", "timeline_daily_projects", "search_text", "parsed_responses",
    "history_forget_age", "stream_hourly", "block_sizes", "malformed_lines", "project_scorecard", "model_by_tool",
]
NAMES = sorted(QUERIES) if os.environ.get("CATALOG") == "all" else CROSS_SECTION

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_its_sql_gives(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # No pair-wise joins, and no rows through Python.
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|EvalPython|InPandas|InArrow", plan)
    want = con.sql(entry.oracle_sql()[name])
    got, names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    expected, expected_names = rows_of(want.columns, want.fetchall())
    assert names == expected_names and got == expected


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_filters_and_columns_reach_the_scan(spark):
    from turnledger.catalog.shapes import Tables
    from turnledger.operators import series

    turns = Tables(spark, FOLDER).turns
    plan = series.daily(turns, "2024-01-10", "2024-01-11")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", plan)
    assert "tool_names" not in plan and "stop_reason" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
