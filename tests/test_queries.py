"""Registered queries against their SQL at the smallest scale, whole and in small chunks; plan checks."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from check import compare
from tests.conftest import SF

# one or two queries of each group; check.py runs all of them
SAMPLE = (
    "a01_explode_lines", "b03_silent_gaps", "b14_env_settings", "c03_classify_stateful", "c04_stage_markers", "c15_invocations", "c18_command_context",
    "d04_errors_full_scan", "d11_reconcile_primary", "e01_blame_command", "e09_find_similar", "f03_inline_snippets", "g09_focused_log",
    "h02_dedupe_examples", "j08_best_iteration", "j18_findings", "k04_tool_issues", "e17_call_chain", "l07_doc_errors", "m02_stream_dedupe", "m07_stream_to_queue",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(small_chunks, con, name):
    status, note, _ = compare(small_chunks, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert status == "ok", note


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["a03_scan_index"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan
    plan = entry.queries()["f08_test_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan


def test_no_window_over_a_whole_build(spark):
    """Windows over log lines are cut by chunk; only summaries and ranked heads span a build."""
    plan = entry.queries()["c03_classify_stateful"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    windows = [row for row in plan.split("\n") if "Window [" in row and re.search(r"\(_in_\w+#", row)]
    assert windows and all("_b#" in row for row in windows)
