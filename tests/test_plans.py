"""Properties every registered query's physical plan must have."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from kindred.catalog import REGISTRY

BATCH = [name for name in sorted(REGISTRY) if not name.startswith("t0")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_joins_and_no_row_at_a_time_python(name, spark, sf_dir):
    text = plan(entry.queries()[name](spark, sf_dir))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "Scan ExistingRDD"):
        assert operator not in text, operator


def test_trailing_window_is_pushed_and_columns_are_pruned(spark, sf_dir):
    text = plan(entry.queries()["a01_recent_counts"](spark, sf_dir))
    assert "GreaterThanOrEqual(ts,2024-01-24T00:00)" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,props:string>" in text


def test_messages_are_parsed_once(spark, sf_dir):
    for name in ("s04_change_event_source", "s09_pattern_subscribe"):
        text = plan(entry.queries()[name](spark, sf_dir))
        assert text.count("from_json(") == 1 and "parse_json" not in text


def test_ranking_moves_no_vectors(spark, sf_dir):
    text = plan(entry.queries()["j06_similarity_join"](spark, sf_dir))
    for line in text.splitlines():
        if "WindowGroupLimit" in line or "Window [" in line:
            assert "vector" not in line


def test_running_balance_shuffles_the_ledger_once(spark, sf_dir):
    text = plan(entry.queries()["w06_running_balance"](spark, sf_dir))
    assert text.count("Exchange hashpartitioning") == 1
