"""Plan guards: the shapes that matter at scale, checked on every query."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

QUERIES = E.queries()
STREAMING = {n for n in QUERIES if n.startswith("stream_") or n in {"session_turns", "resume_exactly_once", "drain_once"}}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMING))
def test_no_cartesian_or_nested_loop(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_topk_plans_window_group_limit(spark):
    p = plan(QUERIES["knn_exact"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p
    assert "FlatMapCoGroupsInPandas" in p


def test_filter_and_pruning_reach_the_scan(spark):
    p = plan(QUERIES["start_latest"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts," in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in p


def test_partial_aggregation_before_shuffle(spark):
    p = plan(QUERIES["cdc_current_state"](spark, SF_SMALL))
    assert "partial_max_by" in p
