"""Registered queries against DuckDB, and invariants between them, at the smallest scale."""

import pytest

from oracle import compare, connect
from tokentally.plans import registry

SF = "/root/testdata/sf0.001"
registry.load()
SAMPLE = [
    "request_cost", "session_cost", "group_by_repo", "group_by_model", "summarize", "project_model_filter", "cost_outliers", "health_signals", "data_confidence",
    "key_insights", "pricing_gap_summary", "model_usage", "sessions_to_review", "repo_rank", "token_method_confidence", "drop_stale_snapshots", "message_counts",
    "command_issue_rollup", "split_by_day_model", "merge_fragments", "merge_duplicate_sessions", "thread_to_log", "repo_identity", "savings_summary", "export_csv",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    assert compare(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name]) == []


def test_every_query_has_a_twin():
    assert sorted(set(registry.QUERIES) - set(registry.ORACLES)) == []


def test_groups_add_up_to_the_summary(spark):
    def rows(name):
        return [r.asDict() for r in registry.QUERIES[name](spark, SF).collect()]

    whole = rows("summarize")[0]
    for name in ("group_by_repo", "group_by_app", "group_by_day", "group_by_hour"):
        groups = rows(name)
        assert sum(g["total_tokens"] for g in groups) == whole["total_tokens"]
        assert sum(g["session_count"] for g in groups) == whole["session_count"]
        assert sum(g["known_cost_sessions"] + g["unknown_cost_sessions"] for g in groups) == whole["session_count"]
        assert sum(round((g["cost_usd"] or 0) * 1e6) for g in groups) == round(whole["cost_usd"] * 1e6)
