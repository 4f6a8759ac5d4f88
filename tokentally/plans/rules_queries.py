"""Health, waste, insight and confidence rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.operators import groups as G
from tokentally.operators import pricing, reports, rules
from tokentally.plans.binding import Tables
from tokentally.plans.filters_queries import IMPORTANT, WASTE, WASTE_SQL
from tokentally.plans.groups_queries import SUMMARY, VISIBLE, usd
from tokentally.plans.oracle import compact_sql, count_sql, money_sql, percent_sql
from tokentally.plans.registry import query

VIEW = f"{VISIBLE} AND source_client <> 'cursor'"
FLAGS = {
    "command_issue": f"{IMPORTANT} > 0", "no_code": "file_edit_count = 0", "unknown_surface": "detected_surface = 'unknown'",
    "parse_failure": "(parse_status = 'failed' OR parse_error_count > 0)", "unknown_cost": "cost_micro IS NULL", "any_session": "true",
    "output_heavy": "output_tokens::DOUBLE / greatest(total_tokens, 1) > 0.35", "unverified": "list_contains(warnings, 'repo_unverified_no_git_root')",
}
SUMS = ["input_tokens", "cached_input_tokens", "output_tokens", "total_tokens", "shell_command_count", "important_command_failures", "failed_tool_call_count", "file_edit_count"]
FACTS = f"""f AS (SELECT (SELECT count(*) FROM tt_sessions WHERE {VISIBLE}) AS scan_n, (SELECT count(*) FROM tt_sessions WHERE NOT {VISIBLE}) AS scan_zero,
  (SELECT count(DISTINCT repo_root) FROM tt_sessions WHERE {VISIBLE}) AS scan_repos, (SELECT count(DISTINCT source_app) FROM tt_sessions WHERE {VISIBLE}) AS scan_apps,
  count(*) AS n, {', '.join(f'coalesce(sum({s}), 0)::BIGINT AS {s}' for s in SUMS)}, count(*) FILTER (WHERE coalesce(file_edit_count, 0) = 0) AS no_code_change,
  coalesce(sum(cost_micro), 0)::BIGINT AS cost, max(cost_micro) AS top_cost, arg_min(id, -cost_micro) AS top_id,
  {', '.join(f'count(*) FILTER (WHERE {sql}) AS n_{name}' for name, sql in FLAGS.items())} FROM tt_sessions WHERE {VIEW})"""


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b})::DOUBLE ELSE 0 END"


FAILED = "(CASE WHEN important_command_failures > 0 THEN important_command_failures ELSE failed_tool_call_count END)"
CACHED = _ratio("cached_input_tokens", "input_tokens")
PER_EDIT = "round(total_tokens::DOUBLE / file_edit_count)::BIGINT"
HEALTH = [
    ("repo-grouping", "Repo grouping is working", "good", "scan_repos > 0", count_sql("scan_n", "session"), "0", False),
    ("app-attribution", "App attribution is visible", "good", "scan_apps > 1", count_sql("scan_apps", "app"), "0", False),
    ("priced-sessions", "All loaded sessions are priced", "good", "n_unknown_cost = 0 AND n > 0", compact_sql("n") + " || ' priced'", "0", False),
    ("cache-reuse", "Cache reuse is strong", "good", f"{CACHED} >= 0.75", percent_sql("cached_input_tokens", "input_tokens"), "0", False),
    ("token-roi-measurable", "Token ROI can be measured", "good", "file_edit_count > 0 AND total_tokens > 0", count_sql(PER_EDIT, "token") + " || ' / edit'", "0", False),
    ("empty-filter", "No sessions in this view", "attention", "n = 0", "''", "0", False),
    ("command-friction", "Possible failed command rate looks high", "attention", f"{_ratio(FAILED, 'shell_command_count')} > 0.2", percent_sql(FAILED, "shell_command_count"), "n_command_issue", False),
    ("no-code-sessions", "Many sessions have no detected edits", "attention", f"{_ratio('no_code_change', 'n')} > 0.5 AND n >= 3", percent_sql("no_code_change", "n"), "n_no_code", False),
    ("unknown-surfaces", "Some surfaces are unknown", "attention", "n_unknown_surface > 0", count_sql("n_unknown_surface", "session"), "n_unknown_surface", False),
    ("parse-failures", "Some session files parsed partially", "attention", "n_parse_failure > 0", count_sql("n_parse_failure", "issue"), "n_parse_failure", True),
    ("unknown-cost", "Some sessions cannot be priced", "attention", "n_unknown_cost > 0", count_sql("n_unknown_cost", "session"), "n_unknown_cost", True),
    ("low-cache", "Cache rate could be better", "attention", f"input_tokens > 0 AND {CACHED} < 0.5", percent_sql("cached_input_tokens", "input_tokens"), "n_any_session", False),
    ("output-heavy", "Output-heavy sessions are driving tokens", "attention", f"{_ratio('output_tokens', 'total_tokens')} > 0.35", percent_sql("output_tokens", "total_tokens"), "n_output_heavy", False),
    ("cost-concentration", "Spend is concentrated in one session", "attention", f"{_ratio('top_cost', 'cost')} > 0.35", percent_sql("top_cost", "cost"), "1", False),
    ("unverified-repos", "Some repos are unverified", "attention", "n_unverified > 0", count_sql("n_unverified", "session"), "n_unverified", False),
    ("zero-token-skipped", "Zero-token placeholders were skipped", "attention", "scan_zero > 0", compact_sql("scan_zero") + " || ' skipped'", "0", False),
]
HEALTH_ROWS = " UNION ALL ".join(
    f"SELECT '{i}' AS id, '{title}' AS title, '{tone}' AS tone, {str(critical).lower()} AS critical, {metric} AS metric, ({affected})::BIGINT AS affected_sessions FROM f WHERE {fires}"
    for i, title, tone, fires, metric, affected, critical in HEALTH
)
POINTED = {
    "command-friction": "command_issue", "no-code-sessions": "no_code", "unknown-surfaces": "unknown_surface", "parse-failures": "parse_failure",
    "unknown-cost": "unknown_cost", "low-cache": "any_session", "output-heavy": "output_heavy", "unverified-repos": "unverified",
}
AFFECTED = " UNION ALL ".join(
    [f"SELECT '{i}' AS signal, id FROM tt_sessions WHERE {VIEW} AND {FLAGS[POINTED[i]]} AND (SELECT {fires} FROM f)" for i, _, _, fires, *_ in HEALTH if i in POINTED]
    + [f"SELECT 'cost-concentration', top_id FROM f WHERE {[h[3] for h in HEALTH if h[0] == 'cost-concentration'][0]}"]
)


def in_view():
    return F.col("source_client") != "cursor"


@query("health_signals", f"WITH {FACTS} {HEALTH_ROWS}")
def _(t: Tables) -> DataFrame:
    return rules.health_signals(t.sessions, in_view())


@query("affected_sessions", f"WITH {FACTS} {AFFECTED}")
def _(t: Tables) -> DataFrame:
    return rules.health_affected(t.sessions, in_view())


@query("health_counts", f"""WITH {FACTS}, h AS ({HEALTH_ROWS}), a AS ({AFFECTED})
SELECT count(*) FILTER (WHERE tone = 'good') AS healthy_count, count(*) FILTER (WHERE tone = 'attention') AS attention_count, count(*) FILTER (WHERE critical) AS critical_count,
  (SELECT count(DISTINCT id) FROM a) AS affected_session_count FROM h""")
def _(t: Tables) -> DataFrame:
    return rules.health_counts(t.sessions, in_view())


TITLES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.WASTE_TITLES.items())


@query("waste_signals", f"SELECT id, CASE id {TITLES} END AS title, {count_sql('sessions', 'session')} AS value, 'attention' AS tone, sessions FROM ({WASTE_SQL}) WHERE sessions > 0")
def _(t: Tables) -> DataFrame:
    return rules.waste_signals(t.sessions)


@query("waste_affected", " UNION ALL ".join(f"SELECT '{name}' AS signal, id FROM tt_sessions WHERE {sql}" for name, sql in WASTE.items()))
def _(t: Tables) -> DataFrame:
    return rules.waste_affected(t.sessions)


@query("key_insights", f"""
WITH r AS (SELECT repo_root, min(repo_name) AS label, sum(total_tokens)::BIGINT AS tokens, sum(cost_micro)::BIGINT AS cost FROM tt_sessions GROUP BY 1),
a AS (SELECT source_app AS label, sum(total_tokens)::BIGINT AS tokens, sum(cost_micro)::BIGINT AS cost FROM tt_sessions GROUP BY 1),
g AS (SELECT count(*) FILTER (WHERE coalesce(file_edit_count, 0) = 0) AS no_edit, sum(input_tokens)::BIGINT AS i, sum(cached_input_tokens)::BIGINT AS c, max(cost_micro) AS top FROM tt_sessions)
SELECT 'Most-used repo' AS label, label || ' used the most tokens in this period.' AS text, {count_sql('tokens', 'token')} AS metric, 'neutral' AS tone FROM (SELECT * FROM r ORDER BY tokens DESC, coalesce(cost, 0) DESC, repo_root LIMIT 1)
UNION ALL SELECT 'Highest API-equivalent cost', label || ' had the highest estimated API-equivalent cost.', {money_sql('cost')}, 'attention' FROM (SELECT * FROM r WHERE cost IS NOT NULL ORDER BY cost DESC, tokens DESC, repo_root LIMIT 1)
UNION ALL SELECT 'No-edit sessions', {count_sql('no_edit', 'session')} || ' used tokens without detected file edits.', {count_sql('no_edit', 'session')}, 'attention' FROM g WHERE no_edit > 0
UNION ALL SELECT 'Most-used app', label || ' accounts for most detected local Codex usage.', {count_sql('tokens', 'token')}, 'neutral' FROM (SELECT * FROM a ORDER BY coalesce(cost, 0) DESC, tokens DESC, label LIMIT 1)
UNION ALL SELECT 'Cache reuse', 'Cached input represents ' || {percent_sql('c', 'i')} || ' of input tokens.', {percent_sql('c', 'i')}, CASE WHEN c::DOUBLE / i >= 0.5 THEN 'good' ELSE 'attention' END FROM g
UNION ALL SELECT 'Session to inspect', 'The most expensive session was ' || {money_sql('top')} || ' API-equivalent.', {money_sql('top')}, 'attention' FROM g""")
def _(t: Tables) -> DataFrame:
    return rules.key_insights(t.sessions)


STATS_SQL = """(SELECT source_client, count(*) AS imported, count(*) FILTER (WHERE parse_status = 'failed' OR parse_error_count > 0) AS parse, count(*) FILTER (WHERE parse_status = 'failed') AS warns FROM tt_sessions GROUP BY 1)"""
COVER = f"""c AS (SELECT count(*) AS raw_n, count(*) FILTER (WHERE {VISIBLE}) AS session_count, count(*) FILTER (WHERE total_tokens > 0) AS token_data_sessions,
  count(*) FILTER (WHERE {VISIBLE} AND (total_tokens = 0 OR list_contains(warnings, 'missing_token_breakdown'))) AS missing_token_sessions,
  count(*) FILTER (WHERE total_tokens > 0 AND cost_micro IS NOT NULL) AS priced_token_sessions, count(*) FILTER (WHERE total_tokens > 0 AND cost_micro IS NULL) AS unpriced_token_sessions,
  count(*) FILTER (WHERE total_tokens > 0 AND token_confidence = 'high') AS high_confidence_token_sessions,
  count(*) FILTER (WHERE {VISIBLE} AND NOT list_contains(warnings, 'repo_unverified_no_git_root')) AS verified_repo_sessions,
  count(*) FILTER (WHERE {VISIBLE} AND list_contains(warnings, 'repo_unverified_no_git_root')) AS unknown_repo_sessions,
  count(*) FILTER (WHERE {VISIBLE} AND coalesce(detected_surface, 'unknown') = 'unknown') AS unknown_surface_sessions,
  count(*) FILTER (WHERE {VISIBLE} AND (parse_status = 'failed' OR parse_error_count > 0)) AS pf,
  (SELECT count(*) FROM {STATS_SQL}) AS source_count, (SELECT sum(imported) FROM {STATS_SQL}) AS imported, (SELECT sum(parse)::BIGINT FROM {STATS_SQL}) AS parse_sum,
  (SELECT sum(warns)::BIGINT FROM {STATS_SQL}) AS source_warning_count FROM tt_sessions)"""


def sources(t: Tables) -> DataFrame:
    """Source status rows; failed files stand for discovery warnings."""
    return reports.source_stats(t.sessions).withColumn("available", F.lit(True)).withColumnRenamed("malformed_file_count", "warning_count")


@query("data_confidence", f"""WITH {COVER}
SELECT *, CASE WHEN score >= 80 THEN 'High' WHEN score >= 55 THEN 'Medium' ELSE 'Low' END AS label FROM (
SELECT session_count, token_data_sessions, missing_token_sessions, priced_token_sessions, unpriced_token_sessions, high_confidence_token_sessions, verified_repo_sessions, unknown_repo_sessions,
  unknown_surface_sessions, source_count, greatest(pf, parse_sum) AS parse_issue_count, source_warning_count, td AS token_data_pct, pc AS pricing_coverage_pct, hc AS high_confidence_token_pct, vr AS verified_repo_pct,
  floor(100.0::DOUBLE * (td * 0.3::DOUBLE + pc * 0.25::DOUBLE + vr * 0.18::DOUBLE + hc * 0.12::DOUBLE + greatest(1.0::DOUBLE - greatest(pf, parse_sum)::DOUBLE / raw_n::DOUBLE, 0) * 0.15::DOUBLE) + 0.5)::BIGINT AS score
FROM (SELECT *, token_data_sessions::DOUBLE / session_count AS td, priced_token_sessions::DOUBLE / token_data_sessions AS pc, high_confidence_token_sessions::DOUBLE / token_data_sessions AS hc,
  verified_repo_sessions::DOUBLE / session_count AS vr FROM c))""")
def _(t: Tables) -> DataFrame:
    return rules.data_confidence(t.sessions, sources(t))


ISSUES = [
    ("missing-token-data", "Some sessions are missing token data", "missing_token_sessions > 0", "missing_token_sessions"),
    ("unpriced-token-sessions", "Some token-bearing sessions are unpriced", "unpriced_token_sessions > 0", "unpriced_token_sessions"),
    ("parse-issues", "Parser issues detected", "greatest(pf, parse_sum) > 0", "pf"),
    ("unknown-repo-grouping", "Some repo grouping is unverified", "unknown_repo_sessions > 0", "unknown_repo_sessions"),
    ("unknown-surfaces", "Some app surfaces are unknown", "unknown_surface_sessions > 0", "unknown_surface_sessions"),
    ("source-warnings", "Source warnings were reported", "source_warning_count > 0", "0::BIGINT"),
]
ISSUE_ROWS = " UNION ALL ".join(f"SELECT '{i}' AS id, '{title}' AS title, 'attention' AS tone, {n} AS affected_sessions FROM c WHERE {fires}" for i, title, fires, n in ISSUES)


@query("confidence_issues", f"WITH {COVER} {ISSUE_ROWS}")
def _(t: Tables) -> DataFrame:
    return rules.confidence_issues(t.sessions, sources(t))


@query("overview_kpis", f"""
SELECT total_tokens, cost_usd, session_count, repo_count, model_count, cached_input_pct, {_ratio('important_command_failures', 'shell_command_count')} AS command_issue_rate FROM ({SUMMARY})""")
def _(t: Tables) -> DataFrame:
    row = G.summarize(t.sessions)
    return row.select(
        "total_tokens", pricing.micro_to_usd(F.col("cost_micro")).alias("cost_usd"), "session_count", "repo_count", "model_count", "cached_input_pct",
        G.ratio(F.col("important_command_failures"), F.col("shell_command_count")).alias("command_issue_rate"),
    )
