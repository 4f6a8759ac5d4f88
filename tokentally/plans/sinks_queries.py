"""Exports and console reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.operators import groups as G
from tokentally.operators import reports, rules
from tokentally.plans.binding import Tables
from tokentally.plans.filters_queries import IMPORTANT
from tokentally.plans.groups_queries import ROLLUP, STATS, shown, usd
from tokentally.plans.labels_queries import SOURCE
from tokentally.plans.oracle import compact_sql
from tokentally.plans.registry import query
from tokentally.plans.rules_queries import COVER, ISSUE_ROWS, sources
from tokentally.sources import sinks

HAVE = """id source_client source_app source_path repo_root repo_name title model input_tokens cached_input_tokens cache_write_tokens cache_write_5m cache_write_1h cache_write_30m cache_write_12h
output_tokens reasoning_tokens total_tokens token_aggregation_method token_confidence token_snapshot_count message_count duration_ms raw_event_count parse_status detected_surface user_prompt_count
assistant_message_count tool_call_count shell_command_count failed_tool_call_count non_zero_command_events important_command_failures harmless_non_zero_events exploratory_misses
repeated_failure_clusters command_issue_impact top_failure_type file_read_count file_edit_count session_outcome""".split()
ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.000Z')"


def _csv_sql() -> str:
    special = {
        "started_at": ISO.format("started_at"), "ended_at": ISO.format("ended_at"), "cost_micro": usd("cost_micro"), "warnings": "array_to_string(warnings, ';')",
    }
    return ", ".join(f'{column if column in HAVE else special.get(column, "NULL::VARCHAR")} AS "{name}"' for name, column in sinks.CSV_COLUMNS.items())


@query("export_csv", f"SELECT {_csv_sql()} FROM tt_sessions")
def _(t: Tables) -> DataFrame:
    return sinks.csv_rows(t.sessions)


TITLE = "CASE WHEN title IS NULL THEN 'Session ' || substr(id, 1, 8) ELSE regexp_replace(regexp_replace(title, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '\\s+', ' ', 'g') END"


@query("export_sessions_csv", f"""
SELECT repo_name AS repo, repo_root AS "repoRoot", {SOURCE} AS source, source_app AS app, {TITLE} AS session, id AS "sessionId", coalesce(model, 'Unknown') AS model,
  coalesce({ISO.format('started_at')}, '') AS "startedAt", duration_ms AS "durationMs", {usd('cost_micro')} AS "estimatedCostUsd", total_tokens AS "totalTokens", input_tokens AS "inputTokens",
  cached_input_tokens AS "cachedInputTokens", output_tokens AS "outputTokens", reasoning_tokens AS "reasoningTokens", message_count AS messages, user_prompt_count AS prompts,
  shell_command_count AS commands, {IMPORTANT} AS "commandIssues", coalesce(file_edit_count, 0) AS "fileEdits", session_outcome AS outcome, token_confidence AS "tokenConfidence" FROM tt_sessions""")
def _(t: Tables) -> DataFrame:
    return sinks.sessions_csv_rows(t.sessions)


@query("export_repos_csv", f"""
SELECT label AS repo, id AS "repoRoot", cost_usd AS "estimatedCostUsd", total_tokens AS "totalTokens", input_tokens AS "inputTokens", cached_input_tokens AS "cachedInputTokens",
  output_tokens AS "outputTokens", reasoning_tokens AS "reasoningTokens", session_count AS sessions, file_edit_count AS "fileEdits", failed_command_count AS "commandIssues",
  CASE WHEN tokens_per_edit IS NULL THEN 'No edits' ELSE {compact_sql('tokens_per_edit')} || ' tokens / edit' END AS "tokenRoi", replace(warnings, ';', '; ') AS warnings FROM ({ROLLUP})""")
def _(t: Tables) -> DataFrame:
    return sinks.repos_csv_rows(G.repo_rollup(t.sessions))


@query("export_json", """
SELECT id, '{"id":"' || id || '","source_client":"' || source_client || '"' || CASE WHEN model IS NULL THEN '' ELSE ',"model":"' || model || '"' END || ',"total_tokens":' || total_tokens
  || CASE WHEN cost_micro IS NULL THEN '' ELSE ',"cost_micro":' || cost_micro END || CASE WHEN file_edit_count IS NULL THEN '' ELSE ',"file_edit_count":' || file_edit_count END
  || ',"warnings":[' || coalesce(array_to_string(list_transform(warnings, lambda w: '"' || w || '"'), ','), '') || ']}' AS json FROM tt_sessions""")
def _(t: Tables) -> DataFrame:
    return sinks.json_rows(t.sessions.select("id", "source_client", "model", "total_tokens", "cost_micro", "file_edit_count", "warnings"))


@query("group_report", """
SELECT repo_name AS name, CASE WHEN sum(cost_micro) IS NULL THEN 'unknown' ELSE '$' || ((sum(cost_micro) + 50) // 100 // 10000) || '.' || lpad(((sum(cost_micro) + 50) // 100 % 10000)::VARCHAR, 4, '0') END AS cost,
  sum(total_tokens)::BIGINT AS tokens, count(*) AS sessions FROM tt_sessions GROUP BY repo_root, repo_name""")
def _(t: Tables) -> DataFrame:
    return sinks.group_report(G.sort_groups(G.by_repo(t.sessions)))


PCT = "(floor({}::DOUBLE / {} * 100 + 0.5)::BIGINT || '%{} (' || {} || '/' || {} || ')')"


def _pct(part: str, whole: str, word: str = "") -> str:
    return PCT.format(part, whole, word, part, whole)


@query("doctor_report", f"""WITH {COVER}
SELECT 'Sessions' AS metric, session_count::VARCHAR AS value FROM c UNION ALL SELECT 'Token data coverage', {_pct('token_data_sessions', 'session_count')} FROM c
UNION ALL SELECT 'Pricing coverage', {_pct('priced_token_sessions', 'token_data_sessions')} FROM c UNION ALL SELECT 'Repo grouping', {_pct('verified_repo_sessions', 'session_count', ' verified')} FROM c
UNION ALL SELECT 'Parse issues', greatest(pf, parse_sum)::VARCHAR FROM c UNION ALL SELECT 'Source warnings', source_warning_count::VARCHAR FROM c""")
def _(t: Tables) -> DataFrame:
    return sinks.doctor_metrics(rules.data_confidence(t.sessions, sources(t)))


@query("doctor_sources", f"""
SELECT CASE source WHEN 'codex' THEN 'Codex' WHEN 'claude' THEN 'Claude Code' WHEN 'copilot' THEN 'GitHub Copilot' WHEN 'cursor' THEN 'Cursor' END AS source, sessions_imported AS imported,
  session_file_count AS files, parse_failure_count AS parse_issues, CASE WHEN session_file_count > 0 THEN 'found' ELSE 'missing' END AS primary_data FROM {STATS}""")
def _(t: Tables) -> DataFrame:
    return sinks.doctor_sources(reports.source_stats(t.session_facts))


@query("scan_report", f"""
SELECT (SELECT string_agg(DISTINCT source_client, ';' ORDER BY source_client) FROM tt_sessions) AS sources, count(*) AS session_count, {usd('sum(cost_micro)')} AS cost_usd,
  sum(total_tokens)::BIGINT AS total_tokens, count(DISTINCT repo_root) AS repo_count FROM tt_sessions""")
def _(t: Tables) -> DataFrame:
    return shown(sinks.scan_report(G.summarize(t.sessions), reports.source_stats(t.session_facts)))
