"""Usage sums: by repo, model, app, day, hour, and over everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.functions import text
from tokentally.operators import groups as G
from tokentally.operators import pricing, reports, sorts
from tokentally.plans.binding import Tables
from tokentally.plans.registry import query

TOKENS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in G.TOKENS)
COUNTS = "count(cost_micro) AS known_cost_sessions, count(*) - count(cost_micro) AS unknown_cost_sessions"


def usd(micro: str) -> str:
    return f"CAST({micro} AS DOUBLE) / 1000000.0"


def warnings_of(table: str, key: str) -> str:
    """(key, text) of the distinct warnings of a group."""
    return f"""(SELECT k, string_agg(w, ';' ORDER BY w) AS warnings FROM (SELECT DISTINCT {key} AS k, unnest(warnings) AS w FROM {table}) GROUP BY k)"""


def group_sql(key: str, label: str, table: str = "tt_sessions", extra: str = "", outer: str = "") -> str:
    return f"""
    SELECT g.* EXCLUDE (cost_micro), {usd('cost_micro')} AS cost_usd, coalesce(w.warnings, '') AS warnings {outer}
    FROM (SELECT {key} AS id, min({label}) AS label, sum(cost_micro)::BIGINT AS cost_micro, {COUNTS}, {TOKENS},
        count(*) AS session_count, sum(message_count)::BIGINT AS message_count {extra}
      FROM {table} GROUP BY 1) g
    LEFT JOIN {warnings_of(table, key)} w ON w.k = g.id"""


def shown(groups: DataFrame) -> DataFrame:
    """Costs in USD, warning sets as text."""
    out = groups
    if "cost_micro" in out.columns:
        out = out.withColumn("cost_usd", pricing.micro_to_usd(F.col("cost_micro"))).drop("cost_micro")
    if "warnings" in out.columns:
        out = out.withColumn("warnings", F.array_join("warnings", ";"))
    return out


@query("group_by_repo", group_sql("repo_root", "repo_name", extra=", bool_or(NOT list_contains(warnings, 'repo_unverified_no_git_root')) AS verified"))
def _(t: Tables) -> DataFrame:
    return shown(G.sort_groups(G.by_repo(t.sessions)))


@query("group_by_app", group_sql("source_app", "source_app"))
def _(t: Tables) -> DataFrame:
    return shown(G.sort_groups(G.by_app(t.sessions)))


@query("sort_groups", f"""SELECT source_app AS id, {usd('sum(cost_micro)::BIGINT')} AS cost_usd, sum(total_tokens)::BIGINT AS total_tokens,
  row_number() OVER (ORDER BY coalesce(sum(cost_micro), 0) DESC, sum(total_tokens) DESC, source_app) - 1 AS position FROM tt_sessions GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return shown(sorts.with_position(G.sort_groups(G.by_app(t.sessions)).select("id", "cost_micro", "total_tokens")))


@query("group_by_day", group_sql("coalesce(strftime(started_at, '%Y-%m-%d'), 'unknown-date')", "coalesce(strftime(started_at, '%Y-%m-%d'), 'unknown-date')"))
def _(t: Tables) -> DataFrame:
    return shown(G.sort_groups(G.by_day(t.sessions)))


HOUR = "coalesce(strftime(started_at, '%Y-%m-%dT%H:00:00.000Z'), 'unknown-hour')"


@query("group_by_hour", group_sql(HOUR, HOUR))
def _(t: Tables) -> DataFrame:
    return shown(G.sort_groups(G.by_hour(t.sessions)))


ZEROED = ", ".join(f"0::BIGINT AS {c}" if c in ("cache_write_5m", "cache_write_1h") else f"l.{c}" for c in G.TOKENS)
SLICED = f"""(SELECT coalesce(l.model, 'unknown-model') AS mid, l.cost_micro, {ZEROED}, s.message_count, s.warnings, s.id, s.repo_root, s.repo_name, s.started_at, s.ended_at
  FROM tt_slices l JOIN tt_sessions s ON s.id = l.session_id
  UNION ALL SELECT coalesce(model, 'unknown-model'), cost_micro, {', '.join(G.TOKENS)}, message_count, warnings, id, repo_root, repo_name, started_at, ended_at FROM tt_sessions
  WHERE id NOT IN (SELECT session_id FROM tt_slices))"""


@query("group_by_model", group_sql("mid", "CASE WHEN mid = 'unknown-model' THEN 'Model not recorded' ELSE mid END", SLICED))
def _(t: Tables) -> DataFrame:
    return shown(G.sort_groups(G.by_model(t.sessions)))


SIGNAL_SUMS = ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in G.SIGNALS)
SUMMARY = f"""
  SELECT {usd('sum(cost_micro)')} AS cost_usd, {COUNTS}, {TOKENS}, {SIGNAL_SUMS}, count(*) AS session_count,
    count(DISTINCT repo_root) AS repo_count, count(*) FILTER (WHERE parse_status = 'failed' OR parse_error_count > 0) AS parse_failure_count,
    count(*) FILTER (WHERE detected_surface = 'unknown') AS unknown_surface_sessions,
    count(*) FILTER (WHERE coalesce(file_edit_count, 0) = 0) AS no_code_change_sessions,
    count(*) FILTER (WHERE session_outcome = 'research_only') AS research_only_sessions,
    CASE WHEN sum(input_tokens) > 0 THEN sum(cached_input_tokens)::BIGINT::DOUBLE / sum(input_tokens)::BIGINT::DOUBLE ELSE 0 END AS cached_input_pct,
    (SELECT string_agg(w, ';' ORDER BY w) FROM (SELECT DISTINCT unnest(warnings) AS w FROM tt_sessions)) AS warnings,
    (SELECT count(DISTINCT model) FROM tt_slices) AS model_count,
    (SELECT repo_root FROM tt_sessions GROUP BY repo_root HAVING count(cost_micro) > 0 ORDER BY sum(cost_micro) DESC, sum(total_tokens) DESC, repo_root LIMIT 1) AS most_expensive_repo
  FROM tt_sessions"""


@query("summarize", SUMMARY)
def _(t: Tables) -> DataFrame:
    return shown(G.summarize(t.sessions))


ROI = "CASE WHEN file_edit_count > 0 THEN round(total_tokens::DOUBLE / file_edit_count::DOUBLE)::BIGINT END"
ROLLUP = f"""
  SELECT g.* EXCLUDE (cost_micro, no_edit_high, failed), {usd('cost_micro')} AS cost_usd, {ROI} AS tokens_per_edit,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(w.list, []), list_filter([
      CASE WHEN no_edit_high THEN 'high-token no-edit' END, CASE WHEN failed THEN 'command issues' END,
      CASE WHEN cost_micro IS NULL AND total_tokens > 0 THEN 'unknown pricing' END,
      CASE WHEN input_tokens > 0 AND cached_input_tokens::DOUBLE / input_tokens::DOUBLE < 0.1 THEN 'low cache rate' END], lambda x: x IS NOT NULL)))), ';') AS warnings
  FROM (SELECT repo_root AS id, min(repo_name) AS label, sum(cost_micro)::BIGINT AS cost_micro, {COUNTS}, {TOKENS}, count(*) AS session_count,
      sum(message_count)::BIGINT AS message_count, bool_or(NOT list_contains(warnings, 'repo_unverified_no_git_root')) AS verified,
      coalesce(sum(file_edit_count), 0)::BIGINT AS file_edit_count,
      sum(coalesce(important_command_failures, failed_tool_call_count, 0))::BIGINT AS failed_command_count,
      bool_or(coalesce(file_edit_count, 0) = 0 AND total_tokens >= 1000000) AS no_edit_high,
      bool_or(coalesce(important_command_failures, failed_tool_call_count, 0) > 0) AS failed
    FROM tt_sessions GROUP BY 1) g
  LEFT JOIN (SELECT k, list(w) AS list FROM (SELECT DISTINCT repo_root AS k, unnest(warnings) AS w FROM tt_sessions) GROUP BY k) w ON w.k = g.id"""


@query("repo_rollup", ROLLUP)
def _(t: Tables) -> DataFrame:
    return shown(G.sort_groups(G.repo_rollup(t.sessions)))


VISIBLE = "(total_tokens > 0 OR source_client IN ('claude', 'cursor', 'copilot'))"
STATS = """(SELECT source_client AS source, count(DISTINCT source_path) AS session_file_count, count(*) AS sessions_imported,
    count(*) FILTER (WHERE parse_status = 'failed' OR parse_error_count > 0) AS parse_failure_count,
    count(*) FILTER (WHERE parse_status = 'failed') AS malformed_file_count,
    strftime(max(ended_at), '%Y-%m-%dT%H:%M:%S.000Z') AS last_scanned_at FROM tt_sessions GROUP BY 1)"""


@query("source_stats", f"SELECT * FROM {STATS}")
def _(t: Tables) -> DataFrame:
    return reports.source_stats(t.sessions)


@query("scan_overview", f"""
SELECT count(*) FILTER (WHERE {VISIBLE}) AS session_count, count(*) FILTER (WHERE NOT {VISIBLE}) AS zero_token_session_count,
  count(DISTINCT CASE WHEN {VISIBLE} THEN repo_root END) AS repo_count, count(DISTINCT CASE WHEN {VISIBLE} THEN source_app END) AS source_app_count,
  (SELECT count(DISTINCT m) FROM (SELECT coalesce(l.model, 'unknown-model') AS m FROM tt_slices l JOIN tt_sessions s ON s.id = l.session_id WHERE {VISIBLE.replace('total', 's.total')}
     UNION ALL SELECT 'unknown-model' FROM tt_sessions WHERE {VISIBLE} AND id NOT IN (SELECT session_id FROM tt_slices))) AS model_count,
  count(*) AS raw_session_count, coalesce(sum(raw_event_count) FILTER (WHERE {VISIBLE}), 0)::BIGINT AS raw_event_count,
  count(*) FILTER (WHERE {VISIBLE} AND (parse_status = 'failed' OR parse_error_count > 0)) AS parse_failure_count,
  (SELECT sum(session_file_count)::BIGINT FROM {STATS}) AS session_file_count, (SELECT max(last_scanned_at) FROM {STATS}) AS last_scanned_at
FROM tt_sessions""")
def _(t: Tables) -> DataFrame:
    return G.scan_overview(t.sessions, reports.source_stats(t.sessions))


DAYS = "(SELECT coalesce(strftime(started_at, '%Y-%m-%d'), 'unknown-date') AS id, sum(total_tokens)::BIGINT AS value FROM tt_sessions GROUP BY 1)"
HOURS = f"(SELECT {HOUR} AS id, sum(total_tokens)::BIGINT AS value FROM tt_sessions GROUP BY 1)"
POINTS = f"""(SELECT CASE WHEN h.n THEN 'hour' ELSE 'day' END AS grain, p.id, p.value FROM
  (SELECT (SELECT count(*) FROM {DAYS}) <= 3 AND (SELECT count(*) FROM {HOURS}) >= 4 AS n) h,
  (SELECT 'day' AS g, * FROM {DAYS} UNION ALL SELECT 'hour', * FROM {HOURS}) p WHERE p.g = CASE WHEN h.n THEN 'hour' ELSE 'day' END)"""


def _points(t: Tables) -> DataFrame:
    return G.timeline(G.by_hour(t.sessions), "total_tokens")


@query("timeline", f"SELECT * FROM {POINTS}")
def _(t: Tables) -> DataFrame:
    return _points(t)


@query("timeline_stats", f"""SELECT count(*) AS points, (SELECT id FROM {POINTS} ORDER BY value DESC, id LIMIT 1) AS peak_id,
  max(value) AS peak_value, sum(value)::BIGINT AS total_value FROM {POINTS}""")
def _(t: Tables) -> DataFrame:
    return G.timeline_stats(_points(t))


OTHER_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in ["known_cost_sessions", "unknown_cost_sessions", *G.TOKENS, "session_count", "message_count"])


@query("top_n_with_other", f"""
WITH g AS ({group_sql('repo_root', 'repo_name').replace(usd('cost_micro') + ' AS cost_usd', 'cost_micro')}),
r AS (SELECT *, CASE WHEN n <= 5 THEN g_id ELSE '__other' END AS slot FROM (SELECT *, id AS g_id, row_number() OVER (ORDER BY total_tokens DESC, id) AS n FROM g WHERE total_tokens > 0)),
w AS (SELECT slot, string_agg(w, ';' ORDER BY w) AS warnings FROM (SELECT DISTINCT slot, unnest(string_split(warnings, ';')) AS w FROM r) WHERE w <> '' GROUP BY slot)
SELECT slot AS id, CASE WHEN min(n) <= 5 THEN min(label) ELSE 'Other (' || count(*) || ')' END AS label,
  {usd('sum(cost_micro)')} AS cost_usd, {OTHER_SUMS}, coalesce((SELECT warnings FROM w WHERE w.slot = r.slot), '') AS warnings
FROM r GROUP BY slot""")
def _(t: Tables) -> DataFrame:
    return shown(G.top_n_with_other(G.by_repo(t.sessions), F.col("total_tokens"), 5))
