"""Rollout logs: tokens, models, messages, compactions, commands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.functions import records as R
from tokentally.operators import friction, rollout
from tokentally.operators.groups import total
from tokentally.operators.scans import forward_fill
from tokentally.plans.binding import Tables
from tokentally.plans.registry import query
from tokentally.sources import files

COUNTS = ", ".join(rollout.USAGE)
SUMS = ", ".join(f"coalesce(sum({u}), 0)::BIGINT AS {u}" for u in rollout.USAGE)


def millis(name: str):
    return F.unix_millis(name)


# ---------------------------------------------------------------- scans

@query("scan_rollout_logs", "SELECT host, file, count(*) FILTER (WHERE NOT (e = 'view' AND k = 13)) AS records, count(*) FILTER (WHERE e = 'view' AND k = 13) AS bad_lines FROM tt_ev GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return t.rollout_records.groupBy("host", "file").agg(F.count_if(~F.col("bad")).alias("records"), F.count_if("bad").alias("bad_lines"))


@query("parse_status", "SELECT file, CASE WHEN count(*) FILTER (WHERE e = 'view' AND k = 13) = 0 THEN 'ok' WHEN count(*) FILTER (WHERE NOT (e = 'view' AND k = 13)) > 0 THEN 'partial' ELSE 'failed' END AS status FROM tt_ev GROUP BY 1")
def _(t: Tables) -> DataFrame:
    counts = t.rollout_records.groupBy("file").agg(F.count_if("bad").alias("errors"), F.count_if(~F.col("bad")).alias("records"))
    return counts.select("file", R.parse_status(F.col("errors"), F.col("records")).alias("status"))


@query("history_entry_count", "SELECT count(*) AS entries FROM tt_ev WHERE NOT (e = 'view' AND k = 13)")
def _(t: Tables) -> DataFrame:
    return files.history_entries(t.rollout_lines)


# ---------------------------------------------------------------- tokens

@query("codex_token_buckets", f"SELECT file, ord, {COUNTS} FROM tt_usage")
def _(t: Tables) -> DataFrame:
    return rollout.token_usages(t.rollout_records).select("file", "ord", *rollout.USAGE)


@query("codex_usage_kind", "SELECT file, ord, kind, 13 * snap AS snapshot_total FROM tt_usage")
def _(t: Tables) -> DataFrame:
    return rollout.token_usages(t.rollout_records).select("file", "ord", "kind", F.col("snap_total").alias("snapshot_total"))


@query("valid_usage", "SELECT file, count(*) FILTER (WHERE input_tokens >= 0) AS valid, count(*) FILTER (WHERE input_tokens < 0) AS invalid FROM tt_usage GROUP BY 1")
def _(t: Tables) -> DataFrame:
    usages = rollout.token_usages(t.rollout_records)
    return usages.groupBy("file").agg(F.count_if(rollout.is_valid()).alias("valid"), F.count_if(~rollout.is_valid()).alias("invalid"))


@query("drop_stale_snapshots", "SELECT file, ord, kept FROM tt_fold")
def _(t: Tables) -> DataFrame:
    usages = rollout.token_usages(t.rollout_records).where(rollout.is_valid())
    cumulative = usages.where("kind = 'cumulative'").select("host", "file").distinct()
    return rollout.drop_stale_snapshots(usages.join(cumulative, ["host", "file"], "left_anti")).select("file", "ord", "kept")


FINAL = "SELECT file, max(ord) AS ord, max(total_tokens) AS total_tokens FROM (SELECT *, max(total_tokens) OVER (PARTITION BY file) AS best FROM tt_valid WHERE kind = 'cumulative') WHERE total_tokens = best GROUP BY 1"


@query("token_final_snapshot", f"SELECT f.file, f.ord, {', '.join('u.' + u for u in rollout.USAGE)} FROM ({FINAL}) f JOIN tt_valid u ON u.file = f.file AND u.ord = f.ord")
def _(t: Tables) -> DataFrame:
    return rollout.token_requests(t.rollout_records).where("method = 'final_snapshot'").select("file", "ord", *rollout.USAGE)


ACTIVE = "(SELECT arg_max(m.model, m.ord) FROM tt_models m WHERE m.file = {0}.file AND m.ord <= {0}.ord)"


@query("token_delta_sum", f"SELECT u.file, u.ord, {', '.join('u.' + x for x in rollout.USAGE)}, u.input_tokens AS request_input_tokens, {ACTIVE.format('u')} AS model FROM tt_fold f JOIN tt_valid u ON u.file = f.file AND u.ord = f.ord WHERE f.kept")
def _(t: Tables) -> DataFrame:
    return rollout.token_requests(t.rollout_records).where("method = 'delta_sum'").select("file", "ord", *rollout.USAGE, "request_input_tokens", "model")


REQUESTS = f"(SELECT u.*, 'final_snapshot' AS method FROM ({FINAL}) f JOIN tt_valid u ON u.file = f.file AND u.ord = f.ord UNION ALL SELECT u.*, 'delta_sum' FROM tt_fold f JOIN tt_valid u ON u.file = f.file AND u.ord = f.ord WHERE f.kept)"
TOTALS = f"""SELECT a.file, {', '.join('coalesce(r.' + u + ', 0) AS ' + u for u in rollout.USAGE)}, coalesce(r.method, 'unknown') AS token_aggregation_method, CASE WHEN r.method IS NULL THEN 'low' ELSE 'high' END AS token_confidence,
  a.n AS token_snapshot_count, array_to_string(list_filter([CASE WHEN a.bad > 0 THEN 'invalid_token_snapshots:' || a.bad END,
    CASE WHEN r.method = 'final_snapshot' AND a.direct > 0 THEN 'token_direct_usage_ignored_after_cumulative_snapshot' END,
    CASE WHEN r.method = 'delta_sum' AND a.good > r.n THEN 'duplicate_or_stale_token_snapshots_skipped' END], lambda x: x IS NOT NULL), ';') AS warnings
FROM (SELECT file, count(*) AS n, count(*) FILTER (WHERE input_tokens < 0) AS bad, count(*) FILTER (WHERE kind <> 'cumulative') AS direct, count(*) FILTER (WHERE kind <> 'cumulative' AND input_tokens >= 0) AS good FROM tt_usage GROUP BY 1) a
LEFT JOIN (SELECT file, min(method) AS method, count(*) AS n, {SUMS} FROM {REQUESTS} GROUP BY 1) r ON r.file = a.file"""


@query("token_method_confidence", TOTALS)
def _(t: Tables) -> DataFrame:
    return rollout.token_totals(t.rollout_records).drop("host").withColumn("warnings", F.array_join("warnings", ";"))


@query("active_model", f"SELECT u.file, u.ord, {ACTIVE.format('u')} AS active_model FROM tt_usage u")
def _(t: Tables) -> DataFrame:
    tokens = rollout.token_usages(t.rollout_records).select("host", "file", "ord")
    return rollout.active_model(t.rollout_records.select("host", "file", "ord", "rec")).join(tokens, ["host", "file", "ord"], "left_semi").select("file", "ord", "active_model")


# ---------------------------------------------------------------- messages

@query("message_text", "SELECT file, ord, text FROM tt_said")
def _(t: Tables) -> DataFrame:
    return rollout.messages(t.rollout_records).select("file", "ord", "text")


@query("infer_role", "SELECT file, ord, role FROM tt_said")
def _(t: Tables) -> DataFrame:
    return rollout.messages(t.rollout_records).select("file", "ord", "role")


@query("startup_context", "SELECT file, count(*) AS injected FROM tt_ev WHERE e = 'signup' AND k % 3 <> 0 AND k % 20 = 1 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    said = t.rollout_records.selectExpr("file", f"{R.is_startup_context('line')} AS injected")
    return said.where("injected").groupBy("file").agg(F.count("*").alias("injected"))


SAID_ONCE = "(SELECT host, file, role, text, ms, min(ord) AS ord FROM tt_said GROUP BY ALL)"


@query("near_duplicate_messages", f"SELECT file, ord, role, text FROM {SAID_ONCE}")
def _(t: Tables) -> DataFrame:
    return rollout.distinct_messages(rollout.messages(t.rollout_records)).select("file", "ord", "role", "text")


@query("message_counts", f"""
SELECT e.file, CASE WHEN events > 0 THEN events ELSE replies END AS message_count, coalesce(s.users, 0) AS user_prompt_count, coalesce(s.assistants, 0) AS assistant_message_count
FROM (SELECT file, count(*) FILTER (WHERE e = 'signup' AND k % 3 <> 0) AS events, count(*) FILTER (WHERE e = 'signup' AND k % 3 = 0) AS replies FROM tt_ev GROUP BY 1) e
LEFT JOIN (SELECT file, count(*) FILTER (WHERE role = 'user') AS users, count(*) FILTER (WHERE role = 'assistant') AS assistants FROM {SAID_ONCE} GROUP BY 1) s ON s.file = e.file""")
def _(t: Tables) -> DataFrame:
    return rollout.message_counts(t.rollout_records).drop("host")


@query("prompt_timeline", """
SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM (
  SELECT conv_id, role, text, min(turn) AS turn FROM (SELECT conv_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations WHERE role IN ('user', 'assistant'))
  WHERE text <> '' GROUP BY 1, 2, 3)""")
def _(t: Tables) -> DataFrame:
    said = t.table("conversations").where("role in ('user', 'assistant')").selectExpr(
        "'h0' AS host", "cast(conv_id AS string) AS file", "turn AS ord", "role", f"{R.collapse('text')} AS text", "cast(NULL AS timestamp) AS at"
    ).where("text <> ''")
    return rollout.timeline_of(said, limit=None, shown=None).selectExpr("cast(file AS bigint) AS conv_id", "ord AS turn", "role", "text", "place")


# ---------------------------------------------------------------- compaction and session fields

COMPACTED = "(SELECT c.host, c.file, c.ord, c.ms, (SELECT arg_max(CASE WHEN k % 20 = 1 THEN '<env' WHEN k % 10 = 0 THEN '/compact now' ELSE 'note' END, m.ord) FROM tt_ev m WHERE m.file = c.file AND m.ord <= c.ord AND m.e = 'signup' AND m.k % 3 <> 0) AS said FROM tt_ev c WHERE c.e = 'purchase' AND c.k % 7 = 0)"


@query("last_user_text", f"SELECT file, ord, CASE WHEN said = '/compact now' THEN 'manual' ELSE 'auto' END AS trigger FROM {COMPACTED}")
def _(t: Tables) -> DataFrame:
    return rollout.compactions(t.rollout_records).select("file", "ord", "trigger")


@query("compaction_stats", f"""SELECT file, count(*) AS count, count(*) FILTER (WHERE said IS NULL OR said <> '/compact now') AS auto_count, count(*) FILTER (WHERE said = '/compact now') AS manual_count,
  min(ms) AS first_ms, max(ms) AS last_ms FROM {COMPACTED} GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    rows = rollout.compaction_stats(t.rollout_records)
    return rows.select("file", "count", "auto_count", "manual_count", millis("first_at").alias("first_ms"), millis("last_at").alias("last_ms"))


META = "(SELECT DISTINCT file, u FROM tt_ev WHERE e = 'purchase' AND k % 7 = 1)"
SOURCE = "CASE u % 4 WHEN 0 THEN 'vscode' WHEN 1 THEN 'cli' WHEN 2 THEN 'exec' ELSE 'codex_cloud_task' END"


@query("session_fold", f"""
SELECT e.file, CASE WHEN m.file IS NOT NULL THEN 's' || m.u END AS id, CASE WHEN m.file IS NOT NULL THEN '/w/' || m.u END AS cwd, CASE WHEN m.file IS NOT NULL THEN 'Run ' || m.u END AS title,
  (SELECT arg_min(d.model, d.ord) FROM tt_models d WHERE d.file = e.file) AS model, e.started_ms, e.ended_ms, e.records AS raw_event_count, e.bad AS parse_error_count, CASE WHEN e.bad > 0 THEN 'partial' ELSE 'ok' END AS parse_status
FROM (SELECT file, min(ms) FILTER (WHERE NOT (e = 'view' AND k = 13)) AS started_ms, max(ms) FILTER (WHERE NOT (e = 'view' AND k = 13)) AS ended_ms, count(*) FILTER (WHERE NOT (e = 'view' AND k = 13)) AS records,
    count(*) FILTER (WHERE e = 'view' AND k = 13) AS bad FROM tt_ev GROUP BY 1) e LEFT JOIN (SELECT file, CASE {SOURCE} WHEN '' THEN 0 ELSE u END AS u FROM {META}) m ON m.file = e.file""")
def _(t: Tables) -> DataFrame:
    rows = rollout.session_fold(t.rollout_records)
    return rows.select("file", "id", "cwd", "title", "model", millis("started_at").alias("started_ms"), millis("ended_at").alias("ended_ms"), "raw_event_count", "parse_error_count", "parse_status")


@query("detect_surface", f"""
SELECT file, CASE WHEN u % 5 = 0 THEN 'codex_exec' WHEN s = 'vscode' THEN 'vscode_extension' WHEN s = 'cli' THEN 'terminal_cli' WHEN s = 'exec' THEN 'codex_exec' ELSE 'unknown' END AS surface,
  CASE WHEN u % 5 = 0 THEN 'medium' WHEN s IN ('vscode', 'cli') THEN 'high' WHEN s = 'exec' THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT file, u, {SOURCE} AS s FROM {META})""")
def _(t: Tables) -> DataFrame:
    rows = rollout.session_fold(t.rollout_records).where("id is not null")
    raw = rollout.source_raw(F.col("thread_source"), F.col("source"), F.col("originator"))
    return rows.select("file", rollout.detect_surface(raw, F.col("thread_source")).alias("s")).select("file", "s.surface", "s.confidence")


@query("source_app_label", f"SELECT file, CASE WHEN u % 5 = 0 THEN 'Codex subagent' WHEN s = 'vscode' THEN 'VS Code' WHEN s = 'cli' THEN 'Terminal' WHEN s = 'exec' THEN 'Exec' ELSE 'Cloud Task' END AS app FROM (SELECT file, u, {SOURCE} AS s FROM {META})")
def _(t: Tables) -> DataFrame:
    rows = rollout.session_fold(t.rollout_records).where("id is not null")
    raw = rollout.source_raw(F.col("thread_source"), F.col("source"), F.col("originator"))
    return rows.select("file", rollout.app_label(raw, F.col("thread_source")).alias("app"))


@query("fallback_cwd", f"SELECT DISTINCT e.file, CASE WHEN m.file IS NULL THEN '/logs' ELSE '/w/' || m.u END AS cwd, m.file IS NULL AS inferred FROM tt_ev e LEFT JOIN {META} m ON m.file = e.file")
def _(t: Tables) -> DataFrame:
    rows = rollout.session_fold(t.rollout_records)
    return rows.select("file", F.coalesce("cwd", R.parent_path(F.col("file"))).alias("cwd"), F.col("cwd").isNull().alias("inferred"))


# ---------------------------------------------------------------- commands

@query("tool_signals", """
SELECT file, count(*) FILTER (WHERE e = 'click') AS tool_call_count, count(*) FILTER (WHERE e = 'click' AND k % 11 <> 0 OR (e = 'error' AND k % 7 = 0)) AS shell_command_count,
  count(*) FILTER (WHERE e = 'click' AND k % 11 <> 0 AND k % 6 = 1) AS file_read_count, 0::BIGINT AS file_edit_count FROM tt_ev WHERE NOT (e = 'view' AND k = 13) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return friction.tool_counts(t.rollout_records).drop("host")


@query("call_output_pairing", "SELECT file, cid AS call_id, command FROM tt_pairs")
def _(t: Tables) -> DataFrame:
    return friction.call_commands(t.rollout_records).select("file", "call_id", "command")


@query("command_key", "SELECT file, ord, command FROM tt_class")
def _(t: Tables) -> DataFrame:
    return friction.classified(friction.non_zero_exits(t.rollout_records)).select("file", "ord", "command")


@query("command_classification", "SELECT file, ord, category, kind0 AS classification, severity0 AS severity, impact0 AS impact FROM tt_issue0")
def _(t: Tables) -> DataFrame:
    return friction.classified(friction.non_zero_exits(t.rollout_records)).select("file", "ord", "category", "classification", "severity", "impact")


@query("repeat_failure", "SELECT file, ord, classification, severity, impact, clustered FROM tt_issues")
def _(t: Tables) -> DataFrame:
    rows = friction.repeat_failures(friction.classified(friction.non_zero_exits(t.rollout_records)))
    return rows.select("file", "ord", "classification", "severity", "impact", "clustered")


RANKS = "list_position(['none', 'ignored', 'info', 'warning', 'critical'], severity)"
IMPACTS = "list_position(['none', 'low', 'medium', 'high'], impact)"
KIND = "CASE WHEN category = 'unknown' THEN classification ELSE category END"


@query("command_issue_rollup", f"""
WITH k AS (SELECT *, {KIND} AS what, severity IN ('critical', 'warning') AS serious FROM tt_issues),
top AS (SELECT file, arg_min(what, rank) AS what FROM (SELECT file, what, row_number() OVER (PARTITION BY file ORDER BY s > 0 DESC, CASE WHEN s > 0 THEN s ELSE n END DESC, CASE WHEN s > 0 THEN fs ELSE f END) AS rank
  FROM (SELECT file, what, count(*) FILTER (WHERE serious) AS s, count(*) AS n, min(ord) AS f, min(ord) FILTER (WHERE serious) AS fs FROM k GROUP BY 1, 2)) GROUP BY 1)
SELECT k.file, count(*) AS non_zero_command_events, count(*) FILTER (WHERE serious) AS important_command_failures, count(*) FILTER (WHERE classification = 'harmless_nonzero') AS harmless_non_zero_events,
  count(*) FILTER (WHERE classification = 'exploratory_miss') AS exploratory_misses, count(DISTINCT CASE WHEN clustered THEN command END) AS repeated_failure_clusters,
  (['none', 'ignored', 'info', 'warning', 'critical'])[max({RANKS})] AS command_issue_severity, (['none', 'low', 'medium', 'high'])[max({IMPACTS})] AS command_issue_impact, any_value(top.what) AS top_failure_type
FROM k JOIN top ON top.file = k.file GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    issues = friction.repeat_failures(friction.classified(friction.non_zero_exits(t.rollout_records)))
    return friction.issue_rollup(issues).drop("host")


@query("command_issue_clusters", f"""
WITH w AS (SELECT *, row_number() OVER (PARTITION BY host, command ORDER BY {RANKS} DESC, file, ord) AS n FROM tt_issues WHERE severity IN ('critical', 'warning'))
SELECT host, command, count(*) AS count, count(DISTINCT file) AS sessions, any_value(severity) FILTER (WHERE n = 1) AS severity, any_value(impact) FILTER (WHERE n = 1) AS impact, any_value(category) FILTER (WHERE n = 1) AS category FROM w GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    issues = friction.repeat_failures(friction.classified(friction.non_zero_exits(t.rollout_records)))
    rows = friction.issue_clusters(issues, "host")
    return rows.select("host", "command", "count", "sessions", "severity", "impact", "category")
