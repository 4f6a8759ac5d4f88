"""Source scans, their union, and incremental ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.operators import workspace
from tokentally.operators.filters import thread_may_overlap
from tokentally.operators.sessions import cost_warnings
from tokentally.plans.binding import SOURCES, Tables
from tokentally.plans.logs_queries import REQUESTS
from tokentally.plans.registry import query
from tokentally.plans.sessions_queries import KV, _kv_records
from tokentally.sources import sessions
from tokentally.streaming.ingest import changed_files


UNPRICED = """CASE source_client WHEN 'codex' THEN CASE WHEN priced THEN ['unknown_pricing'] ELSE ['missing_token_breakdown'] END WHEN 'claude' THEN ['unknown_pricing']
  WHEN 'copilot' THEN CASE WHEN priced THEN ['unknown_pricing'] ELSE [] END ELSE CASE WHEN priced THEN ['unknown_pricing'] ELSE ['unknown_cost'] END END"""
FAST = "CASE WHEN source_client = 'claude' AND len(list_filter(found, lambda w: starts_with(w, 'unknown_pricing_model:') AND contains(w, 'fast-mode'))) > 0 THEN ['unknown_fast_mode_pricing'] ELSE [] END"


@query("cost_warnings", f"""
SELECT id, array_to_string(list_sort(list_distinct(list_concat(own_warnings, assumed, CASE WHEN cost_micro IS NULL THEN list_concat({UNPRICED}, found, {FAST}) ELSE [] END))), ';') AS warnings
FROM (SELECT f.id, f.source_client, f.own_warnings, c.cost_micro, c.session_id IS NOT NULL AS priced, coalesce(c.price_warnings, []) AS found, coalesce(c.price_assumptions, []) AS assumed
  FROM tt_facts f LEFT JOIN tt_costs c ON c.session_id = f.id)""")
def _(t: Tables) -> DataFrame:
    rows = t.session_facts.join(t.costs.withColumnRenamed("session_id", "id"), "id", "left").withColumn("estimated", F.lit(False)).withColumnRenamed("own_warnings", "warnings")
    told = F.lit(None).cast("array<string>")
    for source in SOURCES:
        told = F.when(F.col("source_client") == source, cost_warnings(source, F.col("request_count").isNotNull())).otherwise(told)
    return rows.select("id", F.array_join(F.array_sort(told), ";").alias("warnings"))


@query("scan_thread_table", "SELECT c_custkey::VARCHAR AS id, '/w/' || c_nationkey AS cwd, c_name AS title, NULL::VARCHAR AS model FROM customer WHERE c_custkey % 10 >= 3")
def _(t: Tables) -> DataFrame:
    table = t.table("customer").selectExpr("cast(c_custkey AS string) AS id", "concat('/w/', c_nationkey) AS cwd", "c_name AS title", "c_custkey % 10 AS created_at", "c_acctbal AS unknown_column")
    threads = sessions.known_columns(table).withColumn("created_ms", F.col("created_at").cast("bigint")).withColumn("updated_ms", F.lit(None).cast("bigint"))
    return threads.where(thread_may_overlap(3, None)).select("id", "cwd", "title", "model")


@query("scan_agent_transcripts", f"""
SELECT 'c' || conv_id AS id, '/w/' || (conv_id % 7) AS cwd, count(*) FILTER (WHERE role IN ('user', 'assistant')) AS message_count, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(i + o)::BIGINT AS total_tokens,
  count(*) AS raw_event_count FROM (SELECT {KV}) GROUP BY conv_id""")
def _(t: Tables) -> DataFrame:
    lines = workspace.key_value_lines(t.key_values).withColumn("file", F.concat(F.lit("/u/agent-transcripts/"), F.call_function("div", F.col("ord"), F.lit(1000)).cast("string"), F.lit(".jsonl")))
    rows = workspace.fragments(workspace.parse_fields(lines), ["host", "file"])
    return rows.select("id", "cwd", "message_count", "input_tokens", "output_tokens", "total_tokens", "raw_event_count")


@query("union_sources", f"""
SELECT 'codex' AS source_client, count(*) AS sessions, coalesce(sum(total), 0)::BIGINT AS total_tokens FROM (SELECT DISTINCT file FROM tt_ev) f LEFT JOIN (SELECT file, sum(total_tokens) AS total FROM {REQUESTS} GROUP BY 1) r ON r.file = f.file
UNION ALL SELECT 'claude', (SELECT count(*) FROM (SELECT file, strftime(moment, '%Y-%m-%d') AS day, model FROM tt_once WHERE file IN (SELECT file FROM (SELECT DISTINCT file, strftime(moment, '%Y-%m-%d') AS d, model AS m FROM tt_once WHERE moment IS NOT NULL) GROUP BY 1 HAVING count(*) > 1) GROUP BY 1, 2, 3))
  + (SELECT count(DISTINCT file) FROM tt_turns WHERE file NOT IN (SELECT file FROM (SELECT DISTINCT file, strftime(moment, '%Y-%m-%d') AS d, model AS m FROM tt_once WHERE moment IS NOT NULL) GROUP BY 1 HAVING count(*) > 1)),
  (SELECT sum(input_tokens + output_tokens)::BIGINT FROM tt_once_buckets)
UNION ALL SELECT 'copilot', (SELECT count(DISTINCT (host, session_id)) FROM tt_merged), (SELECT sum(input_tokens + output_tokens + reasoning_tokens)::BIGINT FROM tt_merged)
UNION ALL SELECT 'cursor', count(*), sum(total)::BIGINT FROM (SELECT conv_id, max(i + o) AS total FROM (SELECT {KV}) GROUP BY 1)""")
def _(t: Tables) -> DataFrame:
    parts = workspace.fragments(_kv_records(t), ["host", "file", "ord"]).where(~workspace.is_metadata_only())
    everything = sessions.union_sources([
        sessions.rollout_sessions(t.rollout_records, t.cards), sessions.transcript_sessions(t.transcript_records, t.cards),
        sessions.otel_sessions(t.otel_records, t.cards), sessions.workspace_sessions(parts, t.cards, "ord"),
    ])
    return everything.groupBy("source_client").agg(F.count("*").alias("sessions"), F.sum("total_tokens").alias("total_tokens"))


# Files of customers by kind, records by order; three customers of different kinds share a session.
EDITOR = """
ev AS (
  SELECT o_custkey AS c, o_orderkey AS k, o_orderkey % 7 AS e, floor(o_totalprice / 100)::BIGINT AS v, epoch_ms(o_orderdate) AS ms, 'ed' || (o_custkey // 3) AS sid, o_custkey % 3 < 2 AS active,
    o_orderkey % 7 = 6 AND o_custkey % 6 IN (2, 3) AS spans,
    CASE o_custkey % 3 WHEN 0 THEN '/c/workspaceStorage/w' || (o_custkey % 7) || '/GitHub.copilot-chat/transcripts/' || o_custkey || '.jsonl' WHEN 1 THEN '/c/session-state/s' || o_custkey || '/events.jsonl'
      ELSE '/c/workspaceStorage/w' || (o_custkey % 7) || '/GitHub.copilot-chat/debug-logs/' || o_custkey || '.jsonl' END AS file FROM orders),
acts AS (
  SELECT *, CASE WHEN e IN (0, 1, 3) THEN ms WHEN NOT spans AND e IN (4, 6) THEN ms WHEN c % 3 = 0 THEN 1700000000000 + c * 1000 END AS moment,
    CASE WHEN e = 1 THEN 'user' WHEN e = 2 THEN 'assistant' WHEN e = 4 OR (e = 6 AND NOT spans) THEN CASE WHEN k % 2 = 0 THEN 'user' ELSE 'assistant' END END AS role,
    CASE WHEN e = 3 THEN CASE k % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'copilot/gpt-4.1' ELSE 'claude-opus-4-8' END END AS model FROM ev WHERE active AND e <> 5),
facts AS (
  SELECT file, arg_max(sid, k) FILTER (WHERE e = 0 AND c % 4 <> 1) AS told, arg_min('/w/' || (c % 11), k) FILTER (WHERE e = 0) AS cwd, arg_min('Chat ' || k, k) FILTER (WHERE e = 0) AS title,
    coalesce(arg_max(model, k) FILTER (WHERE model <> 'auto'), max(model)) AS model, min(moment) AS from_ms, max(moment) AS to_ms, count(role) AS said, count(*) FILTER (WHERE role = 'user') AS asked,
    count(*) FILTER (WHERE role = 'assistant') AS replied, count(*) FILTER (WHERE e = 2) AS tooled FROM acts GROUP BY 1),
files AS (
  SELECT ev.file, any_value(c) AS c, count(*) FILTER (WHERE e <> 5) AS records, count(*) FILTER (WHERE e = 5) AS bad, any_value(f.told) AS told, any_value(f.cwd) AS cwd, any_value(f.title) AS title, any_value(f.model) AS model,
    any_value(from_ms) AS from_ms, any_value(to_ms) AS to_ms, coalesce(any_value(said), 0) AS said, coalesce(any_value(asked), 0) AS asked, coalesce(any_value(replied), 0) AS replied, coalesce(any_value(tooled), 0) AS tooled
  FROM ev LEFT JOIN facts f ON f.file = ev.file GROUP BY 1),
named AS (
  SELECT *, coalesce(told, CASE c % 3 WHEN 1 THEN 'events' ELSE c::VARCHAR END) AS own, coalesce(CASE WHEN c % 3 <> 1 AND c % 7 < 5 THEN '/w/ws' || (c % 7) END, cwd) AS folder,
    CASE WHEN c % 3 = 1 THEN 'cli' ELSE 'vscode' END AS surface FROM files),
spans AS (SELECT file, sid, count(*) AS n, min(ms) AS from_ms, max(ms) + 1000 AS to_ms, arg_max(CASE WHEN k % 2 = 0 THEN 'gpt-5.4' ELSE 'claude-opus-4-8' END, k) AS model, sum(v) AS output FROM ev WHERE spans GROUP BY 1, 2),
parts AS (
  SELECT f.file, coalesce(s.sid, own) AS id, title, folder, coalesce(s.model, f.model) AS model, surface, least(f.from_ms, s.from_ms) AS from_ms, greatest(f.to_ms, s.to_ms) AS to_ms, greatest(said, coalesce(n, 0)) AS said,
    asked, greatest(replied, coalesce(n, 0)) AS replied, tooled, records, bad, CASE WHEN bad = 0 THEN 'ok' WHEN records > 0 OR n IS NOT NULL THEN 'partial' ELSE 'failed' END AS status, n
  FROM named f LEFT JOIN spans s ON s.file = f.file),
plain AS (SELECT acts.file, own AS id, count(*) AS n, sum(v) AS output FROM acts JOIN named ON named.file = acts.file WHERE e = 2 AND v > 0 AND acts.file NOT IN (SELECT file FROM spans) GROUP BY 1, 2),
counted AS (SELECT file, sid AS id, n, 100 * n AS input, output, true AS detailed FROM spans UNION ALL SELECT file, id, n, 0, output, false FROM plain),
tokens AS (
  SELECT id, count(*) AS fragments, sum(n) FILTER (WHERE detailed = best) AS events, sum(input) FILTER (WHERE detailed = best) AS input, sum(output) FILTER (WHERE detailed = best) AS output
  FROM (SELECT *, bool_or(detailed) OVER (PARTITION BY id) AS best FROM counted) GROUP BY 1)"""


@query("copilot_transcript_sessions", f"""WITH {EDITOR}
SELECT p.id, arg_min(title, file) FILTER (WHERE title IS NOT NULL) AS title, coalesce(arg_min(folder, file) FILTER (WHERE folder IS NOT NULL), '') AS cwd,
  regexp_replace(arg_min(model, file) FILTER (WHERE model IS NOT NULL), '^copilot/', '') AS model, CASE WHEN arg_min(surface, file) = 'vscode' THEN 'VS Code' ELSE 'Copilot CLI' END AS source_app,
  min(from_ms)::BIGINT AS started_ms, max(to_ms)::BIGINT AS ended_ms, max(said) AS message_count, max(asked) AS user_prompt_count, max(replied) AS assistant_message_count, max(tooled * 3)::BIGINT AS tool_call_count,
  max(tooled * 2)::BIGINT AS shell_command_count, max(tooled)::BIGINT AS file_edit_count, max(tooled)::BIGINT AS file_read_count, max(records) AS raw_event_count, sum(bad)::BIGINT AS parse_error_count,
  CASE WHEN sum(bad) = 0 THEN 'ok' WHEN count(*) = 1 THEN max(status) ELSE 'partial' END AS parse_status, coalesce(any_value(t.events), 0)::BIGINT AS token_snapshot_count,
  coalesce(any_value(t.input), 0)::BIGINT AS input_tokens, coalesce(any_value(t.output), 0)::BIGINT AS output_tokens,
  coalesce(any_value(t.fragments), 0) > 1 AS merged, coalesce(any_value(t.output), 0) + coalesce(any_value(t.input), 0) <= 0 AS without_tokens, coalesce(any_value(t.output), 0) > 0 AND coalesce(any_value(t.input), 0) = 0 AS partial_tokens
FROM parts p LEFT JOIN tokens t ON t.id = p.id GROUP BY p.id""")
def _(t: Tables) -> DataFrame:
    rows = sessions.editor_sessions(t.editor_records, t.cards)
    marks = {"merged": "copilot_duplicate_session_merged", "without_tokens": "missing_token_breakdown", "partial_tokens": "copilot_partial_token_breakdown"}
    return rows.select(
        "id", "title", "cwd", "model", "source_app", F.unix_millis("started_at").alias("started_ms"), F.unix_millis("ended_at").alias("ended_ms"), "message_count", "user_prompt_count", "assistant_message_count",
        "tool_call_count", "shell_command_count", "file_edit_count", "file_read_count", "raw_event_count", "parse_error_count", "parse_status", "token_snapshot_count", "input_tokens", "output_tokens",
        *[F.array_contains("warnings", warning).alias(name) for name, warning in marks.items()],
    )


# The ledger knows each file as it was before the last fifth of January.
LEDGER_END = "2024-01-25"


@query("incremental_ingest", f"SELECT DISTINCT '/logs/rollout-' || user_id || '.jsonl' AS file FROM events WHERE ts >= TIMESTAMP '{LEDGER_END}'")
def _(t: Tables) -> DataFrame:
    def listing(events: DataFrame) -> DataFrame:
        return events.selectExpr("concat('h', user_id % 3) AS host", "concat('/logs/rollout-', user_id, '.jsonl') AS file", "cast(ts AS timestamp) AS ts").groupBy("host", "file").agg(
            F.unix_millis(F.max("ts")).alias("mtime_ms"), F.count("*").alias("size")
        )

    known = listing(t.table("events").where(F.col("ts") < F.lit(LEDGER_END).cast("timestamp_ntz"))).withColumn("version", F.lit(1))
    return changed_files(listing(t.table("events")), known).select("file")
