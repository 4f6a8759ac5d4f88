"""Transcripts, telemetry, workspace records, threads and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.functions import models as M
from tokentally.functions import records as R
from tokentally.operators import otel, paths, pricing, rollout, transcripts, workspace
from tokentally.plans.binding import Tables, pick_sql
from tokentally.plans.oracle import choose
from tokentally.plans.registry import query

BUCKETS = ", ".join(transcripts.BUCKETS)
SUMS = ", ".join(f"sum({b})::BIGINT AS {b}" for b in transcripts.BUCKETS)


# ---------------------------------------------------------------- transcripts

@query("scan_project_transcripts", "SELECT file, count(*) AS records, min(mtime_ms) AS mtime_ms FROM tt_turns GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.transcript_records.where("not bad").groupBy("file").agg(F.count("*").alias("records"), F.min("mtime_ms").alias("mtime_ms"))


@query("claude_token_buckets", "SELECT file, ord, raw_input + cache_read + w AS input_tokens, cache_read AS cached_input_tokens, w AS cache_write_tokens, created_5m AS cache_write_5m, created_1h AS cache_write_1h, "
       "raw_output AS output_tokens, CASE WHEN has_input THEN raw_input + cache_read + w END AS request_input_tokens FROM (SELECT *, greatest(cache_created, created_5m + created_1h) AS w FROM tt_turns)")
def _(t: Tables) -> DataFrame:
    return transcripts.with_buckets(transcripts.usage_rows(t.transcript_records)).select("file", "ord", *transcripts.BUCKETS, "request_input_tokens")


def _once(t: Tables) -> DataFrame:
    return transcripts.with_buckets(transcripts.distinct_usage(transcripts.usage_rows(t.transcript_records)))


@query("streaming_usage_dedup", f"SELECT file, ord, model, request_key, {BUCKETS}, speed, copies FROM tt_once_buckets")
def _(t: Tables) -> DataFrame:
    return _once(t).select("file", "ord", "model", "request_key", *transcripts.BUCKETS, "speed", "copies")


@query("split_by_day_model", f"""
WITH c AS (SELECT file, strftime(moment, '%Y-%m-%d') AS day, model, count(*) AS events, {SUMS}, min(ord) AS o, max(ord) AS last FROM tt_once_buckets GROUP BY 1, 2, 3),
p AS (SELECT *, count(*) FILTER (WHERE day IS NOT NULL) OVER (PARTITION BY file) AS pieces FROM c)
SELECT file, '#' || coalesce(day, 'unknown-date') || coalesce('#' || model, '') AS suffix, model, events, {BUCKETS}, true AS split FROM p WHERE pieces > 1
UNION ALL SELECT file, '', arg_max(model, last) FILTER (WHERE model IS NOT NULL), sum(events)::BIGINT, {SUMS.replace(' AS ', ' AS z_')}, false FROM p WHERE pieces <= 1 GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return transcripts.split_sessions(_once(t)).select("file", "suffix", "model", "events", *transcripts.BUCKETS, "split")


@query("transcript_signals", """
SELECT file, count(*) FILTER (WHERE n % 5 = 4) AS user_prompt_count, count(*) FILTER (WHERE n % 5 <> 4) AS assistant_message_count, count(*) AS tool_call_count, count(*) FILTER (WHERE n % 4 = 0) AS shell_command_count,
  count(*) FILTER (WHERE n % 4 = 1) AS file_read_count, count(*) FILTER (WHERE n % 4 = 2) AS file_edit_count, count(*) FILTER (WHERE s % 5 = 0 OR s % 7 = 0) AS failed_tool_call_count FROM tt_turns GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    rows = transcripts.session_facts(t.transcript_records)
    return rows.select("file", "user_prompt_count", "assistant_message_count", "tool_call_count", "shell_command_count", "file_read_count", "file_edit_count", "failed_tool_call_count")


@query("infer_outcome", """
SELECT file, CASE WHEN count(*) FILTER (WHERE s % 5 = 0 OR s % 7 = 0) > 0 THEN 'partial' WHEN count(*) FILTER (WHERE n % 4 = 2) > 0 THEN 'completed' WHEN count(*) FILTER (WHERE n % 4 = 0) > 0 THEN 'setup_debugging' ELSE 'research_only' END AS session_outcome
FROM tt_turns GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return transcripts.session_facts(t.transcript_records).select("file", "session_outcome")


@query("decode_project_path", "SELECT DISTINCT file, '/w/p' || (o % 97) AS cwd FROM tt_turns")
def _(t: Tables) -> DataFrame:
    return t.transcript_lines.select("file").distinct().select("file", R.project_path(R.parent_path(F.col("file"))).alias("cwd"))


@query("clean_model", f"SELECT model, count(*) AS requests FROM (SELECT {choose('l_partkey', ['claude-opus-4-8', '<synthetic>', 'auto', 'copilot/gpt-4.1', None])} AS raw, CASE l_partkey % 5 WHEN 0 THEN 'claude-opus-4-8' WHEN 3 THEN 'gpt-4.1' END AS model FROM lineitem) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    raw = t.table("lineitem").selectExpr(f"{pick_sql('l_partkey', ['claude-opus-4-8', '<synthetic>', 'auto', 'copilot/gpt-4.1', None])} AS raw")
    return raw.groupBy(M.chat_model_candidate(M.clean_transcript_model(F.col("raw"))).alias("model")).agg(F.count("*").alias("requests"))


# ---------------------------------------------------------------- telemetry

OTEL = ", ".join(otel.TOKENS)


@query("scan_otel_and_transcripts", "SELECT file, count(*) AS records, count(DISTINCT trace_id) AS traces FROM tt_spans GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.otel_records.where("not bad").groupBy("file").agg(F.count("*").alias("records"), F.countDistinct("rec.traceId").alias("traces"))


@query("otel_token_buckets", f"SELECT file, ord, {OTEL}, CASE WHEN input_tokens >= cached_input_tokens + cache_write_tokens THEN input_tokens END AS request_input_tokens FROM tt_spans")
def _(t: Tables) -> DataFrame:
    return otel.attributed(t.otel_records).select("file", "ord", *otel.TOKENS, "request_input_tokens")


@query("otel_usage_source", "SELECT file, ord, source FROM tt_spans")
def _(t: Tables) -> DataFrame:
    return otel.attributed(t.otel_records).select("file", "ord", "source")


@query("normalize_timestamp", "SELECT file, ord, at_ms FROM tt_spans")
def _(t: Tables) -> DataFrame:
    return otel.attributed(t.otel_records).select("file", "ord", F.unix_millis("at").alias("at_ms"))


@query("trace_context", "SELECT file, trace_id, trace_model, trace_session FROM tt_contexts")
def _(t: Tables) -> DataFrame:
    return otel.trace_contexts(otel.attributed(t.otel_records)).select("file", "trace_id", "trace_model", "trace_session")


@query("otel_session_key", "SELECT file, ord, session_id, model FROM tt_candidates")
def _(t: Tables) -> DataFrame:
    return otel.candidates(t.otel_records).select("file", "ord", "session_id", "model")


@query("otel_dedup_key", "SELECT file, ord, dedup_key FROM tt_candidates")
def _(t: Tables) -> DataFrame:
    return otel.candidates(t.otel_records).select("file", "ord", "dedup_key")


@query("suppress_lower_priority", "SELECT file, ord, source FROM tt_emitted")
def _(t: Tables) -> DataFrame:
    return otel.suppress_weaker(otel.candidates(t.otel_records)).select("file", "ord", "source")


@query("first_occurrence", "SELECT file, ord, dedup_key FROM tt_unique")
def _(t: Tables) -> DataFrame:
    return otel.file_events(t.otel_records).select("file", "ord", "dedup_key")


@query("merge_fragments", f"""
SELECT m.host, m.session_id, {', '.join(f'sum({c})::BIGINT AS {c}' for c in otel.TOKENS)}, count(*) AS events, any_value(f.n) AS fragments, CASE WHEN any_value(f.n) > 1 THEN 'copilot_duplicate_session_merged' ELSE '' END AS warnings
FROM tt_merged m JOIN (SELECT host, session_id, count(DISTINCT file) AS n FROM tt_unique GROUP BY 1, 2) f ON f.host = m.host AND f.session_id = m.session_id GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    rows = otel.merged_sessions(otel.file_events(t.otel_records))
    return rows.select("host", "session_id", *otel.TOKENS, "events", "fragments", F.array_join("warnings", ";").alias("warnings"))


# Chat sessions: one per customer, some with an automatic model.
CHAT = "c_custkey % 4"


@query("scan_chat_model_hints", "SELECT 'c' || c_custkey AS session_id, CASE c_custkey % 4 WHEN 0 THEN 'gpt-5.4' WHEN 1 THEN 'claude-opus-5' ELSE 'gpt-4.1' END AS hint FROM customer WHERE c_custkey % 4 < 3")
def _(t: Tables) -> DataFrame:
    return _hints(t).select("session_id", "hint")


def _hints(t: Tables) -> DataFrame:
    from tokentally.sources import schemas
    from tokentally.sources.files import parse_records

    first = "to_json(named_struct('v', named_struct('sessionId', concat('c', c_custkey), 'inputState', named_struct('selectedModel', named_struct('identifier', if(c_custkey % 4 = 0, 'copilot/gpt-5.4', 'auto'))))))"
    second = "to_json(named_struct('data', named_struct('metadata', named_struct('resolvedModel', CASE c_custkey % 4 WHEN 1 THEN 'claude-opus-5' WHEN 2 THEN 'GitHub-Copilot/gpt-4.1' WHEN 3 THEN 'auto' END))))"
    lines = t.table("customer").selectExpr("'h0' AS host", "concat('/s/', c_custkey, '.jsonl') AS file", f"posexplode(array({first}, {second})) AS (ord, line)")
    return otel.chat_model_hints(parse_records(lines.withColumn("ord", F.col("ord").cast("bigint")), schemas.CHAT))


@query("chat_model_hint", "SELECT 'c' || c_custkey AS session_id, CASE WHEN c_custkey % 3 = 0 THEN 'gpt-5' WHEN c_custkey % 4 = 0 THEN 'gpt-5.4' WHEN c_custkey % 4 = 1 THEN 'claude-opus-5' WHEN c_custkey % 4 = 2 THEN 'gpt-4.1' WHEN c_custkey % 3 = 1 THEN 'auto' END AS model FROM customer")
def _(t: Tables) -> DataFrame:
    sessions = t.table("customer").selectExpr("'h0' AS host", "concat('c', c_custkey) AS session_id", "CASE c_custkey % 3 WHEN 0 THEN 'gpt-5' WHEN 1 THEN 'auto' END AS model")
    return otel.apply_hints(sessions, _hints(t)).select("session_id", "model")


# ---------------------------------------------------------------- workspace records

KV = "conv_id * 1000 + turn AS ord, conv_id, turn, role, text, 100 * (turn + 1) AS i, 10 * (conv_id % 5 + 1) AS o FROM conversations WHERE conv_id % 10 <> 9"


def _kv_records(t: Tables) -> DataFrame:
    return workspace.parse_fields(workspace.key_value_lines(t.key_values))


@query("scan_key_value_store", f"SELECT ord, 'c' || conv_id AS id, '/w/' || (conv_id % 7) AS cwd, CASE WHEN role IN ('user', 'assistant') THEN role END AS role FROM (SELECT {KV})")
def _(t: Tables) -> DataFrame:
    return _kv_records(t).select("ord", "id", "cwd", "role")


@query("cursor_token_buckets", f"SELECT ord, i AS input_tokens, o AS output_tokens, 0::BIGINT AS reasoning_tokens, 0::BIGINT AS total_tokens, false AS estimated FROM (SELECT {KV})")
def _(t: Tables) -> DataFrame:
    return _kv_records(t).select("ord", "input_tokens", "output_tokens", "reasoning_tokens", "total_tokens", "estimated")


@query("merge_duplicate_sessions", f"""
SELECT 'c' || conv_id AS id, max(i) AS input_tokens, any_value(o) AS output_tokens, max(i + o) AS total_tokens, CASE WHEN min(turn) <= max(turn) AND count(*) FILTER (WHERE turn % 3 = 0) > 0 THEN 'gpt-5.4' END AS model, '/w/' || (conv_id % 7) AS cwd,
  min(1700000000000 + (conv_id * 1000 + turn) * 1000) AS started_ms, max(1700000000000 + (conv_id * 1000 + turn) * 1000) AS ended_ms, count(*) > 1 AS merged FROM (SELECT {KV}) GROUP BY conv_id""")
def _(t: Tables) -> DataFrame:
    parts = workspace.fragments(_kv_records(t), ["host", "file", "ord"]).where(~workspace.is_metadata_only())
    rows = workspace.merge_fragments(parts, "ord")
    return rows.select("id", "input_tokens", "output_tokens", "total_tokens", "model", "cwd", "started_ms", "ended_ms", "merged")


@query("recorded_cost_fallback", f"""
SELECT 'c' || conv_id || '-' || turn AS id, CASE WHEN turn % 3 = 0 THEN CAST((i * 2500000 + o * 15000000 + 500000) // 1000000 AS DOUBLE) / 1000000.0 ELSE 0.25 END AS cost_usd, turn % 3 = 0 AS priced FROM (SELECT {KV})""")
def _(t: Tables) -> DataFrame:
    parts = workspace.fragments(_kv_records(t), ["host", "file", "ord"]).withColumn("turn", F.pmod("ord", F.lit(1000)))
    requests = parts.select(
        F.concat("id", F.lit("-"), F.col("turn").cast("string")).alias("session_id"), "model", "ord", F.lit(None).cast("bigint").alias("request_input_tokens"),
        *[c for c in workspace.COUNTS], F.lit(0).cast("bigint").alias("cache_write_5m"), F.lit(0).cast("bigint").alias("cache_write_1h"), F.col("cost_micro").alias("recorded_micro"),
    )
    priced = pricing.price_requests(requests, t.cards).withColumn("cost_micro", pricing.pico_to_micro(F.col("cost_pico")))
    rows = priced.withColumn("priced", F.col("cost_micro").isNotNull())
    return workspace.with_recorded_cost(rows).select(F.col("session_id").alias("id"), pricing.micro_to_usd(F.col("cost_micro")).alias("cost_usd"), "priced")


# ---------------------------------------------------------------- threads and files

@query("declared_total", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN 0 ELSE floor(o_totalprice)::BIGINT END AS total FROM orders""")
def _(t: Tables) -> DataFrame:
    text = F.expr("CASE o_orderkey % 4 WHEN 0 THEN cast(cast(floor(o_totalprice) AS bigint) AS string) WHEN 1 THEN concat('{\"total_tokens\":', cast(floor(o_totalprice) AS bigint), '}') "
                  "WHEN 2 THEN concat('{\"tokensUsed\":\"', cast(floor(o_totalprice) AS bigint), '\"}') ELSE 'n/a' END")
    return t.table("orders").select("o_orderkey", R.declared_total(text).alias("total"))


def _threads(t: Tables) -> DataFrame:
    """One thread per customer; every third is a subagent of the customer before it."""
    return t.table("customer").selectExpr(
        "'h0' AS host", "concat('thread-', lpad(c_custkey, 8, '0')) AS id", "c_custkey AS k",
        "CASE c_custkey % 3 WHEN 0 THEN 'Codex subagent' WHEN 1 THEN 'Terminal' ELSE if(c_custkey % 9 = 8, 'Codex subagent', 'VS Code') END AS source_app", "'own' AS surface_reason",
        "if(c_custkey % 3 = 0, concat('{\"subagent\":{\"thread_spawn\":{\"parent_thread_id\":\"thread-', lpad(c_custkey - 1, 8, '0'), '\"}}}'), 'cli') AS source",
        "if(c_custkey % 5 = 0, concat('/own/', c_custkey), NULL) AS rollout_path",
    )


@query("subagent_parent", """
SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey = 0 OR (c_custkey - 1) % 9 = 8 THEN 'Codex subagent' ELSE 'VS Code' END WHEN c_custkey % 3 = 1 THEN 'Terminal'
  WHEN c_custkey % 9 = 8 THEN 'Codex subagent' ELSE 'VS Code' END AS source_app FROM customer""")
def _(t: Tables) -> DataFrame:
    threads = _threads(t).withColumn("parent_id", rollout.parent_thread(F.col("source")))
    return rollout.attribute_subagents(threads).select("k", "source_app")


def _thread_logs(t: Tables) -> DataFrame:
    return t.table("customer").where("c_custkey % 4 <> 3").selectExpr(
        "'h0' AS host", "CASE c_custkey % 4 WHEN 0 THEN concat('thread-', lpad(c_custkey, 8, '0')) ELSE concat('rollout-2026-thread-', lpad(c_custkey, 8, '0')) END AS id",
        "concat('/logs/', c_custkey, '.jsonl') AS path", "c_custkey AS k",
    )


@query("thread_to_log", """
SELECT 'thread-' || lpad(c_custkey::VARCHAR, 8, '0') AS id, CASE WHEN c_custkey % 5 = 0 THEN '/own/' || c_custkey ELSE '/logs/' || c_custkey || '.jsonl' END AS path FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 4 <> 3""")
def _(t: Tables) -> DataFrame:
    return rollout.thread_files(_threads(t).select("host", "id", "rollout_path"), _thread_logs(t).select("host", "id", "path")).select("id", "path")


@query("standalone_logs", "SELECT '/logs/' || c_custkey || '.jsonl' AS path FROM customer WHERE c_custkey % 4 IN (1, 2) AND c_custkey % 7 <> 0")
def _(t: Tables) -> DataFrame:
    imported = t.table("customer").selectExpr("'h0' AS host", "concat('thread-', lpad(c_custkey, 8, '0')) AS id", "if(c_custkey % 7 = 0, concat('\\\\\\\\?\\\\', replace(concat('/logs/', c_custkey, '.jsonl'), '/', '\\\\')), '') AS source_path")
    return rollout.standalone_files(_thread_logs(t), imported).select("path")


# The index of an order names two files; the later counts where its file is there and names a model.
VOTES = """SELECT o, coalesce(max(model) FILTER (WHERE ends_with(file, '-1.jsonl')), max(model)) AS model FROM (
  SELECT o, file, arg_min(model, r) AS model FROM (SELECT o, file, model, row_number() OVER (PARTITION BY file ORDER BY count(*) DESC, model) AS r FROM tt_turns WHERE model IS NOT NULL GROUP BY o, file, model) GROUP BY 1, 2) GROUP BY 1"""


@query("scan_import_index", f"SELECT 's' || o AS id, model FROM ({VOTES})")
def _(t: Tables) -> DataFrame:
    return _votes(t).select("id", F.col("imported_model").alias("model"))


def _votes(t: Tables) -> DataFrame:
    """Index documents of a hundred orders each, with entries that lack a path or a file, and their transcripts."""
    path = "concat(if(o_orderkey % 7 = 0, '\\\\\\\\?\\\\', ''), '/p/projects/-w-p', o_orderkey % 97, '/', o_orderkey, '-', n, '.jsonl')"
    entries = t.table("orders").selectExpr("concat('h', o_orderkey % 3) AS host", "o_orderkey", "explode(array(0, 1, 2, 3)) AS n").selectExpr(
        "host", "o_orderkey div 100 AS part", f"named_struct('o', o_orderkey, 'n', n, 'entry', named_struct('imported_thread_id', concat('s', o_orderkey), 'source_path', if(n = 3, NULL, {path}))) AS e"
    )
    documents = entries.groupBy("host", "part").agg(F.array_sort(F.collect_list("e")).alias("es")).selectExpr("host", "concat('/home/', part, '/index.json') AS file", "to_json(named_struct('records', es.entry)) AS body")
    broken = documents.limit(1).withColumns({"file": F.lit("/home/x/index.json"), "body": F.lit("{cut")})
    return rollout.imported_models(rollout.import_entries(documents.unionByName(broken)), t.transcript_records)


@query("imported_model", f"""
SELECT 's' || o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'gpt-5' ELSE v.model END AS model, CASE WHEN o_orderkey % 2 = 1 AND v.model IS NOT NULL THEN 'model_inferred_from_import_source' ELSE '' END AS warnings
FROM orders LEFT JOIN ({VOTES}) v ON v.o = o_orderkey""")
def _(t: Tables) -> DataFrame:
    sessions = t.table("orders").selectExpr("concat('h', o_orderkey % 3) AS host", "concat('s', o_orderkey) AS id", "if(o_orderkey % 2 = 0, 'gpt-5', NULL) AS model", "cast(array() AS array<string>) AS warnings")
    return rollout.fill_imported_models(sessions, _votes(t)).select("id", "model", F.array_join("warnings", ";").alias("warnings"))


# ---------------------------------------------------------------- paths

def _folders(t: Tables) -> DataFrame:
    return t.table("customer").selectExpr("c_custkey AS k", "concat('/w/', c_nationkey, '/team', c_custkey % 3, '/c', c_custkey, '/src') AS cwd")


def _aliases(t: Tables) -> DataFrame:
    return t.table("nation").selectExpr(
        "explode(array(named_struct('path', concat('/w/', n_nationkey, '/team0/'), 'name', concat(n_name, ' core'), 'place', 0), named_struct('path', concat('/w/', n_nationkey), 'name', n_name, 'place', 1))) AS a"
    ).select("a.*").where("name not like 'NATION_1%'")


ALIAS = "CASE WHEN n_name LIKE 'NATION_1%' THEN NULL WHEN c_custkey % 3 = 0 THEN n_name || ' core' ELSE n_name END"


@query("path_prefix", f"SELECT '/w/' || c_nationkey || '/team' || (c_custkey % 3) || '/c' || c_custkey || '/src' AS cwd, {ALIAS} AS alias FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name NOT LIKE 'NATION_1%'")
def _(t: Tables) -> DataFrame:
    return paths.alias_names(_folders(t), "cwd", _aliases(t))


@query("repo_identity", f"""
SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 1 THEN '/w/' || c_nationkey || '/team1/c' || c_custkey WHEN c_custkey % 3 = 2 THEN '/w/' || c_nationkey || '/team2' ELSE cwd END AS repo_root,
  coalesce({ALIAS}, CASE c_custkey % 3 WHEN 1 THEN 'c' || c_custkey WHEN 2 THEN 'team2' ELSE 'src' END) AS repo_name, c_custkey % 3 = 1 AS verified
FROM (SELECT *, '/w/' || c_nationkey || '/team' || (c_custkey % 3) || '/c' || c_custkey || '/src' AS cwd FROM customer) JOIN nation ON n_nationkey = c_nationkey""")
def _(t: Tables) -> DataFrame:
    roots = t.table("customer").selectExpr(
        "CASE c_custkey % 3 WHEN 1 THEN concat('/w/', c_nationkey, '/team1/c', c_custkey) WHEN 2 THEN concat('/w/', c_nationkey, '/team2') END AS path", "if(c_custkey % 3 = 1, 'git', 'marker') AS kind"
    ).where("path is not null").distinct()
    return paths.repo_identity(_folders(t), "cwd", roots, _aliases(t)).select("k", "repo_root", "repo_name", "verified")
