"""Proxy tables: the driver's star schema read as requests, sessions and logs.

No assistant logs are shipped with the test data, so orders stand for
sessions, line items for billed requests, and events for log records.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally import rates
from tokentally.operators import pricing
from tokentally.operators.scans import running_sum
from tokentally.runtime import prepare
from tokentally.sources import editor, schemas
from tokentally.sources.files import parse_records

# Model of a line item, by l_partkey % 12; the last one is not recorded.
MODELS = [
    "claude-opus-4-8", "claude-sonnet-4-5-20250929", "claude-haiku-5-5", "gpt-6.1-sol", "gpt-6.1-terra", "gpt-5.4",
    "gpt-6.2-sol", "copilot/gpt-4.1", "claude-opus-5.5", "gemini-2.5-pro", "mystery-1", None,
]
SOURCES = ["codex", "claude", "copilot", "cursor"]


def pick_sql(number: str, values: list) -> str:
    """values[number % len(values)] as Spark SQL."""
    items = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"get(array({items}), cast(pmod({number}, {len(values)}) AS int))"


class Tables:
    """The driver's tables under one folder, and the proxies built on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        prepare(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def cards(self) -> DataFrame:
        return rates.bundled_cards_df(self.spark)

    @cached_property
    def requests(self) -> DataFrame:
        """One row per line item: a billed request of session l_orderkey."""
        counts = self.table("lineitem").selectExpr(
            "*",
            "pmod(l_partkey, 12) AS slot",
            "cast(l_quantity AS bigint) AS q",
            "cast(l_quantity AS bigint) * cast(round(l_discount * 100) AS bigint) * 500 AS cached_input_tokens",
            "cast(l_quantity AS bigint) * cast(round(l_tax * 100) AS bigint) * 100 AS cache_write_tokens",
        )
        base = counts.selectExpr(
            "cast(l_orderkey AS string) AS session_id",
            "l_orderkey AS request_id",
            "cast(l_linenumber AS bigint) AS message_id",
            "shiftleft(cast(unix_date(cast(l_shipdate AS date)) AS bigint), 44) + shiftleft(l_partkey, 8) + l_linenumber AS ord",
            "cast(l_shipdate AS timestamp) AS ts",
            f"{pick_sql('l_partkey', MODELS)} AS model",
            "if(pmod(l_suppkey, 10) = 0, 'fast', 'standard') AS speed",
            "CASE WHEN pmod(l_suppkey, 7) = 0 THEN NULL WHEN l_linestatus = 'O' THEN 'priority' ELSE 'Standard' END AS service_tier",
            "l_suppkey",
            "q * 5000 + cached_input_tokens + cache_write_tokens AS input_tokens",
            "cached_input_tokens",
            "cache_write_tokens",
            "if(slot IN (0, 1, 2, 8), cache_write_tokens, 0L) AS cache_write_5m",
            "0L AS cache_write_1h",
            "if(slot IN (3, 4, 5, 6), cache_write_tokens, 0L) AS cache_write_30m",
            "0L AS cache_write_12h",
            "cast(floor(l_extendedprice / 100) AS bigint) AS output_tokens",
            "if(l_returnflag = 'R', cast(floor(l_extendedprice / 400) AS bigint), 0L) AS reasoning_tokens",
        )
        # Requests of every 40th supplier do not record their size.
        return base.selectExpr(
            "* except (l_suppkey)",
            "if(pmod(l_suppkey, 40) <> 0, input_tokens, NULL) AS request_input_tokens",
            "input_tokens + output_tokens + reasoning_tokens AS total_tokens",
        )

    @cached_property
    def requests_priced(self) -> DataFrame:
        """Requests whose every model has a rate."""
        return self.requests.withColumn("model", F.coalesce("model", F.lit("gpt-5.4"))).where("model <> 'mystery-1'")

    @cached_property
    def slices(self) -> DataFrame:
        return pricing.session_slices(self.requests, self.cards, ["session_id"], ids=self.requests)

    @cached_property
    def costs(self) -> DataFrame:
        return pricing.session_costs(self.slices, ["session_id"])

    @cached_property
    def session_facts(self) -> DataFrame:
        """Sessions without their token columns: no request is read for them."""
        nation = self.table("nation").select("n_nationkey", "n_name")
        owners = self.table("customer").select("c_custkey", "c_nationkey")
        base = (
            self.table("orders").join(owners, F.col("o_custkey") == F.col("c_custkey"))
            .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows, by definition
        ).selectExpr(
            "*",
            "o_orderkey AS k",
            "if(o_orderkey % 97 <> 0, timestampadd(HOUR, cast(o_orderkey % 24 AS int), cast(o_orderdate AS timestamp)), NULL) AS started_at",
            "cast(floor(o_totalprice) AS bigint) % 14400 AS secs",
            "CASE WHEN o_orderkey % 9 = 0 THEN 2L WHEN o_orderkey % 17 = 0 THEN NULL ELSE 0L END AS important",
            "CASE WHEN o_orderkey % 53 = 0 THEN 'failed' WHEN o_orderkey % 29 = 0 THEN 'partial' ELSE 'ok' END AS parse_status",
        )
        return base.selectExpr(
            "cast(k AS string) AS id",
            f"{pick_sql('k', SOURCES)} AS source_client",
            "o_orderpriority AS source_app",
            "concat('/r/', n_name) AS repo_root",
            "n_name AS repo_name",
            "concat('/logs/', k % 50, '.jsonl') AS source_path",
            "CASE WHEN k % 19 = 0 THEN NULL WHEN k % 23 = 0 THEN concat('[Fix  ', k, '](http://x)  now') ELSE concat('Task ', k % 1000) END AS title",
            "started_at",
            "timestampadd(SECOND, cast(secs AS int), started_at) AS ended_at",
            "if(k % 97 <> 0, secs * 1000, NULL) AS duration_ms",
            "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'partial' ELSE 'research_only' END AS session_outcome",
            f"{pick_sql('k', ['terminal_cli', 'vscode_extension', 'unknown', None, 'local_agent'])} AS detected_surface",
            "parse_status",
            "if(parse_status <> 'ok', 1L, 0L) AS parse_error_count",
            "if(k % 13 = 0, NULL, k % 6) AS file_edit_count",
            "k % 4 AS file_read_count",
            "k % 11 AS shell_command_count",
            "k % 12 AS tool_call_count",
            "k % 7 AS user_prompt_count",
            "k % 5 AS assistant_message_count",
            "k % 7 + k % 5 AS message_count",
            "k % 50 AS raw_event_count",
            "important AS important_command_failures",
            "if(k % 8 = 0, 1L, 0L) AS failed_tool_call_count",
            "k % 3 AS harmless_non_zero_events",
            "k % 2 AS exploratory_misses",
            "if(k % 45 = 0, 1L, 0L) AS repeated_failure_clusters",
            "if(k % 21 <> 0, coalesce(important, 0L) + k % 3 + k % 2, NULL) AS non_zero_command_events",
            f"{pick_sql('k', ['none', 'low', 'medium', 'high'])} AS command_issue_impact",
            f"if(coalesce(important, 0L) > 0, {pick_sql('k div 9', ['build', 'test', 'git', None])}, NULL) AS top_failure_type",
            f"{pick_sql('k', ['high', 'medium', 'low'])} AS token_confidence",
            f"{pick_sql('k', ['delta_sum', 'direct_usage', 'final_snapshot', 'estimated', 'direct_usage'])} AS token_aggregation_method",
            "array_compact(array(if(o_custkey % 7 = 0, 'repo_unverified_no_git_root', NULL), if(k % 31 = 0, 'repeated_error:x', NULL))) AS own_warnings",
        )

    @cached_property
    def sessions(self) -> DataFrame:
        """Sessions with token sums, cost, slices and the full warning set."""
        facts, costs = self.session_facts, self.costs.withColumnRenamed("session_id", "id")
        joined = facts.join(costs, "id", "left")
        zero = F.lit(0).cast("bigint")
        empty = F.array().cast("array<string>")
        none = F.col("request_count").isNull()
        price = F.when(none, F.array(F.lit("missing_token_breakdown"), F.lit("unknown_pricing"))).when(
            F.col("cost_micro").isNull(), F.concat(F.array(F.lit("unknown_pricing")), F.col("price_warnings"))
        ).otherwise(empty)
        warnings = F.array_sort(F.array_distinct(F.concat("own_warnings", price, F.coalesce("price_assumptions", empty))))
        return joined.select(
            *[c for c in facts.columns if c != "own_warnings"],
            F.col("first_model").alias("model"),
            *[F.coalesce(b, zero).alias(b) for b in pricing.BUCKETS],
            F.coalesce("request_count", zero).alias("token_snapshot_count"),
            "cost_micro",
            F.col("model_usage"),
            warnings.alias("warnings"),
        )


    # ------------------------------------------------------------ logs

    @cached_property
    def rollout_lines(self) -> DataFrame:
        """Rollout log lines (host, file, ord, line), one per event.

        view: token counts; click: a tool call; error: its output; signup: a
        message; purchase: a model, session data or a compaction.
        """
        events = self.table("events").selectExpr(
            "concat('h', user_id % 3) AS host", "concat('/logs/rollout-', user_id, '.jsonl') AS file", "event_id AS ord", "user_id AS u", "event_type AS e",
            "date_format(if(event_type = 'signup', date_trunc('DAY', cast(ts AS timestamp)), cast(ts AS timestamp)), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") AS t", "cast(get_json_object(props, '$.k') AS bigint) AS k",
            "cast(floor(value * 100) AS bigint) AS v",
        )
        counted = F.expr("if(e = 'view' AND k <> 13 AND k % 50 <> 49, v, 0L)")
        summed = running_sum(events, ["host", "file"], "ord", counted, "s")
        named = summed.selectExpr("*", "CASE WHEN k % 10 = 0 THEN s - v WHEN k % 25 = 1 THEN v ELSE s END AS n")
        def usage(n: str, sign: str = "", total: str = "") -> str:
            extra = f", 'total_tokens', {total}" if total else ""
            return f"named_struct('input_tokens', {sign}10 * {n}, 'cached_input_tokens', 2 * {n}, 'output_tokens', 3 * {n}, 'reasoning_output_tokens', {n}{extra})"

        def record(kind: str, payload: str) -> str:
            return f"to_json(named_struct('timestamp', t, 'type', '{kind}', 'payload', named_struct({payload})))"

        def counts(info: str) -> str:
            return record("event_msg", f"'type', 'token_count', 'info', named_struct({info})")

        ttl = "named_struct('ttl_30m_tokens', v, 'ttl_12h_tokens', v)"
        direct = (
            "to_json(named_struct('timestamp', t, 'type', 'response', 'usage', named_struct('prompt_tokens', 10 * v, 'prompt_tokens_details', "
            f"named_struct('cached_tokens', 2 * v, 'cache_write_tokens', v, 'cache_write_tokens_details', {ttl}), 'completion_tokens', 3 * v)))"
        )
        view = f"""CASE WHEN k = 13 THEN '{{oops'
            WHEN k % 50 = 49 THEN {counts("'last_token_usage', " + usage('v', '-'))}
            WHEN u % 4 = 0 AND k % 5 = 0 THEN {direct}
            WHEN u % 4 = 0 THEN {counts("'total_token_usage', " + usage('n', total='14 * n'))}
            ELSE {counts("'last_token_usage', " + usage('v') + ", 'total_token_usage', " + usage('n'))} END"""
        commands = pick_sql("k", ["pnpm test", "rg x", "pnpm build", "git status", "terraform plan", "ls"])
        call = record("response_item", f"'type', 'function_call', 'name', 'exec_command', 'call_id', concat('c', k % 12), 'arguments', to_json(named_struct('command', {commands}))")
        stdin = record("response_item", "'type', 'function_call', 'name', 'write_stdin', 'call_id', concat('c', k % 12), 'arguments', to_json(named_struct('session_id', k % 6))")
        text = "CASE WHEN k % 4 = 0 THEN concat('Process running with session ID ', k % 6) WHEN k % 5 = 1 THEN concat('Process exited with code ', k % 3) ELSE 'done' END"
        output = record("response_item", f"'type', 'function_call_output', 'call_id', concat('c', k % 12), 'exit_code', if(k % 5 = 1, NULL, k % 3), 'output', {text}")
        deep = "named_struct('steps', array(named_struct('first', named_struct('inner', named_struct('command', array('find', concat('x', k % 4)))))))"
        loose = record("response_item", f"'type', 'function_call_output', 'detail', {deep}, 'exit_code', k % 3")
        said = "CASE WHEN k % 20 = 1 THEN '<environment_context> <INSTRUCTIONS> x' WHEN k % 10 = 0 THEN '/compact now' ELSE concat('note  ', k % 4) END"
        user = record("event_msg", f"'type', 'user_message', 'message', {said}")
        reply = record("response_item", "'type', 'message', 'role', 'assistant', 'content', array(named_struct('type', 'output_text', 'text', 'Reply'), named_struct('type', 'output_text', 'text', 'two  words'))")
        source = pick_sql("u", ["vscode", "cli", "exec", "codex_cloud_task"])
        meta = record("session_meta", f"'id', concat('s', u), 'cwd', concat('/w/', u), 'title', concat('Run ', u), 'source', {source}, 'thread_source', if(u % 5 = 0, 'subagent', NULL)")
        compacted = record("event_msg", "'type', 'context_compacted'")
        model = record("turn_context", "'model', if(k % 2 = 0, 'gpt-6-sol', 'gpt-6.1-terra')")
        line = f"""CASE e WHEN 'view' THEN {view}
            WHEN 'click' THEN if(k % 11 = 0, {stdin}, {call})
            WHEN 'error' THEN if(k % 7 = 0, {loose}, {output})
            WHEN 'signup' THEN if(k % 3 <> 0, {user}, {reply})
            ELSE CASE k % 7 WHEN 0 THEN {compacted} WHEN 1 THEN {meta} ELSE {model} END END"""
        return named.selectExpr("host", "file", "ord", f"{line} AS line")

    @cached_property
    def rollout_records(self) -> DataFrame:
        return parse_records(self.rollout_lines, schemas.ROLLOUT)

    @cached_property
    def transcript_lines(self) -> DataFrame:
        """Transcript lines, one per line item, in two files per order."""
        lines = self.table("lineitem").selectExpr(
            "l_orderkey AS o", "l_partkey AS p", "l_suppkey AS s", "cast(l_linenumber AS bigint) AS n", "cast(l_quantity AS bigint) AS q",
            "cast(round(l_discount * 100) AS bigint) AS d", "cast(round(l_tax * 100) AS bigint) AS x", "cast(floor(l_extendedprice / 100) AS bigint) AS output",
            "l_linestatus AS st", "timestampadd(HOUR, cast(l_linenumber AS int), cast(l_shipdate AS timestamp)) AS at", "cast(unix_date(cast(l_shipdate AS date)) AS bigint) AS day",
        )
        model = pick_sql("p", [*MODELS[:10], "<synthetic>", None])
        usage = (
            "named_struct('input_tokens', if(s % 13 = 0, NULL, q * 5000), 'cache_read_input_tokens', q * d * 500, 'cache_creation_input_tokens', q * x * 100, 'cache_creation', "
            "named_struct('ephemeral_5m_input_tokens', if(s % 3 = 1, q * x * 100, 0), 'ephemeral_1h_input_tokens', if(s % 3 = 2, q * x * 200, 0)), 'output_tokens', output, "
            "'service_tier', if(s % 7 = 0, NULL, if(st = 'O', 'priority', 'standard')), 'speed', if(s % 10 = 0, 'fast', 'standard'))"
        )
        content = f"array(named_struct('type', 'text', 'name', NULL, 'text', 'working'), named_struct('type', 'tool_use', 'name', {pick_sql('n', ['Bash', 'Read', 'Edit', 'Grep'])}, 'text', NULL))"
        result = "CASE WHEN s % 5 = 0 THEN named_struct('exit_code', 1, 'status', NULL) WHEN s % 7 = 0 THEN named_struct('exit_code', NULL, 'status', 'Failed') END"
        line = f"""to_json(named_struct('type', 'assistant', 'sessionId', concat('s', o), 'requestId', if(s % 11 = 0, NULL, concat('r', o)),
            'timestamp', if(s % 17 = 0, NULL, date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")), 'toolUseResult', {result},
            'message', named_struct('id', concat('m', n), 'role', if(n % 5 = 4, 'user', 'assistant'), 'model', {model}, 'content', {content}, 'usage', {usage})))"""
        return lines.selectExpr(
            "concat('h', o % 3) AS host", "concat('/p/projects/-w-p', o % 97, '/', o, '-', s % 2, '.jsonl') AS file",
            "(day * 16384 + p % 16384) * 16384 * 8 + (s % 16384) * 8 + n AS ord", "s % 2 AS mtime_ms", f"{line} AS line",
        )

    @cached_property
    def transcript_records(self) -> DataFrame:
        return parse_records(self.transcript_lines, schemas.TRANSCRIPT)

    @cached_property
    def otel_lines(self) -> DataFrame:
        """Telemetry lines, one per line item: a trace per order, 50 files."""
        rows = self.table("lineitem").selectExpr(
            "l_orderkey AS o", "l_partkey AS p", "l_suppkey AS s", "cast(l_linenumber AS bigint) AS n", "cast(l_quantity AS bigint) AS q",
            "cast(round(l_discount * 100) AS bigint) AS d", "cast(round(l_tax * 100) AS bigint) AS x", "cast(floor(l_extendedprice / 100) AS bigint) AS output",
            "unix_seconds(cast(l_shipdate AS timestamp)) AS sec",
        )
        attributes = f"""map_filter(map_from_arrays(array('gen_ai.response.model', 'gen_ai.conversation.id', 'github.copilot.interaction_id', 'gen_ai.response.id', 'turn.index',
              'gen_ai.usage.input_tokens', 'gen_ai.usage.cache_read.input_tokens', 'gen_ai.usage.cache_write.input_tokens', 'gen_ai.usage.output_tokens', 'gen_ai.usage.reasoning_tokens', 'gen_ai.usage.total_tokens'),
            array({pick_sql('p', MODELS)}, if(p % 5 = 0, concat('conv', o), NULL), if(p % 5 IN (0, 1), concat('int', o), NULL), if(p % 5 = 2, concat('r', o % 500, '-', n), NULL), if(s % 4 = 2, cast(n AS string), NULL),
              cast(q * 50 AS string), cast(q * d AS string), cast(q * x * 9 AS string), if(n % 3 = 0, NULL, cast(output AS string)), cast(s % 100 AS string), if(n % 3 = 0, cast(q * 50 + output + s % 100 AS string), NULL))), (k, v) -> v IS NOT NULL)"""
        common = f"'traceId', concat('t', o), 'spanId', concat('s', n), 'attributes', {attributes}"
        span = "'type', 'span', 'startTime', array(sec, 250000000L), 'endTime', array(sec + n, 750000000L)"
        line = f"""CASE s % 4 WHEN 0 THEN to_json(named_struct('name', 'chat model', {span}, {common})) WHEN 1 THEN to_json(named_struct('body', 'GenAI inference: model', 'timestamp', sec * 1000 + n, {common}))
          WHEN 2 THEN to_json(named_struct('body', 'copilot_chat.agent.turn: x', 'timestamp', sec * 1000 + n, {common})) ELSE to_json(named_struct('name', 'invoke_agent x', {span}, {common})) END"""
        return rows.selectExpr("concat('h', o % 3) AS host", "concat('/c/otel/', o % 3, '-', p % 50, '.jsonl') AS file", "(o * 8 + n) * 1048576 + pmod(p * 1009 + s * 31 + output, 1048576) AS ord", f"{line} AS line")

    @cached_property
    def otel_records(self) -> DataFrame:
        return parse_records(self.otel_lines, schemas.OTEL)

    @cached_property
    def editor_records(self) -> DataFrame:
        """Editor files, one line per order: a transcript, a session state or a debug log of each customer."""
        rows = self.table("orders").selectExpr(
            "o_custkey AS c", "o_orderkey AS k", "o_orderkey % 7 AS e", "cast(floor(o_totalprice / 100) AS bigint) AS v", "unix_seconds(cast(o_orderdate AS timestamp)) AS sec",
            "concat('ed', o_custkey div 3) AS sid", "date_format(cast(o_orderdate AS timestamp), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS t",
        )
        tools = """array(named_struct('name', 'run_in_terminal', 'arguments', '{}'), named_struct('name', 'Read_thing', 'arguments', '{"command":"x"}'), named_struct('name', NULL, 'arguments', 'apply edit'))"""
        picked = pick_sql("k", ["auto", "copilot/gpt-4.1", "claude-opus-4-8"])
        attributes = f"map('gen_ai.conversation.id', sid, 'gen_ai.response.model', {pick_sql('k', ['gpt-5.4', 'claude-opus-4-8'])}, 'gen_ai.usage.input_tokens', '100', 'gen_ai.usage.output_tokens', cast(v AS string))"
        said = "to_json(named_struct('sid', NULL, 'data', named_struct('role', if(k % 2 = 0, 'user', 'assistant'), 'content', 'more  to say', 'startTime', sec)))"
        line = f"""CASE e WHEN 0 THEN to_json(named_struct('type', 'session.start', 'timestamp', t, 'data', named_struct('sessionId', if(c % 4 = 1, NULL, sid), 'title', concat('Chat ', k), 'context', named_struct('cwd', concat('/w/', c % 11)))))
          WHEN 1 THEN to_json(named_struct('type', 'user.message', 'ts', sec, 'data', named_struct('content', 'ask  it')))
          WHEN 2 THEN to_json(named_struct('type', 'assistant.message', 'data', named_struct('content', 'ok', 'outputTokens', v, 'toolRequests', {tools})))
          WHEN 3 THEN to_json(named_struct('type', 'session.model_change', 'timestamp', t, 'data', named_struct('newModel', {picked}))) WHEN 5 THEN '{{oops'
          WHEN 6 THEN if(c % 6 IN (2, 3), to_json(named_struct('type', 'span', 'name', 'chat x', 'traceId', concat('et', k), 'spanId', '1', 'startTime', array(sec, 0L), 'endTime', array(sec + 1, 0L), 'attributes', {attributes})), {said})
          ELSE {said} END"""
        file = """CASE c % 3 WHEN 0 THEN concat('/c/workspaceStorage/w', c % 7, '/GitHub.copilot-chat/transcripts/', c, '.jsonl') WHEN 1 THEN concat('/c/session-state/s', c, '/events.jsonl')
          ELSE concat('/c/workspaceStorage/w', c % 7, '/GitHub.copilot-chat/debug-logs/', c, '.jsonl') END"""
        lines = rows.selectExpr("'h0' AS host", f"{file} AS file", "k AS ord", f"{line} AS line", "1700000000000 + c * 1000 AS mtime_ms")
        folders = self.table("customer").where("c_custkey < 5").selectExpr("concat('/c/workspaceStorage/w', c_custkey) AS owner", "concat('/w/ws', c_custkey) AS fallback_cwd")
        return parse_records(editor.tagged(lines, folders), schemas.OTEL)

    @cached_property
    def key_values(self) -> DataFrame:
        """Key-value rows, one per conversation turn."""
        value = """to_json(array(named_struct('role', role, 'conversationId', concat('c', conv_id), 'timestamp', 1700000000 + conv_id * 1000 + turn, 'message', named_struct('content', text, 'workspacePath',
          concat('file:///w/', conv_id % 7)), 'model', if(turn % 3 = 0, 'gpt-5.4', NULL), 'usage', named_struct('inputTokens', 100 * (turn + 1), 'output_tokens', 10 * (conv_id % 5 + 1)), 'costUsd', 0.25)))"""
        return self.table("conversations").selectExpr(
            "'h0' AS host", "'/u/globalStorage/state.vscdb' AS file", "'ItemTable' AS `table`", "conv_id * 1000 + turn AS ord", "if(conv_id % 10 = 9, 'other', 'aichat.bubble') AS key", f"{value} AS value"
        )
