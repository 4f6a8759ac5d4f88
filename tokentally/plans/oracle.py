"""DuckDB twins of the proxy tables, as common table expressions.

The SQL states the same rules on its own: nothing here is derived from the
DataFrame code except the fixed rate values.
"""

from __future__ import annotations

import re

from tokentally import rates
from tokentally.functions import models as M
from tokentally.plans.binding import MODELS, SOURCES


def _sql(value) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def choose(number: str, values: list) -> str:
    """values[number % len(values)] as a CASE expression."""
    arms = " ".join(f"WHEN {i} THEN {_sql(v)}" for i, v in enumerate(values))
    return f"CASE ({number}) % {len(values)} {arms} END"


def _cards() -> str:
    rows = []
    for card in rates.bundled_cards():
        values = [None if card[c] is None else int(card[c] * 1_000_000) for c in rates.RATE_COLUMNS]
        rows.append("(" + ", ".join([_sql(card["model"])] + [_sql(v) if v is not None else "NULL::BIGINT" for v in values]) + ")")
    columns = ", ".join(["model"] + [f"r_{c}" for c in rates.RATE_COLUMNS])
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v({columns})"


def _rules() -> str:
    rows = ", ".join("(" + ", ".join(_sql(v) for v in rule[:5]) + ")" for rule in rates.context_rules())
    return f"SELECT * FROM (VALUES {rows}) v(base_model, threshold, long_model, unknown_size, missing_long)"


def _families() -> str:
    rows = [(200 + i, f, "claude") for i, f in enumerate(M.CLAUDE_FAMILIES)]
    rows += [(300 + i, f, "copilot") for i, f in enumerate(M.COPILOT_FAMILIES)]
    values = ", ".join("(" + ", ".join(_sql(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {values}) v(priority, card, kind)"


def norm_model(expr: str) -> str:
    out = f"regexp_replace(lower({expr}), '-[0-9]{{8}}(-fast-mode)', '\\1')"
    out = f"regexp_replace({out}, '^github_copilot/', '')"
    out = f"regexp_replace({out}, '^github-copilot/', '')"
    out = f"regexp_replace({out}, '^copilot/', '')"
    return f"regexp_replace({out}, 'claude-(opus|sonnet|haiku)-([0-9]+)\\.([0-9]+)', 'claude-\\1-\\2-\\3', 'g')"


_CLAUDE = "^(claude-(?:fable|mythos|opus|sonnet|haiku))-([0-9]+)(?:-([0-9]{1,2}))?(?:[^0-9]|$)"
_GPT = "^(gpt)-([0-9])(?:\\.([0-9]+))?(-[a-z][a-z0-9-]*)?$"


def tier_sql(mid: str) -> str:
    gpt = f"regexp_replace({mid}, '-([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{8}})$', '')"
    return (
        f"CASE WHEN contains({mid}, 'fast-mode') OR contains({mid}, '-long-context') THEN NULL "
        f"WHEN regexp_matches({mid}, '{_CLAUDE}') THEN regexp_extract({mid}, '{_CLAUDE}', 1) "
        f"WHEN regexp_matches({gpt}, '{_GPT}') THEN 'gpt' || regexp_extract({gpt}, '{_GPT}', 4) END"
    )


def version_sql(mid: str) -> str:
    gpt = f"regexp_replace({mid}, '-([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{8}})$', '')"

    def number(text: str, pattern: str) -> str:
        return (
            f"CAST(regexp_extract({text}, '{pattern}', 2) AS BIGINT) * 100 "
            f"+ coalesce(TRY_CAST(regexp_extract({text}, '{pattern}', 3) AS BIGINT), 0)"
        )

    return (
        f"CASE WHEN contains({mid}, 'fast-mode') OR contains({mid}, '-long-context') THEN NULL "
        f"WHEN regexp_matches({mid}, '{_CLAUDE}') THEN {number(mid, _CLAUDE)} "
        f"WHEN regexp_matches({gpt}, '{_GPT}') THEN {number(gpt, _GPT)} END"
    )


def cost_pico_sql(rate: str, tokens: str = "") -> str:
    """Pico-USD of one request: t(column) tokens at a rate struct's columns."""
    t = f"{tokens}." if tokens else ""
    split = f"({t}cache_write_5m + {t}cache_write_1h + {t}cache_write_30m + {t}cache_write_12h)"

    def r(column: str) -> str:
        return f"{rate}{column}"

    def positive(*names: str) -> str:
        return "coalesce(" + ", ".join(f"CASE WHEN {r(n)} > 0 THEN {r(n)} END" for n in names) + ", 0)"

    return f"""(greatest({t}input_tokens - {t}cached_input_tokens - {t}cache_write_tokens, 0)::HUGEINT * {r('input')}
      + {t}cached_input_tokens::HUGEINT * coalesce({r('cached')}, {r('input')})
      + {t}cache_write_5m::HUGEINT * {positive('write_5m', 'write', 'input')}
      + {t}cache_write_1h::HUGEINT * {positive('write_1h', 'write', 'input')}
      + {t}cache_write_30m::HUGEINT * {positive('write_30m', 'write', 'input')}
      + {t}cache_write_12h::HUGEINT * {positive('write_12h', 'write', 'input')}
      + greatest({t}cache_write_tokens - {split}, 0)::HUGEINT * {positive('write', 'write_1h', 'write_5m', 'input')}
      + {t}output_tokens::HUGEINT * {r('output')}
      + {t}reasoning_tokens::HUGEINT * coalesce({r('reasoning')}, {r('output')}))"""


def _priced(source: str, model: str) -> str:
    base, long = cost_pico_sql("b.r_", "q"), cost_pico_sql("l.r_", "q")
    size = "q.request_input_tokens"
    above = f"(c.threshold IS NOT NULL AND {size} > c.threshold)"
    unknown = f"(c.threshold IS NOT NULL AND {size} IS NULL)"
    usable = "(b.r_input > 0 AND b.r_output > 0)"
    return f"""
      SELECT q.* REPLACE ({model} AS model), c.source_model, c.inherited,
        coalesce({above} AND l.model IS NOT NULL, false) AS long_context,
        CASE WHEN {model} IS NULL OR NOT coalesce({usable}, false) THEN NULL
             WHEN {unknown} AND c.unknown_size = 'unpriced' THEN NULL
             WHEN {above} THEN {long} ELSE {base} END AS cost_pico,
        CASE WHEN {model} IS NULL THEN 'unknown_pricing'
             WHEN {unknown} AND c.unknown_size = 'unpriced' THEN 'unknown_request_context'
             WHEN NOT coalesce({usable}, false) THEN 'unknown_pricing_model:' || c.model_id END AS price_warning,
        CASE WHEN {unknown} AND c.unknown_size = 'short-context' THEN 'assumed_short_context_rates:' || c.source_model END AS price_assumption
      FROM {source} q LEFT JOIN tt_resolved c ON c.model = {model}
      LEFT JOIN tt_cards b ON b.model = c.source_model LEFT JOIN tt_cards l ON l.model = c.long_model"""


BUCKETS = [
    "input_tokens", "cached_input_tokens", "cache_write_tokens", "cache_write_5m", "cache_write_1h",
    "cache_write_30m", "cache_write_12h", "output_tokens", "reasoning_tokens", "total_tokens",
]
_SUMS = ", ".join(f"sum({b})::BIGINT AS {b}" for b in BUCKETS)
_Q, _D, _T = "l_quantity::BIGINT", "round(l_discount * 100)::BIGINT", "round(l_tax * 100)::BIGINT"

CTES = {
    "tt_cards": _cards(),
    "tt_rules": _rules(),
    "tt_families": _families(),
    "tt_requests": f"""
      SELECT *, CASE WHEN l_suppkey % 40 <> 0 THEN input_tokens END AS request_input_tokens,
        input_tokens + output_tokens + reasoning_tokens AS total_tokens
      FROM (SELECT *, {_Q} * 5000 + cached_input_tokens + cache_write_tokens AS input_tokens,
          CASE WHEN l_partkey % 12 IN (0, 1, 2, 8) THEN cache_write_tokens ELSE 0 END AS cache_write_5m, 0::BIGINT AS cache_write_1h,
          CASE WHEN l_partkey % 12 IN (3, 4, 5, 6) THEN cache_write_tokens ELSE 0 END AS cache_write_30m, 0::BIGINT AS cache_write_12h
        FROM (SELECT l_orderkey::VARCHAR AS session_id, l_orderkey AS request_id, l_linenumber::BIGINT AS message_id,
            date_diff('day', DATE '1970-01-01', l_shipdate::DATE) * 17592186044416 + l_partkey * 256 + l_linenumber AS ord,
            l_shipdate AS ts, {choose('l_partkey', MODELS)} AS model,
            CASE WHEN l_suppkey % 10 = 0 THEN 'fast' ELSE 'standard' END AS speed,
            CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_linestatus = 'O' THEN 'priority' ELSE 'Standard' END AS service_tier,
            l_suppkey, l_partkey, l_quantity,
            {_Q} * {_D} * 500 AS cached_input_tokens, {_Q} * {_T} * 100 AS cache_write_tokens,
            floor(l_extendedprice / 100)::BIGINT AS output_tokens,
            CASE WHEN l_returnflag = 'R' THEN floor(l_extendedprice / 400)::BIGINT ELSE 0 END AS reasoning_tokens
          FROM lineitem))""",
    "tt_model_ids": f"SELECT model, {norm_model('model')} AS model_id FROM (SELECT DISTINCT model FROM tt_requests WHERE model IS NOT NULL)",
    "tt_card_versions": f"SELECT model AS card, {tier_sql('model')} AS tier, {version_sql('model')} AS version FROM tt_cards WHERE r_input > 0 AND r_output > 0",
    "tt_resolved": f"""
      SELECT m.model, m.model_id, coalesce(k.card, e.card) AS source_model,
        coalesce(k.rank >= 100 AND k.card <> m.model AND k.card <> m.model_id, false) AS inherited, k.card IS NOT NULL AS priced,
        r.threshold, r.long_model, r.unknown_size
      FROM tt_model_ids m
      LEFT JOIN (
        SELECT model, arg_min(card, rank) AS card, min(rank) AS rank FROM (
          SELECT i.model, c.model AS card, CASE WHEN c.model = i.model THEN 0 ELSE 1 END AS rank
          FROM tt_model_ids i JOIN tt_cards c ON c.model IN (i.model, i.model_id) WHERE c.r_input > 0 AND c.r_output > 0
          UNION ALL
          SELECT i.model, v.card, 101 - v.version / 1000000.0 FROM tt_model_ids i
          JOIN tt_card_versions v ON v.tier = {tier_sql('i.model_id')} AND v.version <= {version_sql('i.model_id')}
          UNION ALL
          SELECT i.model, f.card, f.priority FROM tt_model_ids i JOIN tt_families f ON i.model_id = f.card OR starts_with(i.model_id, f.card || '-')
            OR (f.kind = 'claude' AND starts_with(i.model_id, f.card || '.')) OR (f.card = 'gpt-4.1' AND starts_with(i.model_id, 'gpt-41'))
          WHERE f.card IN (SELECT card FROM tt_card_versions) OR f.card IN (SELECT model FROM tt_cards WHERE r_input > 0 AND r_output > 0)
        ) GROUP BY model) k ON k.model = m.model
      LEFT JOIN (SELECT i.model, min(c.model) AS card FROM tt_model_ids i JOIN tt_cards c ON c.model IN (i.model, i.model_id) GROUP BY i.model) e ON e.model = m.model
      LEFT JOIN tt_rules r ON r.base_model = k.card""",
    "tt_priced": _priced("tt_requests", "q.model"),
    "tt_priced_session": "SELECT q.* FROM (" + _priced(
        "(SELECT r.*, f.fallback FROM tt_requests r LEFT JOIN (SELECT session_id, arg_min(model, ord) AS fallback FROM tt_requests WHERE model IS NOT NULL GROUP BY session_id) f USING (session_id))",
        "coalesce(q.model, q.fallback)") + ") q",
    "tt_slices": f"""
      SELECT session_id, model, count(*) AS request_count, min(ord) AS first_ord, {_SUMS},
        CASE WHEN count(*) = count(cost_pico) THEN ((sum(cost_pico) + 500000) // 1000000)::BIGINT END AS cost_micro
      FROM tt_priced_session GROUP BY session_id, model""",
    "tt_costs": f"""
      SELECT session_id, count(*) AS request_count, arg_min(model, ord) FILTER (WHERE model IS NOT NULL) AS first_model, {_SUMS},
        CASE WHEN count(*) = count(cost_pico) THEN ((sum(cost_pico) + 500000) // 1000000)::BIGINT END AS cost_micro,
        list(DISTINCT price_warning) FILTER (WHERE price_warning IS NOT NULL) AS price_warnings,
        list(DISTINCT price_assumption) FILTER (WHERE price_assumption IS NOT NULL) AS price_assumptions
      FROM tt_priced_session GROUP BY session_id""",
    "tt_facts": f"""
      SELECT k::VARCHAR AS id, {choose('k', SOURCES)} AS source_client, o_orderpriority AS source_app, '/r/' || n_name AS repo_root, n_name AS repo_name,
        '/logs/' || (k % 50) || '.jsonl' AS source_path,
        CASE WHEN k % 19 = 0 THEN NULL WHEN k % 23 = 0 THEN '[Fix  ' || k || '](http://x)  now' ELSE 'Task ' || (k % 1000) END AS title,
        started_at, started_at + to_seconds(secs) AS ended_at, CASE WHEN k % 97 <> 0 THEN secs * 1000 END AS duration_ms,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'partial' ELSE 'research_only' END AS session_outcome,
        {choose('k', ['terminal_cli', 'vscode_extension', 'unknown', None, 'local_agent'])} AS detected_surface,
        CASE WHEN k % 53 = 0 THEN 'failed' WHEN k % 29 = 0 THEN 'partial' ELSE 'ok' END AS parse_status,
        CASE WHEN k % 53 = 0 OR k % 29 = 0 THEN 1 ELSE 0 END::BIGINT AS parse_error_count,
        CASE WHEN k % 13 = 0 THEN NULL ELSE k % 6 END AS file_edit_count, k % 4 AS file_read_count, k % 11 AS shell_command_count,
        k % 12 AS tool_call_count, k % 7 AS user_prompt_count, k % 5 AS assistant_message_count, k % 7 + k % 5 AS message_count, k % 50 AS raw_event_count,
        important AS important_command_failures, CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END::BIGINT AS failed_tool_call_count,
        k % 3 AS harmless_non_zero_events, k % 2 AS exploratory_misses, CASE WHEN k % 45 = 0 THEN 1 ELSE 0 END::BIGINT AS repeated_failure_clusters,
        CASE WHEN k % 21 <> 0 THEN coalesce(important, 0) + k % 3 + k % 2 END AS non_zero_command_events,
        {choose('k', ['none', 'low', 'medium', 'high'])} AS command_issue_impact,
        CASE WHEN important > 0 THEN {choose('k // 9', ['build', 'test', 'git', None])} END AS top_failure_type,
        {choose('k', ['high', 'medium', 'low'])} AS token_confidence,
        {choose('k', ['delta_sum', 'direct_usage', 'final_snapshot', 'estimated', 'direct_usage'])} AS token_aggregation_method,
        list_concat(CASE WHEN o_custkey % 7 = 0 THEN ['repo_unverified_no_git_root'] ELSE [] END, CASE WHEN k % 31 = 0 THEN ['repeated_error:x'] ELSE [] END) AS own_warnings
      FROM (SELECT o.*, n_name, o_orderkey AS k, CASE WHEN o_orderkey % 97 <> 0 THEN o_orderdate + to_hours(o_orderkey % 24) END AS started_at,
          floor(o_totalprice)::BIGINT % 14400 AS secs,
          CASE WHEN o_orderkey % 9 = 0 THEN 2 WHEN o_orderkey % 17 = 0 THEN NULL ELSE 0 END::BIGINT AS important
        FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "tt_sessions": f"""
      SELECT f.* EXCLUDE (own_warnings), c.first_model AS model, {', '.join(f'coalesce(c.{b}, 0) AS {b}' for b in BUCKETS)},
        coalesce(c.request_count, 0) AS token_snapshot_count, c.cost_micro,
        list_sort(list_distinct(list_concat(list_concat(own_warnings,
          CASE WHEN c.session_id IS NULL THEN ['missing_token_breakdown', 'unknown_pricing']
               WHEN c.cost_micro IS NULL THEN list_concat(['unknown_pricing'], coalesce(c.price_warnings, [])) ELSE [] END),
          coalesce(c.price_assumptions, [])))) AS warnings
      FROM tt_facts f LEFT JOIN tt_costs c ON c.session_id = f.id""",
}


CTES |= {
    "tt_ev": """
      SELECT 'h' || (user_id % 3) AS host, '/logs/rollout-' || user_id || '.jsonl' AS file, event_id AS ord, user_id AS u, event_type AS e,
        epoch_us(CASE WHEN event_type = 'signup' THEN date_trunc('day', ts) ELSE ts END) // 1000 AS ms, json_extract(props, '$.k')::BIGINT AS k, floor(value * 100)::BIGINT AS v FROM events""",
    "tt_log": """
      SELECT *, CASE WHEN k % 10 = 0 THEN s - v WHEN k % 25 = 1 THEN v ELSE s END AS n
      FROM (SELECT *, sum(CASE WHEN e = 'view' AND k <> 13 AND k % 50 <> 49 THEN v ELSE 0 END) OVER (PARTITION BY file ORDER BY ord)::BIGINT AS s FROM tt_ev)""",
    "tt_usage": """
      SELECT host, file, ord, kind, sign * 10 * x AS input_tokens, 2 * x AS cached_input_tokens, CASE WHEN kind = 'direct' THEN 2 * x ELSE 0 END AS cache_write_tokens,
        CASE WHEN kind = 'direct' THEN x ELSE 0 END AS cache_write_30m, CASE WHEN kind = 'direct' THEN x ELSE 0 END AS cache_write_12h,
        CASE WHEN kind = 'direct' THEN 3 * x ELSE 2 * x END AS output_tokens, CASE WHEN kind = 'direct' THEN 0 ELSE x END AS reasoning_tokens,
        CASE WHEN kind = 'cumulative' THEN 14 * x WHEN sign < 0 THEN -7 * x ELSE 13 * x END AS total_tokens, x, CASE WHEN kind = 'delta' AND sign > 0 AND n <> 0 THEN n END AS snap
      FROM (SELECT *, CASE WHEN kind = 'cumulative' THEN n ELSE v END AS x
        FROM (SELECT *, CASE WHEN k % 50 = 49 THEN 'delta' WHEN u % 4 = 0 AND k % 5 = 0 THEN 'direct' WHEN u % 4 = 0 THEN 'cumulative' ELSE 'delta' END AS kind,
            CASE WHEN k % 50 = 49 THEN -1 ELSE 1 END AS sign FROM tt_log WHERE e = 'view' AND k <> 13)) WHERE x <> 0""",
    "tt_valid": "SELECT * FROM tt_usage WHERE input_tokens >= 0",
    "tt_direct": """
      SELECT *, row_number() OVER (PARTITION BY file ORDER BY ord) AS rn FROM tt_valid WHERE file NOT IN (SELECT file FROM tt_valid WHERE kind = 'cumulative')""",
    "tt_fold": """
      SELECT file, rn, ord, true AS kept, snap AS prev FROM tt_direct WHERE rn = 1
      UNION ALL
      SELECT d.file, d.rn, d.ord, d.keep, CASE WHEN d.keep AND d.snap IS NOT NULL THEN d.snap ELSE d.prev END
      FROM (SELECT t.file, t.rn, t.ord, t.snap, f.prev, NOT (t.snap IS NOT NULL AND f.prev IS NOT NULL AND (t.snap = f.prev
          OR (t.snap < f.prev AND (t.snap * 100 >= f.prev * 98 OR (t.snap * 4 >= f.prev * 3 AND t.snap + 2 * t.x >= f.prev))))) AS keep
        FROM tt_fold f JOIN tt_direct t ON t.file = f.file AND t.rn = f.rn + 1) d""",
    "tt_models": "SELECT host, file, ord, CASE WHEN k % 2 = 0 THEN 'gpt-6-sol' ELSE 'gpt-6.1-terra' END AS model FROM tt_ev WHERE e = 'purchase' AND k % 7 > 1",
    "tt_said": """
      SELECT host, file, ord, ms, CASE WHEN k % 3 <> 0 THEN 'user' ELSE 'assistant' END AS role,
        CASE WHEN k % 3 = 0 THEN 'Reply two words' WHEN k % 10 = 0 THEN '/compact now' ELSE 'note ' || (k % 4) END AS text
      FROM tt_ev WHERE e = 'signup' AND NOT (k % 3 <> 0 AND k % 20 = 1)""",
    "tt_calls": f"""
      SELECT host, file, ord, 'c' || (k % 12) AS cid, CASE WHEN k % 11 = 0 THEN k % 6 END AS process,
        CASE WHEN k % 11 = 0 THEN 'write_stdin session ' || (k % 6) ELSE {choose('k', ["pnpm test", "rg x", "pnpm build", "git status", "terraform plan", "ls"])} END AS own FROM tt_ev WHERE e = 'click'""",
    "tt_outs": """
      SELECT o.file, o.ord, o.process, max(c.ord) AS owner FROM (SELECT file, ord, 'c' || (k % 12) AS cid, k % 6 AS process FROM tt_ev WHERE e = 'error' AND k % 7 <> 0 AND k % 4 = 0) o
      JOIN tt_calls c ON c.file = o.file AND c.cid = o.cid AND c.ord < o.ord GROUP BY ALL""",
    "tt_links": """
      SELECT c.*, (SELECT arg_max(o.owner, o.ord) FROM tt_outs o WHERE o.file = c.file AND o.process = c.process AND o.ord < c.ord) AS target FROM tt_calls c""",
    "tt_chain": """
      SELECT file, ord, cid, own AS command FROM tt_links WHERE target IS NULL
      UNION ALL SELECT l.file, l.ord, l.cid, c.command FROM tt_chain c JOIN tt_links l ON l.file = c.file AND l.target = c.ord""",
    "tt_pairs": "SELECT file, cid, arg_max(command, ord) AS command FROM tt_chain GROUP BY 1, 2",
    "tt_exits": """
      SELECT e.host, e.file, e.ord, e.k, p.command AS paired, CASE WHEN e.k % 7 = 0 THEN 'find x' || (e.k % 4) END AS loose,
        CASE WHEN e.k % 7 = 0 THEN '' WHEN e.k % 4 = 0 THEN 'process running with session id ' || (e.k % 6) WHEN e.k % 5 = 1 THEN 'process exited with code ' || (e.k % 3) ELSE 'done' END AS output,
        CASE WHEN e.k % 7 = 0 THEN '"command":["find","x' || (e.k % 4) ELSE '' END AS raw, strftime(make_timestamp(e.ms * 1000), '%Y-%m-%dt%H:%M:%S.%gz') AS t
      FROM tt_ev e LEFT JOIN tt_pairs p ON p.file = e.file AND p.cid = 'c' || (e.k % 12) AND e.k % 7 <> 0
      WHERE e.e = 'error' AND CASE WHEN e.k % 7 = 0 OR e.k % 5 <> 1 THEN e.k % 3 <> 0 ELSE e.k % 4 <> 0 AND e.k % 3 <> 0 END""",
    "tt_class": """
      SELECT *, CASE WHEN category = 'git' OR category = 'search' THEN true ELSE false END AS harmless FROM (
        SELECT *, CASE paired WHEN 'pnpm test' THEN 'test' WHEN 'pnpm build' THEN 'build' WHEN 'git status' THEN 'git' WHEN 'rg x' THEN 'search' WHEN 'ls' THEN 'filesystem' WHEN 'terraform plan' THEN 'unknown'
            ELSE CASE WHEN paired IS NOT NULL THEN 'unknown' WHEN k % 7 = 0 THEN 'search' ELSE 'unknown' END END AS category,
          coalesce(paired, loose, '{"timestamp":"' || t || '","type":"response_item","payload":{"type":"function_call_output","call_id":"c' || (k % 12) || '"' || CASE WHEN k % 5 = 1 THEN '' ELSE ',"exit_code":' || (k % 3) END
            || ',"output":"' || output || '"}}') AS command FROM tt_exits)""",
    "tt_issue0": """
      SELECT *, CASE WHEN harmless THEN CASE WHEN category = 'search' THEN 'exploratory_miss' ELSE 'harmless_nonzero' END WHEN category IN ('test', 'build') THEN 'blocking_failure'
          WHEN category = 'filesystem' THEN 'exploratory_miss' ELSE 'unknown' END AS kind0,
        CASE WHEN harmless OR category = 'filesystem' THEN 'ignored' WHEN category IN ('test', 'build') THEN 'warning' ELSE 'info' END AS severity0,
        CASE WHEN category IN ('test', 'build') THEN 'high' ELSE 'low' END AS impact0, row_number() OVER (PARTITION BY file, command ORDER BY ord) AS nth FROM tt_class""",
    "tt_issue1": """
      SELECT *, CASE WHEN again THEN 'blocking_failure' ELSE kind0 END AS kind1, CASE WHEN again THEN 'critical' ELSE severity0 END AS severity1, CASE WHEN again THEN 'high' ELSE impact0 END AS impact1
      FROM (SELECT *, nth >= 3 AND NOT harmless AS again FROM tt_issue0)""",
    "tt_issues": """
      SELECT *, CASE WHEN clustered THEN 'blocking_failure' ELSE kind1 END AS classification, CASE WHEN clustered THEN 'critical' ELSE severity1 END AS severity, CASE WHEN clustered THEN 'high' ELSE impact1 END AS impact
      FROM (SELECT *, kind1 NOT IN ('harmless_nonzero', 'exploratory_miss') AND count(*) FILTER (WHERE kind1 NOT IN ('harmless_nonzero', 'exploratory_miss')) OVER (PARTITION BY file, command) >= 3 AS clustered FROM tt_issue1)""",
}


CTES |= {
    "tt_turns": f"""
      SELECT 'h' || (o % 3) AS host, '/p/projects/-w-p' || (o % 97) || '/' || o || '-' || (s % 2) || '.jsonl' AS file, (day * 16384 + p % 16384) * 16384 * 8 + (s % 16384) * 8 + n AS ord, s % 2 AS mtime_ms,
        CASE WHEN s % 17 <> 0 THEN moment END AS moment, {choose('p', [*MODELS[:10], None, None])} AS model, CASE WHEN s % 11 <> 0 THEN 'r' || o || ':m' || n END AS request_key,
        CASE WHEN s % 13 = 0 THEN 0 ELSE q * 5000 END AS raw_input, s % 13 <> 0 AS has_input, q * d * 500 AS cache_read, q * x * 100 AS cache_created, CASE WHEN s % 3 = 1 THEN q * x * 100 ELSE 0 END AS created_5m,
        CASE WHEN s % 3 = 2 THEN q * x * 200 ELSE 0 END AS created_1h, output AS raw_output, CASE WHEN s % 10 = 0 THEN 'fast' ELSE 'standard' END AS speed, o, s, n
      FROM (SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber::BIGINT AS n, l_quantity::BIGINT AS q, round(l_discount * 100)::BIGINT AS d, round(l_tax * 100)::BIGINT AS x,
          floor(l_extendedprice / 100)::BIGINT AS output, l_shipdate + to_hours(l_linenumber) AS moment, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS day FROM lineitem)""",
    "tt_once": """
      SELECT host, arg_min(file, r) AS file, arg_min(ord, r) AS ord, arg_min(moment, r) FILTER (WHERE r = 1) AS moment, arg_min(model, r) FILTER (WHERE r = 1) AS model, request_key, max(raw_input) AS raw_input, bool_or(has_input) AS has_input,
        max(cache_read) AS cache_read, max(cache_created) AS cache_created, max(created_5m) AS created_5m, max(created_1h) AS created_1h, max(raw_output) AS raw_output, arg_min(speed, r) AS speed, count(*) AS copies
      FROM (SELECT *, row_number() OVER (PARTITION BY host, request_key ORDER BY mtime_ms, file, ord) AS r FROM tt_turns WHERE request_key IS NOT NULL) GROUP BY host, request_key
      UNION ALL SELECT host, file, ord, moment, model, NULL, raw_input, has_input, cache_read, cache_created, created_5m, created_1h, raw_output, speed, 1 FROM tt_turns WHERE request_key IS NULL""",
    "tt_once_buckets": """
      SELECT *, raw_input + cache_read + written AS input_tokens, cache_read AS cached_input_tokens, written AS cache_write_tokens, created_5m AS cache_write_5m, created_1h AS cache_write_1h, raw_output AS output_tokens
      FROM (SELECT *, greatest(cache_created, created_5m + created_1h) AS written FROM tt_once)""",
    "tt_spans": f"""
      SELECT 'h' || (o % 3) AS host, '/c/otel/' || (o % 3) || '-' || (p % 50) || '.jsonl' AS file, (o * 8 + n) * 1048576 + (p * 1009 + s * 31 + output) % 1048576 AS ord, s % 4 AS rank, 't' || o AS trace_id, 's' || n AS span_id,
        (['chat_span', 'inference_log', 'agent_turn_log', 'agent_summary_span'])[s % 4 + 1] AS source, CASE WHEN p % 5 = 2 THEN 'r' || (o % 500) || '-' || n END AS response_id, {choose('p', MODELS)} AS own_model,
        CASE p % 5 WHEN 0 THEN 'conv' || o WHEN 1 THEN 'int' || o WHEN 2 THEN 'r' || (o % 500) || '-' || n END AS own_session, CASE p % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS priority,
        q * 50 AS input_tokens, q * d AS cached_input_tokens, q * x * 9 AS cache_write_tokens, output AS output_tokens, s % 100 AS reasoning_tokens,
        CASE WHEN s % 4 IN (0, 3) THEN (sec + n) * 1000 + 750 ELSE sec * 1000 + n END AS at_ms, n
      FROM (SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber::BIGINT AS n, l_quantity::BIGINT AS q, round(l_discount * 100)::BIGINT AS d, round(l_tax * 100)::BIGINT AS x,
          floor(l_extendedprice / 100)::BIGINT AS output, epoch(l_shipdate)::BIGINT AS sec FROM lineitem)""",
    "tt_contexts": """
      SELECT m.file, m.trace_id, m.trace_model, s.trace_session FROM (SELECT file, trace_id, arg_min(own_model, ord) FILTER (WHERE own_model IS NOT NULL) AS trace_model FROM tt_spans GROUP BY 1, 2) m
      LEFT JOIN (SELECT file, trace_id, own_session AS trace_session FROM (SELECT *, row_number() OVER (PARTITION BY file, trace_id ORDER BY priority DESC, ord) AS r FROM tt_spans WHERE own_session IS NOT NULL) WHERE r = 1) s
        ON s.file = m.file AND s.trace_id = m.trace_id""",
    "tt_candidates": """
      SELECT s.*, coalesce(own_session, trace_session, s.trace_id) AS session_id, coalesce(own_model, trace_model) AS model,
        CASE WHEN rank IN (0, 3) THEN s.trace_id || ':' || span_id WHEN rank = 1 THEN 'log:' || s.trace_id || ':' || span_id ELSE 'agent-turn:' || s.trace_id || ':' || n END AS dedup_key
      FROM tt_spans s JOIN tt_contexts c ON c.file = s.file AND c.trace_id = s.trace_id""",
    "tt_emitted": """
      SELECT * FROM (SELECT *, min(rank) OVER (PARTITION BY file, trace_id) AS bt, CASE WHEN response_id IS NOT NULL THEN min(rank) OVER (PARTITION BY file, response_id) ELSE rank END AS br FROM tt_candidates) WHERE rank <= bt AND rank <= br""",
    "tt_unique": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, dedup_key ORDER BY ord) AS first FROM tt_emitted) WHERE first = 1",
    "tt_merged": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, session_id, dedup_key ORDER BY file, ord) AS pick FROM tt_unique) WHERE pick = 1",
}


def with_ctes(body: str) -> str:
    """The query with every tt_ table it names defined in front of it."""
    needed: dict[str, None] = {}
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\btt_\w+", text)):
            if name in CTES and name not in seen:
                seen.add(name)  # a recursive table names itself
                visit(CTES[name])
                needed[name] = None

    visit(body)
    if not needed:
        return body
    own = body.strip()
    glue = ", " + own[5:] if own.startswith("WITH ") else " " + own
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({CTES[n]})" for n in needed) + glue


# ---------------------------------------------------------------- display text

def compact_sql(v: str) -> str:
    arms = [f"WHEN {v} < 1000 THEN format('{{:,}}', ({v})::BIGINT)"]
    for size, suffix, limit in ((1000, "K", 10**6), (10**6, "M", 10**9), (10**9, "B", 10**12), (10**12, "T", None)):
        tenths = f"(({v} * 10 + {size // 2}) // {size})"
        shown = f"format('{{:,}}', ({tenths} // 10)::BIGINT) || CASE WHEN {tenths} % 10 = 0 THEN '' ELSE '.' || ({tenths} % 10) END || '{suffix}'"
        arms.append(f"WHEN {v} < {limit} THEN {shown}" if limit else f"ELSE {shown}")
    return f"(CASE {' '.join(arms)} END)"


def count_sql(v: str, noun: str) -> str:
    plural = noun if noun.endswith("s") else noun + "s"
    return f"({compact_sql(v)} || ' ' || CASE WHEN {v} = 1 THEN '{noun}' ELSE '{plural}' END)"


def percent_sql(part: str, whole: str) -> str:
    tenths = f"coalesce(({part} * 1000 + {whole} // 2) // nullif({whole}, 0), 0)"
    return f"(({tenths} // 10) || CASE WHEN {tenths} % 10 = 0 THEN '' ELSE '.' || ({tenths} % 10) END || '%')"


def money_sql(micro: str) -> str:
    cents = f"(({micro} + 5000) // 10000)"
    return (
        f"(CASE WHEN {micro} IS NULL THEN 'Not priced' WHEN {micro} > 0 AND {micro} < 10000 THEN '<$0.01 USD' "
        f"ELSE '$' || format('{{:,}}', ({cents} // 100)::BIGINT) || '.' || lpad(({cents} % 100)::VARCHAR, 2, '0') || ' USD' END)"
    )
