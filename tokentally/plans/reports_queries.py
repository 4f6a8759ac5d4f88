"""Second-level reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentally import rates
from tokentally.operators import filters as X
from tokentally.operators import groups as G
from tokentally.operators import pricing, reports, sorts
from tokentally.plans.binding import Tables
from tokentally.plans.filters_queries import IMPORTANT, REVIEW, outliers_sql
from tokentally.plans.groups_queries import COUNTS, ROLLUP, SLICED, TOKENS, shown, usd
from tokentally.plans.oracle import choose
from tokentally.plans.registry import query
from tokentally.runtime import local_table

SPEND = f"count(*) AS session_count, sum(total_tokens)::BIGINT AS total_tokens, sum(cost_micro)::BIGINT AS cost_micro, {COUNTS}, count(*) FILTER (WHERE total_tokens <= 0) AS missing_token_sessions"
SOURCE_ROWS = [("codex", "Codex"), ("claude", "Claude Code"), ("copilot", "GitHub Copilot"), ("gemini-cli", "Gemini CLI")]
SOURCE_LABEL = "CASE {} WHEN 'codex' THEN 'Codex' WHEN 'claude' THEN 'Claude Code' WHEN 'copilot' THEN 'GitHub Copilot' WHEN 'cursor' THEN 'Cursor' WHEN 'gemini-cli' THEN 'Gemini CLI' ELSE 'Unknown' END"
BY_SOURCE = f"""
SELECT coalesce(k.id, u.id) AS id, {SOURCE_LABEL.format('coalesce(k.id, u.id)')} AS label, {usd('cost_micro')} AS cost_usd, coalesce(session_count, 0) AS session_count, coalesce(total_tokens, 0) AS total_tokens,
  coalesce(known_cost_sessions, 0) AS known_cost_sessions, coalesce(unknown_cost_sessions, 0) AS unknown_cost_sessions, coalesce(missing_token_sessions, 0) AS missing_token_sessions
FROM (VALUES ('codex'), ('claude'), ('copilot'), ('gemini-cli')) k(id) FULL JOIN (SELECT source_client AS id, {SPEND} FROM tt_sessions GROUP BY 1) u ON u.id = k.id"""


def _by_source(t: Tables) -> DataFrame:
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.StringType())])
    return reports.usage_by_source(t.sessions, local_table(t.spark, SOURCE_ROWS, schema))


@query("sources_with_usage", BY_SOURCE)
def _(t: Tables) -> DataFrame:
    return shown(_by_source(t))


@query("usage_by_source", f"SELECT id, session_count, total_tokens, cost_usd FROM ({BY_SOURCE}) WHERE session_count > 0")
def _(t: Tables) -> DataFrame:
    return shown(_by_source(t)).where("session_count > 0").select("id", "session_count", "total_tokens", "cost_usd")


@query("usage_by_app", f"SELECT id, id AS label, * EXCLUDE (id, cost_micro), {usd('cost_micro')} AS cost_usd FROM (SELECT source_app AS id, {SPEND} FROM tt_sessions GROUP BY 1)")
def _(t: Tables) -> DataFrame:
    return shown(reports.usage_by_app(t.sessions))


METHOD = "CASE {} WHEN 'final_snapshot' THEN 'Final checkpoint' WHEN 'delta_sum' THEN 'Delta sum' WHEN 'direct_usage' THEN 'Direct usage' WHEN 'estimated' THEN 'Estimated' ELSE 'Unknown' END"


@query("token_stats", f"""
WITH m AS (SELECT token_aggregation_method AS v, count(*) AS n FROM tt_sessions GROUP BY 1), c AS (SELECT token_confidence AS v, count(*) AS n FROM tt_sessions GROUP BY 1)
SELECT (SELECT {METHOD.format('v')} FROM m ORDER BY n DESC, v LIMIT 1) AS method_label,
  (SELECT CASE v WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium' ELSE 'Low' END FROM c ORDER BY n DESC, v LIMIT 1) AS confidence_label,
  (SELECT string_agg(v || '=' || n, ';' ORDER BY n DESC, v) FROM m) AS method_counts, (SELECT string_agg(v || '=' || n, ';' ORDER BY n DESC, v) FROM c) AS confidence_counts,
  sum(token_snapshot_count)::BIGINT AS token_snapshots, count(*) FILTER (WHERE total_tokens > 0) AS sessions_with_token_data, count(*) FILTER (WHERE total_tokens <= 0) AS sessions_missing_token_data
FROM tt_sessions""")
def _(t: Tables) -> DataFrame:
    return reports.token_stats(t.sessions)


# ---------------------------------------------------------------- models

PROVIDER = "CASE WHEN contains(id, 'claude') THEN 'Claude' WHEN contains(id, 'gemini') THEN 'Custom' WHEN starts_with(id, 'gpt-') THEN 'OpenAI' ELSE 'Custom' END"
MODEL_ROWS = f"""(
SELECT g.*, CASE WHEN g.id = 'unknown-model' THEN 'Model not recorded' ELSE g.id END AS label, {PROVIDER} AS provider_label,
  CASE WHEN input_tokens > 0 THEN cached_input_tokens::DOUBLE / input_tokens::DOUBLE ELSE 0 END AS cache_rate,
  cost_micro::DOUBLE / 1000000.0 / session_count::DOUBLE AS average_cost_usd, top_repo, latest_session
FROM (SELECT mid AS id, sum(cost_micro)::BIGINT AS cost_micro, {COUNTS}, {TOKENS}, count(*) AS session_count, sum(message_count)::BIGINT AS message_count FROM {SLICED} GROUP BY 1) g
LEFT JOIN (SELECT mid, repo_root AS top_repo FROM (SELECT mid, repo_root, row_number() OVER (PARTITION BY mid ORDER BY coalesce(sum(cost_micro), 0) DESC, sum(total_tokens) DESC, repo_root) AS n
    FROM {SLICED} GROUP BY 1, 2 HAVING sum(total_tokens) > 0 OR sum(cost_micro) > 0) WHERE n = 1) r ON r.mid = g.id
LEFT JOIN (SELECT mid, id AS latest_session FROM (SELECT mid, id, row_number() OVER (PARTITION BY mid ORDER BY coalesce(started_at, ended_at) DESC NULLS LAST, id DESC) AS n FROM {SLICED}) WHERE n = 1) z ON z.mid = g.id)"""


@query("model_usage", f"SELECT * EXCLUDE (cost_micro), {usd('cost_micro')} AS cost_usd FROM {MODEL_ROWS}")
def _(t: Tables) -> DataFrame:
    return shown(reports.model_usage(t.sessions))


@query("sort_models", f"SELECT id, label, cache_rate, {usd('cost_micro')} AS cost_usd, row_number() OVER (ORDER BY cache_rate DESC, id) - 1 AS position FROM {MODEL_ROWS}")
def _(t: Tables) -> DataFrame:
    return shown(sorts.with_position(sorts.sort_models(reports.model_usage(t.sessions), "cache", descending=True).select("id", "label", "cache_rate", "cost_micro")))


LEADERS = ["cache_rate", "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_tokens"]


@query("model_leaders", "SELECT " + ", ".join(f"(SELECT id FROM {MODEL_ROWS} ORDER BY {k} DESC, id LIMIT 1) AS top_{k}" for k in LEADERS)
       + f", (SELECT count(*) FROM {MODEL_ROWS} WHERE cost_micro IS NULL AND total_tokens > 0) AS models_with_unknown_cost")
def _(t: Tables) -> DataFrame:
    return reports.model_leaders(reports.model_usage(t.sessions))


@query("model_share", f"""
SELECT id, label, total_tokens AS value, total_tokens::DOUBLE / (SELECT sum(total_tokens)::BIGINT::DOUBLE FROM {MODEL_ROWS} WHERE total_tokens > 0) AS share
FROM {MODEL_ROWS} WHERE total_tokens > 0 ORDER BY total_tokens DESC, id LIMIT 8""")
def _(t: Tables) -> DataFrame:
    return reports.model_share(G.by_model(t.sessions), "total_tokens", 8)


# ---------------------------------------------------------------- repos

@query("repo_model_breakdown", f"""
SELECT g.repo_root, g.model, session_count, total_tokens, {usd('g.cost_micro')} AS cost_usd,
  CASE WHEN r.cost > 0 AND g.cost_micro IS NOT NULL THEN g.cost_micro::DOUBLE / r.cost::DOUBLE ELSE 0 END AS cost_share
FROM (SELECT repo_root, mid AS model, count(*) AS session_count, sum(total_tokens)::BIGINT AS total_tokens, sum(cost_micro)::BIGINT AS cost_micro FROM {SLICED} GROUP BY 1, 2) g
JOIN (SELECT repo_root, sum(cost_micro)::BIGINT AS cost FROM tt_sessions GROUP BY 1) r USING (repo_root)""")
def _(t: Tables) -> DataFrame:
    return shown(reports.repo_model_breakdown(t.sessions))


@query("repo_daily", f"""
SELECT repo_root, coalesce(strftime(coalesce(started_at, ended_at), '%Y-%m-%d'), 'Unknown') AS day, {usd('coalesce(sum(cost_micro), 0)')} AS cost_usd, sum(total_tokens)::BIGINT AS total_tokens
FROM tt_sessions GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return shown(reports.repo_daily(t.sessions))


@query("repo_command_totals", f"""
SELECT repo_root, sum({IMPORTANT})::BIGINT AS important, sum(harmless_non_zero_events + exploratory_misses)::BIGINT AS harmless, sum(repeated_failure_clusters)::BIGINT AS repeated
FROM tt_facts GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return reports.repo_command_totals(t.session_facts)


NOISY = f"({IMPORTANT} <> 0 OR harmless_non_zero_events + exploratory_misses <> 0 OR repeated_failure_clusters <> 0)"


@query("friction_by_repo", f"""
SELECT repo_root, min(repo_name) AS repo_name, sum({IMPORTANT})::BIGINT AS important_failures, sum(harmless_non_zero_events + exploratory_misses)::BIGINT AS harmless_non_zero_events,
  sum(repeated_failure_clusters)::BIGINT AS repeated_failure_clusters, count(*) FILTER (WHERE {REVIEW}) AS sessions_needing_review, sum(total_tokens)::BIGINT AS total_tokens,
  arg_min(top_failure_type, id) FILTER (WHERE top_failure_type IS NOT NULL) AS top_failure_type, {usd('sum(cost_micro)')} AS cost_usd,
  {choose("max(list_position(['none', 'low', 'medium', 'high'], command_issue_impact)) - 1", ['none', 'low', 'medium', 'high'])} AS impact
FROM tt_sessions WHERE {NOISY} GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return shown(reports.friction_by_repo(t.sessions))


@query("friction_overview", f"""
WITH r AS (SELECT repo_root, bool_or({NOISY}) AS affected, sum({IMPORTANT}) AS important, sum(repeated_failure_clusters) AS clusters, sum(total_tokens) AS tokens,
    count(*) FILTER (WHERE {REVIEW}) AS review FROM tt_sessions GROUP BY 1),
top AS (SELECT repo_root FROM r WHERE affected AND (important > 0 OR clusters > 0 OR review > 0) ORDER BY important DESC, clusters DESC, tokens DESC, repo_root LIMIT 1),
w AS (SELECT id, repo_root, {IMPORTANT} AS i, repeated_failure_clusters AS c, total_tokens AS t FROM tt_sessions WHERE {REVIEW})
SELECT (SELECT count(*) FROM w) AS review_sessions, (SELECT count(*) FROM tt_sessions WHERE {IMPORTANT} = 0 AND (harmless_non_zero_events > 0 OR exploratory_misses > 0)) AS harmless_sessions,
  (SELECT count(*) FROM r WHERE affected) AS affected_repos, (SELECT {usd('sum(cost_micro)')} FROM tt_sessions WHERE {REVIEW}) AS cost_usd, (SELECT repo_root FROM top) AS top_review_repo,
  (SELECT id FROM w ORDER BY repo_root = (SELECT repo_root FROM top) DESC, i DESC, c DESC, t DESC, id LIMIT 1) AS top_review_session""")
def _(t: Tables) -> DataFrame:
    return shown(reports.friction_overview(t.sessions))


@query("repo_cost_concentration", f"""
SELECT r.repo_root, {usd('top_cost')} AS top_cost_usd, {usd('three_cost')} AS three_cost_usd, coalesce(top_sessions, '') AS top_sessions,
  CASE WHEN total > 0 THEN coalesce(top_cost, 0)::DOUBLE / total::DOUBLE ELSE 0 END AS top_share, CASE WHEN total > 0 THEN coalesce(three_cost, 0)::DOUBLE / total::DOUBLE ELSE 0 END AS three_share,
  CASE WHEN total > 0 THEN coalesce(top_cost, 0)::DOUBLE / total::DOUBLE ELSE 0 END >= 0.5 AS extreme
FROM (SELECT repo_root, coalesce(sum(cost_micro), 0)::BIGINT AS total FROM tt_sessions GROUP BY 1) r
LEFT JOIN (SELECT repo_root, max(cost_micro) AS top_cost, sum(cost_micro)::BIGINT AS three_cost, string_agg(id, ';' ORDER BY n) AS top_sessions
  FROM (SELECT repo_root, id, cost_micro, row_number() OVER (PARTITION BY repo_root ORDER BY cost_micro DESC, id) AS n FROM tt_sessions WHERE cost_micro IS NOT NULL) WHERE n <= 3 GROUP BY 1) x USING (repo_root)""")
def _(t: Tables) -> DataFrame:
    rows = reports.repo_cost_concentration(t.sessions)
    for name in ("top_cost", "three_cost"):
        rows = rows.withColumn(f"{name}_usd", pricing.micro_to_usd(F.col(name))).drop(name)
    return rows


@query("repo_warnings", """
SELECT g.repo_root, array_to_string(list_sort(list_distinct(list_concat(coalesce(w.list, []), list_filter([
  CASE WHEN cost > 0 AND max_cost::DOUBLE / cost::DOUBLE > 0.5 THEN 'expensive_session_concentration' END, CASE WHEN i > 0 AND c::DOUBLE / i < 0.1 THEN 'low_cache_rate' END,
  CASE WHEN t > 0 AND o::DOUBLE / t > 0.5 THEN 'output_heavy_sessions' END, CASE WHEN unpriced THEN 'unknown_pricing' END], lambda x: x IS NOT NULL)))), ';') AS warnings
FROM (SELECT repo_root, sum(cost_micro) AS cost, max(cost_micro) AS max_cost, sum(input_tokens) AS i, sum(cached_input_tokens) AS c, sum(output_tokens) AS o, sum(total_tokens) AS t,
    bool_or(cost_micro IS NULL) AS unpriced FROM tt_sessions GROUP BY 1) g
LEFT JOIN (SELECT k, list(w) AS list FROM (SELECT DISTINCT repo_root AS k, unnest(warnings) AS w FROM tt_sessions) GROUP BY k) w ON w.k = g.repo_root""")
def _(t: Tables) -> DataFrame:
    return shown(reports.repo_warnings(t.sessions))


@query("repo_metadata", """
SELECT repo_root, count(DISTINCT source_path) AS source_paths, coalesce(sum(file_edit_count), 0)::BIGINT AS edits, sum(file_read_count)::BIGINT AS reads,
  count(*) FILTER (WHERE file_edit_count > 0) AS sessions_with_edits FROM tt_facts GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return reports.repo_metadata(t.session_facts)


@query("repo_rank", """
WITH r AS (SELECT repo_root, min(repo_name) AS repo_name, sum(cost_micro)::BIGINT AS cost FROM tt_sessions GROUP BY 1)
SELECT repo_root, row_number() OVER (ORDER BY cost DESC NULLS LAST, repo_root) AS cost_rank, count(*) OVER () AS repos,
  coalesce(cost::DOUBLE / (SELECT sum(cost)::BIGINT::DOUBLE FROM r), 0) AS share, (SELECT repo_name FROM r ORDER BY cost DESC NULLS LAST, repo_root LIMIT 1) AS leader FROM r""")
def _(t: Tables) -> DataFrame:
    return reports.repo_rank(t.sessions)


ROI_ORDER = "CASE WHEN file_edit_count = 0 THEN 'infinity'::DOUBLE ELSE total_tokens::DOUBLE / file_edit_count::DOUBLE END, id"


@query("sort_repos", f"SELECT id, label, file_edit_count, tokens_per_edit, row_number() OVER (ORDER BY {ROI_ORDER}) - 1 AS position FROM ({ROLLUP})")
def _(t: Tables) -> DataFrame:
    return sorts.with_position(sorts.sort_repos(G.repo_rollup(t.sessions), "roi").select("id", "label", "file_edit_count", "tokens_per_edit"))


REVIEW_PICKS = f"""
WITH s AS (SELECT *, {IMPORTANT} AS imp, {REVIEW} AS review, count(*) OVER (PARTITION BY repo_root) AS n, sum(total_tokens) OVER (PARTITION BY repo_root)::BIGINT::DOUBLE / count(*) OVER (PARTITION BY repo_root) AS mean,
    count(cost_micro) OVER (PARTITION BY repo_root) > 0 AS priced FROM tt_sessions),
p AS (
  SELECT * FROM (SELECT *, 0 AS place, 'Highest estimated cost' AS reason, row_number() OVER (PARTITION BY repo_root ORDER BY CASE WHEN priced THEN coalesce(cost_micro, -1) ELSE total_tokens END DESC, id) AS k FROM s) WHERE k = 1
  UNION ALL SELECT * FROM (SELECT *, 1, 'Longest duration', row_number() OVER (PARTITION BY repo_root ORDER BY coalesce(duration_ms, 0) DESC, id) AS k FROM s) WHERE k = 1
  UNION ALL SELECT * FROM (SELECT *, 2, 'Partial or failed outcome', row_number() OVER (PARTITION BY repo_root ORDER BY id) AS k FROM s WHERE session_outcome IN ('partial', 'failed')) WHERE k = 1
  UNION ALL SELECT * FROM (SELECT *, 3, 'Possible failed commands', row_number() OVER (PARTITION BY repo_root ORDER BY imp DESC, id) AS k FROM s) WHERE k = 1
  UNION ALL SELECT * FROM (SELECT *, 4, 'Unusual token volume', row_number() OVER (PARTITION BY repo_root ORDER BY total_tokens DESC, id) AS k FROM s)
    WHERE k = 1 AND (total_tokens >= 1000000 OR (mean > 0 AND total_tokens >= mean * 2.5))),
m AS (SELECT repo_root, id, any_value(n) AS n, any_value(cost_micro) AS cost_micro, min(place) AS place,
    string_agg(CASE WHEN place = first_place THEN reason ELSE lower(reason) END, '; ' ORDER BY place) AS reason, bool_or(total_tokens > 0 OR cost_micro IS NOT NULL OR duration_ms IS NOT NULL OR review) AS keep
  FROM (SELECT *, min(place) OVER (PARTITION BY repo_root, id) AS first_place FROM p) GROUP BY repo_root, id)
SELECT repo_root, id, reason, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_root ORDER BY CASE WHEN contains(reason, 'Highest') THEN 0 WHEN contains(reason, 'Command') THEN 1 WHEN contains(reason, 'Partial') THEN 2
    WHEN contains(reason, 'Unusual') THEN 3 ELSE 4 END, coalesce(cost_micro, -1) DESC, place) AS rank FROM m WHERE keep) WHERE rank <= least(6, n)"""


@query("sessions_to_review", REVIEW_PICKS)
def _(t: Tables) -> DataFrame:
    return reports.sessions_to_review(t.sessions)


@query("latest_session", """
SELECT repo_root, arg_max(id, rn) AS latest_session FROM (SELECT repo_root, id, row_number() OVER (PARTITION BY repo_root ORDER BY coalesce(started_at, ended_at) NULLS FIRST, id) AS rn FROM tt_facts) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return reports.latest_sessions(t.session_facts, "repo_root")


@query("sessions_of_groups", """
SELECT s.id, s.repo_root FROM tt_sessions s WHERE s.repo_root IN (SELECT repo_root FROM tt_sessions GROUP BY 1 HAVING sum(coalesce(file_edit_count, 0)) > 1500) AND s.model = 'gpt-5.4'""")
def _(t: Tables) -> DataFrame:
    busy = G.repo_rollup(t.sessions).where("file_edit_count > 1500").select(F.col("id").alias("repo_root"))
    return t.sessions.where("model = 'gpt-5.4'").join(busy, "repo_root", "left_semi").select("id", "repo_root")


# ---------------------------------------------------------------- pricing gaps

UNPRICED = "list_transform(list_filter(warnings, lambda w: starts_with(w, 'unknown_pricing_model:')), lambda w: substr(w, 23))"
GAP = f"""CASE WHEN list_has_any(warnings, ['unknown_request_context', 'missing_token_breakdown', 'unknown_cost']) OR total_tokens = 0 THEN 'missingTokenDetail'
  WHEN model IS NULL THEN 'missingModel' WHEN len({UNPRICED}) > 0 THEN 'missingPrice' WHEN model <> 'mystery-1' THEN 'other' ELSE 'missingPrice' END"""


@query("pricing_gap_reason", f"SELECT id, {GAP} AS gap_reason FROM tt_sessions WHERE cost_micro IS NULL AND total_tokens > 0")
def _(t: Tables) -> DataFrame:
    resolved = pricing.resolve_models(t.requests, t.cards).select("model", F.col("base_rates").isNotNull().alias("priced"))
    return reports.with_gap_reason(t.sessions.where(X.is_unpriced()), resolved).select("id", "gap_reason")


@query("pricing_gap_summary", f"""
WITH g AS (SELECT *, {GAP} AS reason, {UNPRICED} AS unpriced FROM tt_sessions WHERE cost_micro IS NULL AND total_tokens > 0)
SELECT count(*) AS total, count(*) FILTER (WHERE reason = 'missingPrice') AS missing_price, count(*) FILTER (WHERE reason = 'missingTokenDetail') AS missing_token_detail,
  count(*) FILTER (WHERE reason = 'missingModel') AS missing_model, count(*) FILTER (WHERE reason = 'other') AS other,
  (SELECT string_agg(m, ';' ORDER BY m) FROM (SELECT DISTINCT unnest(CASE WHEN len(unpriced) > 0 THEN unpriced ELSE [model] END) AS m FROM g WHERE reason = 'missingPrice')) AS missing_price_models
FROM g""")
def _(t: Tables) -> DataFrame:
    resolved = pricing.resolve_models(t.requests, t.cards).select("model", F.col("base_rates").isNotNull().alias("priced"))
    return reports.pricing_gap_summary(t.sessions, resolved).withColumn("missing_price_models", F.array_join("missing_price_models", ";"))


@query("used_pricing_models", """
WITH used AS (SELECT DISTINCT model FROM tt_requests WHERE model IS NOT NULL UNION
  SELECT r.long_model FROM tt_resolved s JOIN tt_rules r ON r.base_model = s.source_model WHERE r.long_model IN (SELECT model FROM tt_cards))
SELECT coalesce(u.model, c.model) AS model, u.model IS NOT NULL AS used, coalesce(c.r_input > 0 AND c.r_output > 0, false) AS own_price FROM used u FULL JOIN tt_cards c ON c.model = u.model""")
def _(t: Tables) -> DataFrame:
    used = t.requests.select("model").distinct()
    resolved = pricing.resolve_models(used, t.cards)
    return reports.used_pricing_models(used, t.cards, rates.context_rules_df(t.spark), resolved)


# Saved cards of a user, derived from parts: one per brand, one edited and one untouched bundled id.
SAVED_IDS = "CASE p_partkey % 40 WHEN 0 THEN 'gpt-5.4' WHEN 1 THEN 'claude-opus-4-8' ELSE lower(replace(p_brand, '#', '-')) END"


def _saved_cards(t: Tables) -> DataFrame:
    sized = t.table("part").selectExpr(f"{SAVED_IDS} AS model", "p_size").groupBy("model").agg(F.max("p_size").alias("size"))
    untouched = F.col("model") == "claude-opus-4-8"
    values = {"input": (5, 1), "cached": (0.5, None), "write_5m": (6.25, None), "write_1h": (10, None), "write": (10, None), "output": (25, 4)}
    columns = []
    for name in rates.RATE_COLUMNS:
        own, scale = values.get(name, (None, None))
        other = F.col("size") * scale if scale else F.lit(None)
        columns.append(F.when(untouched, F.lit(own)).otherwise(other).cast("decimal(12,6)").alias(name))
    return sized.select("model", *columns, F.lit(None).cast("string").alias("note"), F.lit(1000).alias("position"))


SAVED_SQL = f"""SELECT model, CASE WHEN model = 'claude-opus-4-8' THEN 5000000 ELSE max(p_size)::BIGINT * 1000000 END AS r_input, CASE WHEN model = 'claude-opus-4-8' THEN 25000000 ELSE max(p_size)::BIGINT * 4000000 END AS r_output
  FROM (SELECT {SAVED_IDS} AS model, p_size FROM part) GROUP BY 1"""


@query("load_rate_cards", f"""
SELECT coalesce(s.model, c.model) AS model, coalesce(s.r_input, c.r_input)::DOUBLE / 1000000.0 AS input, coalesce(s.r_output, c.r_output)::DOUBLE / 1000000.0 AS output, s.model IS NOT NULL AS saved
FROM tt_cards c FULL JOIN ({SAVED_SQL}) s ON s.model = c.model""")
def _(t: Tables) -> DataFrame:
    cards = pricing.load_cards(t.cards, _saved_cards(t))
    return cards.select("model", F.col("input").cast("double").alias("input"), F.col("output").cast("double").alias("output"), (F.col("position") == 1000).alias("saved"))


@query("rate_card_diff", f"SELECT model FROM ({SAVED_SQL}) WHERE model <> 'claude-opus-4-8'")
def _(t: Tables) -> DataFrame:
    return pricing.changed_cards(_saved_cards(t), t.cards).select("model")


@query("avoided_cost", """SELECT id, total_tokens, round(total_tokens::DOUBLE * 5.0) / 1000000.0 AS avoided_usd FROM tt_sessions""")
def _(t: Tables) -> DataFrame:
    rate = reports.avoided_cost_rate(t.cards)
    return t.sessions.select("id", "total_tokens", reports.avoided_cost(F.col("total_tokens"), rate).alias("avoided_usd"))


# ---------------------------------------------------------------- pickers and readiness

@query("filter_options", """
SELECT id AS value, id AS label, sum(total_tokens)::BIGINT AS usage FROM (SELECT source_app AS id, total_tokens FROM tt_sessions) GROUP BY 1 UNION ALL SELECT 'Notebook', 'Notebook', 0::BIGINT""")
def _(t: Tables) -> DataFrame:
    return reports.filter_options(G.by_app(t.sessions), "label", ["1-URGENT", "Notebook"])


@query("source_readiness", """
SELECT source_client AS source, count(*) AS sessions_imported, count(DISTINCT source_path) > 0 AS primary_data_found,
  CASE WHEN count(*) FILTER (WHERE parse_status = 'failed' OR parse_error_count > 0) > 0 THEN 'Some files were skipped; check Settings for parse warnings.' ELSE 'Ready.' END AS next_step
FROM tt_facts GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return reports.source_readiness(reports.source_stats(t.session_facts))
