"""Labels, badges and sentences per session or group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.functions import labels as L
from tokentally.functions import models as M
from tokentally.functions import text
from tokentally.functions import warnings as W
from tokentally.operators import groups as G
from tokentally.operators.pricing import micro_to_usd
from tokentally.plans.binding import Tables
from tokentally.plans.filters_queries import IMPORTANT
from tokentally.plans.groups_queries import ROLLUP
from tokentally.plans.oracle import compact_sql, count_sql, norm_model
from tokentally.plans.registry import query


def case(column: str, labels: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items())
    return f"CASE {column} {arms} ELSE '{default}' END"


SURFACE = case("detected_surface", L.SURFACES, "Unknown")
OUTCOME = case("session_outcome", L.OUTCOMES, "Unknown")
SOURCE = case("source_client", L.SOURCES, "Unknown")


@query("code_labels", f"""SELECT id, {SOURCE} AS source_label, {SURFACE} AS surface_label, {OUTCOME} AS outcome_label,
  {case('token_aggregation_method', L.METHODS, 'Unknown')} AS method_label, {case('token_confidence', L.CONFIDENCES, 'Low')} AS confidence_label,
  {case('command_issue_impact', L.IMPACTS, 'None')} AS impact_label, coalesce(upper(top_failure_type[1]) || substr(top_failure_type, 2), 'None') AS failure_label FROM tt_facts""")
def _(t: Tables) -> DataFrame:
    c = F.col
    return t.session_facts.select(
        "id", L.source_label(c("source_client")).alias("source_label"), L.surface_label(c("detected_surface")).alias("surface_label"),
        L.outcome_label(c("session_outcome")).alias("outcome_label"), L.method_label(c("token_aggregation_method")).alias("method_label"),
        L.confidence_label(c("token_confidence")).alias("confidence_label"), L.impact_label(c("command_issue_impact")).alias("impact_label"),
        L.failure_type_label(c("top_failure_type")).alias("failure_label"),
    )


# Apps of the proxy sessions, with names the scoping rule looks for.
APP = "CASE o.k % 5 WHEN 0 THEN 'VS Code' WHEN 1 THEN 'Copilot CLI' WHEN 2 THEN '' WHEN 3 THEN 'Terminal' ELSE source_app END"


@query("split_source_apps", f"""
SELECT id, CASE WHEN named = 'Unknown' THEN tool WHEN source_client = 'copilot' AND named = 'Copilot CLI' THEN 'GitHub Copilot CLI'
  WHEN regexp_matches(lower(named), 'vs code|vscode|terminal|cli') THEN tool || ' on ' || named ELSE named END AS app
FROM (SELECT id, source_client, {SOURCE} AS tool, CASE WHEN app = '' THEN {SURFACE} ELSE app END AS named
  FROM (SELECT *, CASE id::BIGINT % 5 WHEN 0 THEN 'VS Code' WHEN 1 THEN 'Copilot CLI' WHEN 2 THEN '' WHEN 3 THEN 'Terminal' ELSE source_app END AS app FROM tt_facts))""")
def _(t: Tables) -> DataFrame:
    app = F.expr("CASE cast(id AS bigint) % 5 WHEN 0 THEN 'VS Code' WHEN 1 THEN 'Copilot CLI' WHEN 2 THEN '' WHEN 3 THEN 'Terminal' ELSE source_app END")
    return t.session_facts.select("id", L.scoped_app(app, F.col("source_client"), F.col("detected_surface")).alias("app"))


@query("provider_for_model", f"""
SELECT model, CASE WHEN starts_with(m, 'claude') THEN 'anthropic' WHEN starts_with(m, 'gpt') OR starts_with(m, 'o') THEN 'openai' END AS rollout,
  CASE WHEN contains(m, 'claude') THEN 'anthropic' WHEN starts_with(m, 'gpt') OR starts_with(m, 'o') THEN 'openai' END AS workspace,
  CASE WHEN contains(n, 'claude') THEN 'anthropic' WHEN contains(n, 'gemini') THEN 'google' WHEN contains(n, 'gpt') THEN 'openai' ELSE 'github-copilot' END AS copilot,
  CASE WHEN contains(m, 'claude') THEN 'claude' WHEN contains(m, 'gemini') THEN 'google' WHEN starts_with(m, 'gpt-') THEN 'openai' ELSE 'custom' END AS pricing,
  CASE WHEN contains(m, 'claude') THEN 'Claude' WHEN starts_with(m, 'gpt-') THEN 'OpenAI' ELSE 'Custom' END AS label, requests
FROM (SELECT model, lower(model) AS m, {norm_model('model')} AS n, count(*) AS requests FROM tt_requests WHERE model IS NOT NULL GROUP BY ALL)""")
def _(t: Tables) -> DataFrame:
    m = F.col("model")
    used = t.requests.where("model is not null").groupBy("model").agg(F.count("*").alias("requests"))
    return used.select("model", M.rollout_provider(m).alias("rollout"), M.workspace_provider(m).alias("workspace"), M.copilot_provider(m).alias("copilot"),
                       M.pricing_provider(m).alias("pricing"), M.provider_label(m).alias("label"), "requests")


@query("fast_mode_model", f"""
SELECT model, speed, CASE WHEN speed = 'fast' AND NOT contains(n, 'fast-mode') AND NOT regexp_matches(n, '^claude-opus-4-6($|-)') THEN n || '-fast-mode' ELSE model END AS pricing_model, requests
FROM (SELECT model, speed, {norm_model('model')} AS n, count(*) AS requests FROM tt_requests GROUP BY ALL)""")
def _(t: Tables) -> DataFrame:
    used = t.requests.groupBy("model", "speed").agg(F.count("*").alias("requests"))
    return used.select("model", "speed", M.fast_mode_model(F.col("model"), F.col("speed")).alias("pricing_model"), "requests")


@query("service_tier_summary", """
SELECT session_id, CASE WHEN len(tiers) = 1 THEN tiers[1] WHEN len(tiers) > 1 THEN 'mixed' WHEN len(speeds) = 1 THEN speeds[1] ELSE 'mixed' END AS service_tier,
  CASE WHEN len(tiers) > 0 THEN 'usage.service_tier: ' || array_to_string(tiers, ', ') ELSE 'usage.speed: ' || array_to_string(speeds, ', ') END AS detail
FROM (SELECT session_id, list_sort(coalesce(list(DISTINCT lower(service_tier)) FILTER (WHERE service_tier IS NOT NULL), [])) AS tiers, list_sort(list(DISTINCT lower(speed))) AS speeds FROM tt_requests GROUP BY 1)""")
def _(t: Tables) -> DataFrame:
    from tokentally.operators.sessions import service_tier_summary

    return service_tier_summary(t.requests, ["session_id"])


@query("display_title", """
SELECT id, CASE WHEN title IS NULL THEN 'Session ' || substr(id, 1, 8) ELSE regexp_replace(regexp_replace(title, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '\\s+', ' ', 'g') END AS title
FROM tt_facts""")
def _(t: Tables) -> DataFrame:
    return t.session_facts.select("id", L.display_title(F.col("title"), F.lit(None).cast("string"), F.col("id")).alias("title"))


@query("session_badges", f"""
SELECT id, array_to_string(list_distinct_kept, ';') AS badges FROM (SELECT id, list_filter([
  CASE WHEN {IMPORTANT} > 0 THEN 'Possible failed command' END, CASE WHEN total_tokens >= 1000000 THEN 'High token' END,
  CASE WHEN coalesce(file_edit_count, 0) = 0 THEN 'No edits' END, CASE WHEN list_contains(warnings, 'repo_unverified_no_git_root') THEN 'Unknown repo/folder' END,
  CASE WHEN coalesce(detected_surface, 'unknown') = 'unknown' THEN 'Unknown surface' END, CASE WHEN file_edit_count > 0 THEN 'Files edited' END, {OUTCOME},
  CASE WHEN cost_micro IS NULL AND total_tokens > 0 THEN 'Unknown pricing' END, CASE WHEN list_contains(warnings, 'missing_token_breakdown') THEN 'Unknown tokens' END], lambda x: x IS NOT NULL) AS list_distinct_kept
  FROM tt_sessions)""")
def _(t: Tables) -> DataFrame:
    return t.sessions.select("id", F.array_join(L.session_badges(), ";").alias("badges"))


@query("session_signals", f"""
SELECT id, array_to_string(list_filter([CASE WHEN file_edit_count > 0 THEN {count_sql('file_edit_count', 'file edit')} || ' detected.' END,
    CASE WHEN {IMPORTANT} = 0 THEN 'No possible failed commands detected.' END, CASE WHEN parse_status = 'ok' THEN 'Local session log parsed cleanly.' END,
    CASE WHEN token_confidence = 'high' THEN 'Token counting confidence is high.' END,
    CASE WHEN input_tokens > 0 AND cached_input_tokens::DOUBLE / input_tokens >= 0.5 THEN 'Cached input reuse was strong.' END, 'Session resolved to a repo or folder.'], lambda x: x IS NOT NULL), ' ') AS positive,
  array_to_string(list_filter([CASE WHEN {IMPORTANT} > 0 THEN {count_sql(IMPORTANT, 'possible failed command')} || ' to review.' END,
    CASE WHEN session_outcome IN ('partial', 'failed') THEN 'Outcome is ' || lower({OUTCOME}) || '; check whether the work completed.' END,
    CASE WHEN coalesce(file_edit_count, 0) = 0 AND total_tokens > 1000000 THEN 'High-token session with no detected file edits.' END,
    CASE WHEN cost_micro IS NULL AND total_tokens > 0 THEN 'API-equivalent cost unavailable because pricing or token split is missing.' END,
    CASE WHEN parse_status <> 'ok' THEN 'Parser reported issues for this session.' END, CASE WHEN detected_surface = 'unknown' THEN 'Surface could not be detected from local logs.' END,
    CASE WHEN list_contains(warnings, 'repo_unverified_no_git_root') THEN 'Repo/folder grouping is unverified because no Git root was detected.' END,
    CASE WHEN token_snapshot_count = 0 AND total_tokens = 0 THEN 'No token checkpoints were available.' END], lambda x: x IS NOT NULL), ' ') AS concerns FROM tt_sessions""")
def _(t: Tables) -> DataFrame:
    return t.sessions.select("id", F.array_join(L.positive_signals(), " ").alias("positive"), F.array_join(L.concern_signals(), " ").alias("concerns"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


READABLE = (
    "CASE WHEN starts_with(lower({w}), 'unknown_pricing_model:') THEN 'A request used ' || substr({w}, 23) || ', which needs a usable rate in Settings.' "
    + " ".join(f"WHEN lower({{w}}) = '{k}' THEN {_text(v)}" for k, v in W.TEXTS.items()) + " ELSE replace({w}, '_', ' ') END"
)
WORDS = "regexp_replace(lower(w), '[:_]+', ' ', 'g')"


def _detail(part: int, default: str) -> str:
    arms = " ".join(
        f"WHEN {f'starts_with({WORDS}, {_text(k[:-1])})' if k.endswith('*') else f'{WORDS} = {_text(k)}'} THEN {_text(v[part])}" for k, v in W.DETAILS.items()
    )
    return f"CASE {arms} ELSE {default} END"


@query("warning_details", f"""
SELECT w AS warning, {READABLE.format(w='w')} AS text, {_detail(0, "upper(replace(w, '_', ' ')[1]) || substr(replace(w, '_', ' '), 2)")} AS title, {_detail(1, "'data'")} AS category,
  {_detail(2, "'info'")} AS tone, sessions FROM (SELECT w, count(*) AS sessions FROM (SELECT unnest(warnings) AS w FROM tt_sessions) GROUP BY 1)""")
def _(t: Tables) -> DataFrame:
    from tokentally.operators.sets import warning_details

    return warning_details(t.sessions)


@query("distinct_warnings", "SELECT repo_root, string_agg(w, ';' ORDER BY w) AS warnings FROM (SELECT DISTINCT repo_root, unnest(warnings) AS w FROM tt_sessions) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    from tokentally.operators.sets import distinct_warnings

    return distinct_warnings(t.sessions, "repo_root").withColumn("warnings", F.array_join("warnings", ";"))


HAY = f"""lower(concat_ws(' ', title, id, repo_name, source_app, {SURFACE}, model, {OUTCOME}, CASE WHEN cost_micro IS NULL AND total_tokens > 0 THEN '{L.UNPRICED_PHRASE}' END,
  nullif(array_to_string(list_transform(warnings, lambda x: {READABLE.format(w='x')}), ' '), '')))"""


@query("search_sessions", f"SELECT id, repo_root FROM tt_sessions WHERE contains({HAY}, 'mystery-1, which needs')")
def _(t: Tables) -> DataFrame:
    return t.sessions.where(L.matches_search("  Mystery-1, which needs ")).select("id", "repo_root")


RATE = "CASE WHEN input_tokens > 0 THEN cached_input_tokens::DOUBLE / input_tokens ELSE 0 END"


@query("cache_reuse_label", f"SELECT id, CASE WHEN {RATE} >= 0.5 THEN 'strong' WHEN {RATE} >= 0.2 THEN 'moderate' WHEN input_tokens > 0 THEN 'low' ELSE 'unknown' END AS cache_reuse FROM tt_sessions")
def _(t: Tables) -> DataFrame:
    return t.sessions.select("id", L.cache_reuse_label(F.col("cached_input_tokens"), F.col("input_tokens")).alias("cache_reuse"))


@query("dominant_token_bucket", """
SELECT id, CASE WHEN input_tokens >= greatest(cached_input_tokens, output_tokens, reasoning_tokens) THEN 'input' WHEN cached_input_tokens >= greatest(output_tokens, reasoning_tokens) THEN 'cached input'
  WHEN output_tokens >= reasoning_tokens THEN 'output' ELSE 'reasoning' END AS bucket FROM tt_sessions""")
def _(t: Tables) -> DataFrame:
    c = F.col
    bucket = L.dominant_bucket(("input", c("input_tokens")), ("cached input", c("cached_input_tokens")), ("output", c("output_tokens")), ("reasoning", c("reasoning_tokens")))
    return t.sessions.select("id", bucket.alias("bucket"))


EACH = "total_tokens::DOUBLE / file_edit_count"


@query("token_intensity", f"""
SELECT id, CASE WHEN file_edit_count <= 0 THEN 'No file edits detected' WHEN {EACH} >= 1000000 THEN 'High token use per file edit' WHEN {EACH} <= 100000 THEN 'Low token use per file edit'
  ELSE 'Moderate token use per file edit' END AS intensity, CASE WHEN tokens_per_edit IS NULL THEN 'No edits' ELSE {compact_sql('tokens_per_edit')} || ' tokens / edit' END AS label FROM ({ROLLUP})""")
def _(t: Tables) -> DataFrame:
    from tokentally.sources.sinks import intensity_label

    return G.repo_rollup(t.sessions).select("id", L.token_intensity(F.col("total_tokens"), F.col("file_edit_count")).alias("intensity"), intensity_label().alias("label"))


@query("parse_amounts", """
SELECT id, total_tokens AS tokens_back, (shell_command_count * 60000 + tool_call_count * 1000)::DOUBLE AS clock_ms, (tool_call_count * 3600000)::DOUBLE AS hours_ms, (total_tokens // 1000) * 1000 AS thousands_back FROM tt_sessions""")
def _(t: Tables) -> DataFrame:
    c = F.col
    return t.sessions.select(
        "id", text.token_amount(F.format_number("total_tokens", 0)).alias("tokens_back"),
        text.duration_amount(F.concat(c("shell_command_count").cast("string"), F.lit("m"), c("tool_call_count").cast("string"), F.lit("s"))).alias("clock_ms"),
        text.duration_amount(F.concat(c("tool_call_count").cast("string"), F.lit("h"))).alias("hours_ms"),
        text.token_amount(F.concat(text.whole_div(c("total_tokens"), 1000).cast("string"), F.lit("K"))).alias("thousands_back"),
    )


@query("session_duration", "SELECT id, duration_ms FROM tt_facts")
def _(t: Tables) -> DataFrame:
    from tokentally.functions.records import duration_ms

    return t.session_facts.select("id", duration_ms(F.col("started_at"), F.col("ended_at")).alias("duration_ms"))
