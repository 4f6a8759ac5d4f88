"""Filters, predicates, outliers and sorts over sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.operators import filters as X
from tokentally.operators import groups as G
from tokentally.operators import pricing, reports, sorts
from tokentally.plans.binding import Tables
from tokentally.plans.groups_queries import usd
from tokentally.plans.registry import query

CHOSEN = ["gpt-5.4", "claude-opus-4-8", "unknown-model"]
IN_CHOSEN = "coalesce({}, 'unknown-model') IN ('gpt-5.4', 'claude-opus-4-8', 'unknown-model')"
IMPORTANT = "coalesce(important_command_failures, failed_tool_call_count, 0)"
NON_ZERO = f"coalesce(non_zero_command_events, {IMPORTANT})"
REVIEW = f"""({IMPORTANT} > 0 OR repeated_failure_clusters > 0 OR (shell_command_count >= 4 AND {NON_ZERO}::DOUBLE / shell_command_count >= 0.5)
  OR (total_tokens >= 1000000 AND {NON_ZERO} > 0) OR (session_outcome IN ('partial', 'failed') AND {NON_ZERO} > 0))"""
HAS_CHOSEN = f"(id IN (SELECT session_id FROM tt_slices WHERE {IN_CHOSEN.format('model')}) OR (id NOT IN (SELECT session_id FROM tt_slices) AND {IN_CHOSEN.format('model')}))"
CORE = "id, source_client, source_app, repo_name, model, total_tokens"


def core(sessions: DataFrame, *more: str) -> DataFrame:
    return sessions.select("id", "source_client", "source_app", "repo_name", "model", "total_tokens", pricing.micro_to_usd(F.col("cost_micro")).alias("cost_usd"), *more)


@query("filter_dates", f"""SELECT {CORE}, {usd('cost_micro')} AS cost_usd FROM tt_sessions
WHERE started_at >= TIMESTAMP '1996-01-01' AND started_at <= TIMESTAMP '1997-06-30 23:59:59.999'""")
def _(t: Tables) -> DataFrame:
    return core(X.filter_usage(t.sessions, X.Filters(start="1996-01-01", end="1997-06-30")))


@query("filter_usage", f"""SELECT {CORE}, {usd('cost_micro')} AS cost_usd FROM tt_sessions
WHERE source_client IN ('codex', 'claude') AND source_app IN ('1-URGENT', '2-HIGH') AND (repo_name = 'NATION_7' OR repo_root = '/r/NATION_12')
  AND started_at >= TIMESTAMP '1995-03-01 06:00:00'""")
def _(t: Tables) -> DataFrame:
    chosen = X.Filters(source=["codex", "claude"], source_app=["1-URGENT", "2-HIGH"], repo=["NATION_7", "/r/NATION_12"], start="1995-03-01T06:00:00.000Z")
    return core(X.filter_usage(t.sessions, chosen))


@query("filter_model_slices", f"SELECT id, model, total_tokens FROM tt_sessions WHERE {HAS_CHOSEN}")
def _(t: Tables) -> DataFrame:
    return t.sessions.where(X.model_matches(CHOSEN)).select("id", "model", "total_tokens")


SLICE_SUMS = ", ".join(f"0::BIGINT AS {b}" if b in ("cache_write_5m", "cache_write_1h") else f"sum(l.{b})::BIGINT AS {b}" for b in G.TOKENS)
PROJECTED = f"""
SELECT l.session_id AS id, CASE WHEN bool_or(l.model = s.model) THEN any_value(s.model) ELSE arg_min(l.model, l.first_ord) END AS model, {SLICE_SUMS},
  {usd('CASE WHEN count(*) = count(l.cost_micro) THEN sum(l.cost_micro) END')} AS cost_usd
FROM tt_slices l JOIN tt_sessions s ON s.id = l.session_id WHERE {IN_CHOSEN.format('l.model')} GROUP BY l.session_id
UNION ALL SELECT id, model, {', '.join(G.TOKENS)}, {usd('cost_micro')} FROM tt_sessions WHERE id NOT IN (SELECT session_id FROM tt_slices) AND {IN_CHOSEN.format('model')}"""


@query("project_model_filter", PROJECTED)
def _(t: Tables) -> DataFrame:
    return X.filter_usage(t.sessions, X.Filters(model=CHOSEN)).select("id", "model", *G.TOKENS, pricing.micro_to_usd(F.col("cost_micro")).alias("cost_usd"))


@query("visible_sessions", "SELECT id, source_client, total_tokens FROM tt_sessions WHERE total_tokens > 0 OR source_client IN ('claude', 'cursor', 'copilot')")
def _(t: Tables) -> DataFrame:
    return t.sessions.where(G.is_visible()).select("id", "source_client", "total_tokens")


QUICK = {
    "highToken": "total_tokens >= 1000000", "failedCommands": f"{IMPORTANT} > 0", "noEdits": "coalesce(file_edit_count, 0) = 0",
    "completed": "session_outcome = 'completed'", "partial": "session_outcome = 'partial'",
    "vscode": "detected_surface = 'vscode_extension' OR contains(lower(source_app), 'vs code')",
    "terminal": "detected_surface = 'terminal_cli' OR contains(lower(source_app), 'terminal')",
    "unknownSurface": "coalesce(detected_surface, 'unknown') = 'unknown'",
}


@query("quick_filter", "SELECT id, " + ", ".join(f"coalesce({sql}, false) AS {name}" for name, sql in QUICK.items()) + " FROM tt_sessions")
def _(t: Tables) -> DataFrame:
    return t.sessions.select("id", *[F.coalesce(test, F.lit(False)).alias(name) for name, test in X.quick_filters().items()])


def outliers_sql(part: str) -> str:
    over = f"OVER (PARTITION BY {part})" if part else "OVER ()"
    ordered = f"OVER (PARTITION BY {part + ', ' if part else ''}cost_micro IS NULL ORDER BY cost_micro)"
    return f"""(SELECT *, coalesce(cost_micro > 0 AND cost_micro >= cost_limit, false) AS cost_outlier,
      coalesce(duration_ms > 0 AND duration_ms >= greatest(3600000.0, duration_mean * 1.75), false) AS long_running,
      total_tokens >= 1000000 OR (token_mean > 0 AND total_tokens >= token_mean * 2.5) AS token_outlier
    FROM (SELECT *, CASE WHEN n < 3 THEN max(cost_micro) {over} ELSE greatest(cost_mean2, max(CASE WHEN rn = floor(n * 0.75) + 1 THEN cost_micro END) {over}) END::DOUBLE AS cost_limit
      FROM (SELECT *, count(cost_micro) {over} AS n, row_number() {ordered} AS rn0, CASE WHEN cost_micro IS NOT NULL THEN row_number() {ordered} END AS rn,
          sum(cost_micro) {over}::BIGINT::DOUBLE * 2 / count(cost_micro) {over} AS cost_mean2,
          sum(CASE WHEN duration_ms > 0 THEN duration_ms END) {over}::BIGINT::DOUBLE / count(CASE WHEN duration_ms > 0 THEN 1 END) {over} AS duration_mean,
          sum(total_tokens) {over}::BIGINT::DOUBLE / count(*) {over} AS token_mean
        FROM tt_sessions)))"""


@query("cost_outliers", f"SELECT id, repo_root, {usd('cost_micro')} AS cost_usd FROM {outliers_sql('')} WHERE cost_outlier")
def _(t: Tables) -> DataFrame:
    return X.with_overall_outliers(X.once(t.sessions, "id")).where("cost_outlier").select("id", "repo_root", pricing.micro_to_usd(F.col("cost_micro")).alias("cost_usd"))


@query("long_running", f"SELECT id, duration_ms FROM {outliers_sql('')} WHERE long_running")
def _(t: Tables) -> DataFrame:
    return X.with_overall_outliers(X.once(t.sessions, "id")).where("long_running").select("id", "duration_ms")


@query("token_outliers", f"SELECT id, repo_root, total_tokens FROM {outliers_sql('repo_root')} WHERE token_outlier")
def _(t: Tables) -> DataFrame:
    sessions = X.once(t.sessions, "id")
    return sessions.join(X.group_means(sessions, ["repo_root"]), "repo_root").where(X.is_token_outlier()).select("id", "repo_root", "total_tokens")


@query("repo_quick_filter", f"""SELECT id, cost_outlier AS expensive, session_outcome IN ('partial', 'failed') AS partial, long_running AS "longRunning",
  {IMPORTANT} > 0 OR repeated_failure_clusters > 0 AS "commandIssues", contains(lower(coalesce(model, '')), 'opus') AS "opusOnly"
FROM {outliers_sql('repo_root')}""")
def _(t: Tables) -> DataFrame:
    read = ["id", "session_outcome", "important_command_failures", "failed_tool_call_count", "repeated_failure_clusters", "model"]
    rows = X.with_group_outliers(X.once(t.sessions, *read), ["repo_root"])
    return rows.select("id", *[test.alias(name) for name, test in X.repo_quick_filters().items()])


@query("needs_command_review", f"SELECT id, repo_root FROM tt_sessions WHERE {REVIEW}")
def _(t: Tables) -> DataFrame:
    return t.sessions.where(X.needs_command_review()).select("id", "repo_root")


@query("important_failures", f"SELECT id, {IMPORTANT} AS failures FROM tt_facts")
def _(t: Tables) -> DataFrame:
    return t.session_facts.select("id", G.important_failures().alias("failures"))


@query("harmless_sessions", f"SELECT id FROM tt_facts WHERE {IMPORTANT} = 0 AND (harmless_non_zero_events > 0 OR exploratory_misses > 0)")
def _(t: Tables) -> DataFrame:
    return t.session_facts.where(X.is_harmless()).select("id")


@query("unpriced_sessions", "SELECT id, total_tokens FROM tt_sessions WHERE cost_micro IS NULL AND total_tokens > 0")
def _(t: Tables) -> DataFrame:
    return t.sessions.where(X.is_unpriced()).select("id", "total_tokens")


WASTE = {
    "high-token-no-edit": "coalesce(file_edit_count, 0) = 0 AND total_tokens >= 1000000",
    "high-token-low-output": "total_tokens >= 1000000 AND output_tokens::DOUBLE / greatest(total_tokens, 1)::DOUBLE < 0.03",
    "command-issue-sessions": f"{IMPORTANT} > 0", "unknown-repos": "list_contains(warnings, 'repo_unverified_no_git_root')",
    "unknown-surfaces": "coalesce(detected_surface, 'unknown') = 'unknown'",
    "repeated-errors": "len(list_filter(warnings, lambda w: contains(w, 'repeated_error'))) > 0",
}
WASTE_SQL = " UNION ALL ".join(f"SELECT '{name}' AS id, count(*) FILTER (WHERE {sql}) AS sessions FROM tt_sessions" for name, sql in WASTE.items())


@query("waste_predicates", WASTE_SQL)
def _(t: Tables) -> DataFrame:
    return X.count_predicates(t.sessions, X.waste_predicates())


PRESET_SQL = """
WITH n AS (SELECT source_client, max(started_at) AS now FROM tt_facts GROUP BY 1)
SELECT source_client, preset, "start", "end" FROM (""" + " UNION ALL ".join(
    [f"SELECT source_client, '{p}' AS preset, strftime(now - to_hours({h}), '%Y-%m-%dT%H:%M:%S.%gZ') AS \"start\", strftime(now, '%Y-%m-%dT%H:%M:%S.%gZ') AS \"end\" FROM n" for p, h in X.ROLLING_HOURS.items()]
    + [f"SELECT source_client, '{p}', strftime(now - to_days({d}), '%Y-%m-%d'), strftime(now, '%Y-%m-%d') FROM n" for p, d in X.ROLLING_DAYS.items()]
    + [f"SELECT source_client, '{p}', strftime(date_trunc('{u}', now), '%Y-%m-%d'), strftime(now, '%Y-%m-%d') FROM n" for p, u in (("thisWeek", "week"), ("thisMonth", "month"))]
    + ["SELECT source_client, 'all', '', '' FROM n"]) + ")"


@query("range_preset", PRESET_SQL)
def _(t: Tables) -> DataFrame:
    latest = t.session_facts.groupBy("source_client").agg(F.max("started_at").alias("now"))
    return latest.select("source_client", F.inline(F.array(*[X.preset_columns(p, F.col("now")) for p in X.PRESETS])))


@query("scan_window_prune", """
SELECT user_id AS file FROM (SELECT user_id, epoch_ms(max(ts)) AS updated, epoch_ms(min(ts)) AS created FROM events GROUP BY 1)
WHERE updated >= epoch_ms(TIMESTAMP '2024-01-05') AND created <= epoch_ms(TIMESTAMP '2024-01-01 12:00:00')""")
def _(t: Tables) -> DataFrame:
    threads = t.table("events").groupBy(F.col("user_id").alias("file")).agg(
        F.unix_millis(F.max("ts").cast("timestamp")).alias("updated_ms"), F.unix_millis(F.min("ts").cast("timestamp")).alias("created_ms")
    )
    return threads.where(X.thread_may_overlap(1704412800000, 1704110400000)).select("file")


@query("timeline_search", """
SELECT conv_id, turn, role, text FROM conversations WHERE role = 'user' AND contains(lower(text), 'the')""")
def _(t: Tables) -> DataFrame:
    return X.search_timeline(t.table("conversations"), "user", " The ").select("conv_id", "turn", "role", "text")


@query("list_totals", f"""SELECT count(*) AS sessions, sum(total_tokens)::BIGINT AS total_tokens, {usd('sum(cost_micro)')} AS cost_usd, sum(shell_command_count)::BIGINT AS commands,
  sum(file_edit_count)::BIGINT AS edits, count(*) FILTER (WHERE {REVIEW}) AS to_review, count(*) FILTER (WHERE cost_outlier) AS cost_outliers FROM {outliers_sql('')}""")
def _(t: Tables) -> DataFrame:
    return X.list_totals(t.sessions).withColumn("cost_usd", pricing.micro_to_usd(F.col("cost_micro"))).drop("cost_micro")


# ---------------------------------------------------------------- sorts

def place(order: str) -> str:
    return f"row_number() OVER (ORDER BY {order}) - 1 AS position"


@query("sort_sessions", f"SELECT {CORE}, {usd('cost_micro')} AS cost_usd, {place('coalesce(cost_micro, -1) DESC, id')} FROM tt_sessions")
def _(t: Tables) -> DataFrame:
    narrow = t.sessions.select("id", "source_client", "source_app", "repo_name", "model", "total_tokens", "cost_micro")
    return core(sorts.with_position(sorts.sort_sessions(narrow, "cost", descending=True)), "position")


@query("sort_review_sessions", f"SELECT id, repo_root, {place(f'{IMPORTANT} DESC, coalesce(repeated_failure_clusters, 0) DESC, total_tokens DESC, id')} FROM tt_sessions WHERE {REVIEW}")
def _(t: Tables) -> DataFrame:
    return sorts.with_position(sorts.sort_review(t.sessions.where(X.needs_command_review())).select("id", "repo_root"))


@query("top_sessions", f"SELECT id, {usd('cost_micro')} AS cost_usd, total_tokens FROM tt_sessions ORDER BY coalesce(cost_micro, -1) DESC, id LIMIT 25")
def _(t: Tables) -> DataFrame:
    return reports.top_sessions(t.sessions, 25).select("id", pricing.micro_to_usd(F.col("cost_micro")).alias("cost_usd"), "total_tokens")
