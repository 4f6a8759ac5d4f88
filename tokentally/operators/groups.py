"""Usage sums by repo, model, app, day and hour, and over everything.

Each result is one partial-then-final aggregate over sessions. Costs stay in
whole micro-USD; SUM over NULL costs leaves NULL when no session is priced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentally.runtime import reliable_checkpoint

TOKENS = [
    "input_tokens", "cached_input_tokens", "cache_write_tokens", "cache_write_5m", "cache_write_1h",
    "cache_write_30m", "cache_write_12h", "output_tokens", "reasoning_tokens", "total_tokens",
]
SIGNALS = [
    "user_prompt_count", "assistant_message_count", "tool_call_count", "shell_command_count", "failed_tool_call_count",
    "non_zero_command_events", "important_command_failures", "harmless_non_zero_events", "exploratory_misses",
    "repeated_failure_clusters", "file_read_count", "file_edit_count", "raw_event_count",
]
UNVERIFIED = "repo_unverified_no_git_root"
HIGH_TOKENS = 1_000_000


def total(column: str | Column) -> Column:
    """Sum that counts NULL as 0 and is 0 over no rows."""
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def with_codes(rows: DataFrame, keep: list[str], codes: Column | None = None) -> DataFrame:
    """Rows as they are (``_one`` is 1), and a row for each code with the columns ``keep`` alone.

    Aggregates see every row once, and ``code_set`` gathers single codes, each once for
    a group and task, in the same pass.
    """
    none = F.lit(None).cast("string")
    listed = F.coalesce(F.col("warnings") if codes is None else codes, F.array().cast("array<string>"))
    spread = rows.withColumn("_code", F.explode(F.concat(F.array(none), F.array_distinct(F.array_compact(listed)))))
    own = F.col("_code").isNull()
    values = [F.when(own, F.col(c)).alias(c) for c in rows.columns if c not in keep]
    return spread.select(*keep, *values, F.when(own, 1).alias("_one"), "_code")


def code_set(column: str = "_code") -> Column:
    """Sorted distinct codes of rows made by ``with_codes``."""
    return F.array_sort(F.collect_set(column))


def important_failures() -> Column:
    return F.coalesce("important_command_failures", "failed_tool_call_count", F.lit(0))


def is_parse_failure() -> Column:
    return F.coalesce((F.col("parse_status") == "failed") | (F.col("parse_error_count") > 0), F.lit(False))


def has_warning(code: str) -> Column:
    return F.array_contains("warnings", code)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 when whole is not positive."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def usage_sums() -> list[Column]:
    """Aggregates over rows with ``_one``, which is 1 where a row counts."""
    return [
        F.sum("cost_micro").alias("cost_micro"),
        F.count("cost_micro").alias("known_cost_sessions"),
        (F.count("_one") - F.count("cost_micro")).alias("unknown_cost_sessions"),
        *[total(c).alias(c) for c in TOKENS],
        F.count("_one").alias("session_count"),
        total("message_count").alias("message_count"),
    ]


def usage_aggregates() -> list[Column]:
    """Aggregates over rows made by ``with_codes``."""
    return [*usage_sums(), code_set().alias("warnings")]


def sort_groups(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.coalesce("cost_micro", F.lit(0)).desc(), F.col("total_tokens").desc(), "id")


def group_usage(sessions: DataFrame, key: Column, label: Column | None = None, *extra: Column) -> DataFrame:
    keyed = with_codes(sessions.withColumn("_key", key).withColumn("_label", key if label is None else label), ["_key"])
    return keyed.groupBy(F.col("_key").alias("id")).agg(F.min_by("_label", "id").alias("label"), *usage_aggregates(), *extra)


def by_repo(sessions: DataFrame, *extra: Column) -> DataFrame:
    verified = F.bool_or(~has_warning(UNVERIFIED)).alias("verified")
    return group_usage(sessions, F.col("repo_root"), F.col("repo_name"), verified, *extra)


def by_app(sessions: DataFrame) -> DataFrame:
    return group_usage(sessions, F.col("source_app"))


def day_key(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("unknown-date"))


def hour_key(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH':00:00.000Z'"), F.lit("unknown-hour"))


def by_day(sessions: DataFrame) -> DataFrame:
    return group_usage(sessions, day_key(F.col("started_at")))


def by_hour(sessions: DataFrame) -> DataFrame:
    return group_usage(sessions, hour_key(F.col("started_at")))


# ---------------------------------------------------------------- models

def slice_models() -> Column:
    """Model of each slice of a session; the session's own model without slices."""
    return F.when(F.size("model_usage") > 0, F.transform("model_usage", lambda s: s["model"])).otherwise(F.array("model"))


def model_slices(sessions: DataFrame) -> DataFrame:
    """One row per session and slice, with the slice's tokens and cost.

    The 5-minute and 1-hour write splits are not kept per slice.
    """
    zero = F.lit(0).cast("bigint")

    def from_slice(s: Column) -> Column:
        kept = ["cache_write_5m", "cache_write_1h"]
        return F.struct(s["model"].alias("model"), *[(zero if c in kept else s[c]).alias(c) for c in TOKENS], s["cost_micro"].alias("cost_micro"))

    whole = F.struct("model", *TOKENS, "cost_micro")
    slices = F.when(F.size("model_usage") > 0, F.transform("model_usage", from_slice)).otherwise(F.array(whole))
    drop = {"model", "model_usage", "cost_micro", *TOKENS}
    unknown = F.col("model").isNull() & F.coalesce(~F.exists("model_usage", lambda s: s["model"].isNotNull()), F.lit(True))
    return (
        sessions.withColumn("no_model", unknown).withColumn("_slice", F.explode(slices))
        .select(*[c for c in sessions.columns if c not in drop], "no_model", "_slice.*")
    )


def by_model(sessions: DataFrame) -> DataFrame:
    """A session counts once per slice, and its messages with it.

    Slices are summed by (model, warning), in a hash aggregate of whole numbers; sets are gathered from those few cells.
    """
    synthetic = has_warning("claude_synthetic_zero_usage")
    counted = with_codes(model_slices(sessions).withColumn("_id", F.coalesce("model", F.lit("unknown-model"))), ["_id"])
    cells = counted.groupBy(F.col("_id").alias("id"), "_code").agg(
        *usage_sums(), F.count_if(F.col("no_model") & ~synthetic).alias("_real"), F.count_if(F.col("no_model")).alias("_none"),
    )
    sums = ["known_cost_sessions", "unknown_cost_sessions", *TOKENS, "session_count", "message_count"]
    groups = cells.groupBy("id").agg(
        F.sum("cost_micro").alias("cost_micro"), *[total(c).alias(c) for c in sums], code_set().alias("warnings"),
        (F.sum("_real") == 0).alias("_all"), (F.sum("_none") > 0).alias("_any"),
    )
    label = F.when(F.col("id") != "unknown-model", F.col("id")).when(
        F.col("_all") & F.col("_any"), "Claude synthetic / no usage"
    ).otherwise("Model not recorded")
    return groups.withColumn("label", label).drop("_all", "_any")


# ---------------------------------------------------------------- summary

def summarize(sessions: DataFrame) -> DataFrame:
    """One row. Sums are taken per repo first, which also yields the repo count
    and the most expensive repo without a second pass; warnings and models are
    cells of their own beside the repo's."""
    coded = F.concat(
        F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.concat(F.lit("w"), w)),
        F.transform(F.array_compact(slice_models()), lambda m: F.concat(F.lit("m"), m)),
    )
    cells = with_codes(sessions, ["repo_root"], coded).groupBy("repo_root", "_code").agg(
        F.min_by("repo_name", "id").alias("repo_name"),
        F.sum("cost_micro").alias("cost_micro"), F.count("cost_micro").alias("known_cost_sessions"),
        *[total(c).alias(c) for c in TOKENS + SIGNALS],
        F.count("_one").alias("session_count"),
        F.count_if(is_parse_failure()).alias("parse_failure_count"),
        F.count_if(F.col("detected_surface") == "unknown").alias("unknown_surface_sessions"),
        F.count_if(F.col("_one").isNotNull() & (F.coalesce("file_edit_count", F.lit(0)) == 0)).alias("no_code_change_sessions"),
        F.count_if(F.col("session_outcome") == "research_only").alias("research_only_sessions"),
    )
    counts = ["known_cost_sessions", "session_count", "parse_failure_count", "unknown_surface_sessions", "no_code_change_sessions", "research_only_sessions"]
    dearest = F.struct(-F.col("cost_micro"), -F.col("total_tokens"), F.col("repo_root"))
    known = F.col("cost_micro").isNotNull()
    out = cells.agg(
        F.sum("cost_micro").alias("cost_micro"),
        *[total(c).alias(c) for c in TOKENS + SIGNALS + counts],
        F.count_if(F.col("_code").isNull()).alias("repo_count"),
        F.array_sort(F.collect_set(F.when(F.col("_code").startswith("w"), F.substr("_code", F.lit(2))))).alias("warnings"),
        F.countDistinct(F.when(F.col("_code").startswith("m"), F.col("_code"))).alias("model_count"),
        F.min_by("repo_root", F.when(known, dearest)).alias("most_expensive_repo"),
    )
    return out.withColumn("unknown_cost_sessions", F.col("session_count") - F.col("known_cost_sessions")).withColumn(
        "cached_input_pct", ratio(F.col("cached_input_tokens"), F.col("input_tokens"))
    )


def is_visible() -> Column:
    return (F.col("total_tokens") > 0) | F.col("source_client").isin("claude", "cursor", "copilot")


def scan_overview(sessions: DataFrame, source_stats: DataFrame) -> DataFrame:
    """One row about everything scanned, before any filter."""
    seen = is_visible()

    def counted(column: str) -> Column:
        return F.countDistinct(F.when(seen, F.col(column)))

    models = F.transform(slice_models(), lambda m: F.coalesce(m, F.lit("unknown-model")))
    files = source_stats.agg(total("session_file_count").alias("session_file_count"), F.max("last_scanned_at").alias("last_scanned_at"))
    spread = with_codes(sessions, [], F.when(seen, models))
    found = spread.agg(
        F.count_if(seen).alias("session_count"),
        F.count_if(~seen).alias("zero_token_session_count"),
        counted("repo_root").alias("repo_count"),
        F.countDistinct("_code").alias("model_count"),
        counted("source_app").alias("source_app_count"),
        F.count("_one").alias("raw_session_count"),
        total(F.when(seen, F.col("raw_event_count"))).alias("raw_event_count"),
        F.count_if(seen & is_parse_failure()).alias("parse_failure_count"),
    )
    return found.withColumn("_files", files.select(F.struct("session_file_count", "last_scanned_at")).scalar()).select(
        *found.columns, "_files.session_file_count", "_files.last_scanned_at"
    )


# ---------------------------------------------------------------- repo rollup

def tokens_per_edit() -> Column:
    edits = F.col("file_edit_count")
    return F.when(edits > 0, F.round(F.col("total_tokens").cast("double") / edits.cast("double")).cast("bigint"))


def product_warnings() -> Column:
    """Warnings of a repo row that carries _no_edit_high and _failed flags."""
    cached = ratio(F.col("cached_input_tokens"), F.col("input_tokens"))
    return F.array_compact(F.array(
        F.when(F.col("_no_edit_high"), "high-token no-edit"),
        F.when(F.col("_failed"), "command issues"),
        F.when(F.col("cost_micro").isNull() & (F.col("total_tokens") > 0), "unknown pricing"),
        F.when((F.col("input_tokens") > 0) & (cached < 0.1), "low cache rate"),
    ))


def no_edit_high() -> Column:
    return (F.coalesce("file_edit_count", F.lit(0)) == 0) & (F.col("total_tokens") >= HIGH_TOKENS)


def repo_rollup(sessions: DataFrame) -> DataFrame:
    rows = by_repo(
        sessions,
        total("file_edit_count").alias("file_edit_count"),
        F.sum(important_failures()).cast("bigint").alias("failed_command_count"),
        F.bool_or(no_edit_high()).alias("_no_edit_high"),
        F.bool_or(important_failures() > 0).alias("_failed"),
    )
    return rows.withColumn("warnings", F.array_sort(F.array_union("warnings", product_warnings()))).withColumn(
        "tokens_per_edit", tokens_per_edit()
    ).drop("_no_edit_high", "_failed")


# ---------------------------------------------------------------- charts

def timeline(hours: DataFrame, metric: str) -> DataFrame:
    """Metric per active day, or per hour when there are few days and enough hours.

    Days are summed from the hour rows, so sessions are read once.
    """
    hourly = hours.select(F.lit("hour").alias("grain"), "id", F.coalesce(metric, F.lit(0)).alias("value"))
    day = F.when(F.col("id") == "unknown-hour", "unknown-date").otherwise(F.substring("id", 1, 10))
    daily = hourly.groupBy(day.alias("id")).agg(F.sum("value").cast("bigint").alias("value")).withColumn("grain", F.lit("day"))
    points = hourly.unionByName(daily)
    counts = points.agg(((F.count_if(F.col("grain") == "day") <= 3) & (F.count_if(F.col("grain") == "hour") >= 4)).alias("few"))
    return points.where(F.col("grain") == F.when(counts.scalar(), "hour").otherwise("day"))


def timeline_stats(points: DataFrame) -> DataFrame:
    """Peak and mean of a timeline; a tie goes to the earliest point."""
    return points.agg(
        F.count("*").alias("points"), F.min_by("id", F.struct(-F.col("value"), F.col("id"))).alias("peak_id"),
        F.max("value").alias("peak_value"), total("value").alias("total_value"),
    )


def top_n_with_other(groups: DataFrame, metric: Column, n: int) -> DataFrame:
    """The n largest positive groups; the rest folded into one row."""
    n = max(1, n)
    # Groups are few; stored once, they serve the first n and the rest.
    positive = reliable_checkpoint(groups.withColumn("_m", metric).where(F.col("_m") > 0))
    visible = positive.orderBy(F.col("_m").desc(), "id").limit(n)
    hidden = positive.join(F.broadcast(visible.select("id")), "id", "left_anti")  # n rows
    sums = ["known_cost_sessions", "unknown_cost_sessions", *TOKENS, "session_count", "message_count"]
    other = with_codes(hidden, []).agg(
        F.count("_one").alias("_n"), F.sum("cost_micro").alias("cost_micro"), *[total(c).alias(c) for c in sums],
        code_set().alias("warnings"),
    ).where("_n > 0").select(
        F.lit("__other").alias("id"), F.concat(F.lit("Other ("), F.col("_n").cast("string"), F.lit(")")).alias("label"),
        "cost_micro", *sums, "warnings",
    )
    return visible.select(other.columns).unionByName(other)
