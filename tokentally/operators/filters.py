"""Session filters. Every predicate is a Column, so Spark pushes what it can."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentally.operators.groups import HIGH_TOKENS, TOKENS, has_warning, important_failures, ratio, total

UNKNOWN_MODEL = "unknown-model"
from tokentally.runtime import reliable_checkpoint


@dataclass
class Filters:
    """Values of one list are alternatives; an empty list passes everything."""

    source: list[str] = field(default_factory=list)
    source_app: list[str] = field(default_factory=list)
    repo: list[str] = field(default_factory=list)
    model: list[str] = field(default_factory=list)
    start: str | None = None
    end: str | None = None


def lower_bound(value: str) -> str:
    return value if "T" in value else f"{value}T00:00:00.000Z"


def upper_bound(value: str) -> str:
    return value if "T" in value else f"{value}T23:59:59.999Z"


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


def in_dates(start: str | None, end: str | None, column: str = "started_at") -> Column:
    """Inclusive bounds at millisecond precision; no time, no match."""
    tests = []
    if start:
        tests.append(F.col(column) >= F.lit(lower_bound(start)).cast("timestamp"))
    if end:
        # Anything within the last named millisecond still belongs to it.
        tests.append(F.col(column) < F.timestamp_add("MILLISECOND", F.lit(1), F.lit(upper_bound(end)).cast("timestamp")))
    return F.coalesce(_all(tests), F.lit(False))


def model_matches(models: list[str]) -> Column:
    def wanted(model: Column) -> Column:
        return F.coalesce(model, F.lit(UNKNOWN_MODEL)).isin(models)

    return F.when(F.size("model_usage") > 0, F.exists("model_usage", lambda s: wanted(s["model"]))).otherwise(wanted(F.col("model")))


def usage_predicate(filters: Filters) -> Column:
    tests = []
    if filters.source:
        tests.append(F.col("source_client").isin(filters.source))
    if filters.source_app:
        tests.append(F.col("source_app").isin(filters.source_app))
    if filters.repo:
        tests.append(F.col("repo_name").isin(filters.repo) | F.col("repo_root").isin(filters.repo))
    if filters.model:
        tests.append(model_matches(filters.model))
    if filters.start or filters.end:
        tests.append(in_dates(filters.start, filters.end))
    return _all(tests)


def project_models(sessions: DataFrame, models: list[str]) -> DataFrame:
    """Reduce sessions with slices to the chosen models' tokens and cost."""
    kept = F.filter("model_usage", lambda s: F.coalesce(s["model"], F.lit(UNKNOWN_MODEL)).isin(models))
    slices = sessions.withColumn("_kept", F.when(F.size("model_usage") > 0, kept))
    has = F.col("_kept").isNotNull()
    zero = F.lit(0).cast("bigint")

    def summed(column: str) -> Column:
        return F.aggregate("_kept", zero, lambda acc, s: acc + F.coalesce(s[column], zero))

    in_slices = {"cache_write_5m": zero, "cache_write_1h": zero}
    cost = F.when(F.forall("_kept", lambda s: s["cost_micro"].isNotNull()), summed("cost_micro"))
    still = F.exists("_kept", lambda s: s["model"] == F.col("model"))
    model = F.when(F.coalesce(still, F.lit(False)), F.col("model")).otherwise(F.get("_kept", F.lit(0))["model"])
    changed = {c: F.when(has, in_slices[c] if c in in_slices else summed(c)).otherwise(F.col(c)).alias(c) for c in TOKENS}
    changed["cost_micro"] = F.when(has, cost).otherwise(F.col("cost_micro")).alias("cost_micro")
    changed["model"] = F.when(has, model).otherwise(F.col("model")).alias("model")
    changed["model_usage"] = F.when(has, F.col("_kept")).otherwise(F.col("model_usage")).alias("model_usage")
    return slices.select(*[changed.get(c, F.col(c)) for c in sessions.columns])


def filter_usage(sessions: DataFrame, filters: Filters) -> DataFrame:
    kept = sessions.where(usage_predicate(filters))
    return project_models(kept, filters.model) if filters.model else kept


# ---------------------------------------------------------------- named predicates

def quick_filters() -> dict[str, Column]:
    app, surface = F.lower("source_app"), F.col("detected_surface")
    no_edits = F.coalesce("file_edit_count", F.lit(0)) == 0
    return {
        "highToken": F.col("total_tokens") >= HIGH_TOKENS,
        "failedCommands": important_failures() > 0,
        "noEdits": no_edits,
        "completed": F.col("session_outcome") == "completed",
        "partial": F.col("session_outcome") == "partial",
        "vscode": F.coalesce(surface == "vscode_extension", F.lit(False)) | app.contains("vs code"),
        "terminal": F.coalesce(surface == "terminal_cli", F.lit(False)) | app.contains("terminal"),
        "unknownSurface": F.coalesce(surface, F.lit("unknown")) == "unknown",
    }


def needs_command_review() -> Column:
    important = important_failures()
    non_zero = F.coalesce("non_zero_command_events", important)
    commands = F.coalesce("shell_command_count", F.lit(0))
    unfinished = F.coalesce(F.col("session_outcome").isin("partial", "failed"), F.lit(False))
    return (
        (important > 0)
        | (F.coalesce("repeated_failure_clusters", F.lit(0)) > 0)
        | ((commands >= 4) & (ratio(non_zero, commands) >= 0.5))
        | ((F.col("total_tokens") >= HIGH_TOKENS) & (non_zero > 0))
        | (unfinished & (non_zero > 0))
    )


def is_harmless() -> Column:
    quiet = (F.coalesce("harmless_non_zero_events", F.lit(0)) > 0) | (F.coalesce("exploratory_misses", F.lit(0)) > 0)
    return (important_failures() == 0) & quiet


def is_unpriced() -> Column:
    return F.col("cost_micro").isNull() & (F.col("total_tokens") > 0)


def waste_predicates() -> dict[str, Column]:
    big = F.col("total_tokens") >= HIGH_TOKENS
    return {
        "high-token-no-edit": (F.coalesce("file_edit_count", F.lit(0)) == 0) & big,
        "high-token-low-output": big & (F.col("output_tokens").cast("double") / F.greatest("total_tokens", F.lit(1)).cast("double") < 0.03),
        "command-issue-sessions": important_failures() > 0,
        "unknown-repos": has_warning("repo_unverified_no_git_root"),
        "unknown-surfaces": F.coalesce("detected_surface", F.lit("unknown")) == "unknown",
        "repeated-errors": F.exists("warnings", lambda w: w.contains("repeated_error")),
    }


def count_predicates(sessions: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """(id, sessions) per predicate, from one pass."""
    counts = sessions.agg(*[F.count_if(p).alias(f"c{i}") for i, p in enumerate(predicates.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("id"), F.col(f"c{i}").alias("sessions")) for i, name in enumerate(predicates)])
    return counts.select(F.inline(rows))


# ---------------------------------------------------------------- outliers

def exact_rank_value(values: DataFrame, group: list[str], value: str, rank: Column, step: int = 1 << 20) -> DataFrame:
    """The value at a 1-based rank of each group, exactly and without a sort of all rows.

    Values are whole numbers of zero or more. A histogram by value div step
    finds the bucket holding the rank; only that bucket's distinct values are
    then counted. ``rank`` may use n, the number of values in the group.
    """
    from pyspark.sql import Window

    bucketed = values.where(F.col(value).isNotNull()).withColumn("_b", F.call_function("div", F.col(value), F.lit(step)))

    def upto(column: str) -> Window:
        return Window.partitionBy(*group, "_g").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)

    buckets = bucketed.groupBy(*group, "_b").agg(F.count("*").alias("_n")).withColumn("_g", F.lit(0))
    whole = Window.partitionBy(*group, "_g")
    buckets = buckets.withColumn("_upto", F.sum("_n").over(upto("_b"))).withColumn("n", F.sum("_n").over(whole)).withColumn("_rank", rank)
    target = buckets.where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank"))).select(
        *group, "_b", "n", "_rank", (F.col("_upto") - F.col("_n")).alias("_before")
    )
    inside = bucketed.groupBy(*group, "_b", value).agg(F.count("*").alias("_n")).join(target, [*group, "_b"]).withColumn("_g", F.lit(0))
    inside = inside.withColumn("_upto", F.col("_before") + F.sum("_n").over(upto(value)))
    return inside.where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank"))).select(*group, value, "n")


def cost_thresholds(sessions: DataFrame, group: list[str]) -> DataFrame:
    """Cost from which a session of a group is an outlier, in micro-USD.

    The larger of twice the mean and the value at position floor(0.75 n); with
    fewer than three priced sessions, the largest cost.
    """
    priced = sessions.where("cost_micro is not null")
    n = F.col("n")
    three_quarters = exact_rank_value(priced, group, "cost_micro", F.when(n < 3, n).otherwise(F.floor(n * 0.75) + 1))
    means = priced.groupBy(*group).agg(F.sum("cost_micro").alias("_sum"), F.count("*").alias("_n"))
    if group:
        joined = three_quarters.join(means, group)
    else:
        joined = three_quarters.withColumn("_m", means.select(F.struct("_sum", "_n")).scalar()).select("*", "_m.*")
    twice = F.col("_sum").cast("double") * 2 / F.col("_n").cast("double")
    threshold = F.when(n < 3, F.col("cost_micro").cast("double")).otherwise(F.greatest(twice, F.col("cost_micro").cast("double")))
    return joined.select(*group, threshold.alias("cost_threshold"))


def is_cost_outlier() -> Column:
    return F.coalesce((F.col("cost_micro") >= F.col("cost_threshold")) & (F.col("cost_micro") > 0), F.lit(False))


def group_means(sessions: DataFrame, group: list[str]) -> DataFrame:
    """Sums behind the per-group means: positive durations and tokens."""
    running = F.when(F.col("duration_ms") > 0, F.col("duration_ms"))
    return sessions.groupBy(*group).agg(
        F.sum(running).alias("duration_sum"), F.count(running).alias("duration_n"),
        F.sum("total_tokens").alias("token_sum"), F.count("*").alias("token_n"),
    )


def is_long_running() -> Column:
    mean = F.col("duration_sum").cast("double") / F.col("duration_n").cast("double")
    limit = F.greatest(F.lit(3_600_000.0), mean * 1.75)
    return F.coalesce((F.col("duration_ms") > 0) & (F.col("duration_ms") >= limit), F.lit(False))


def is_token_outlier() -> Column:
    mean = F.col("token_sum").cast("double") / F.col("token_n").cast("double")
    return (F.col("total_tokens") >= HIGH_TOKENS) | ((mean > 0) & (F.col("total_tokens") >= mean * 2.5))


OUTLIER_COLUMNS = ["repo_root", "cost_micro", "duration_ms", "total_tokens"]


def once(sessions: DataFrame, *columns: str) -> DataFrame:
    """The columns that outlier tests read, and others, materialized: the tests read them several times."""
    return reliable_checkpoint(sessions.select(*dict.fromkeys([*columns, *OUTLIER_COLUMNS])))


def with_group_outliers(sessions: DataFrame, group: list[str]) -> DataFrame:
    """Sessions with cost_outlier, long_running and token_outlier, relative to their group."""
    limits = group_means(sessions, group).join(cost_thresholds(sessions, group), group, "left")
    joined = sessions.join(limits, group, "left")
    return joined.select(
        *sessions.columns, is_cost_outlier().alias("cost_outlier"), is_long_running().alias("long_running"), is_token_outlier().alias("token_outlier")
    )


def with_overall_outliers(sessions: DataFrame) -> DataFrame:
    """As with_group_outliers, relative to all sessions."""
    means = group_means(sessions, []).select(F.struct("*")).scalar()
    threshold = cost_thresholds(sessions, []).scalar()
    joined = sessions.withColumn("_m", means).withColumn("cost_threshold", threshold).select("*", "_m.*")
    return joined.select(
        *sessions.columns, is_cost_outlier().alias("cost_outlier"), is_long_running().alias("long_running"), is_token_outlier().alias("token_outlier")
    )


def repo_quick_filters() -> dict[str, Column]:
    """Predicates over with_group_outliers(sessions, ['repo_root'])."""
    return {
        "expensive": F.col("cost_outlier"),
        "partial": F.coalesce(F.col("session_outcome").isin("partial", "failed"), F.lit(False)),
        "longRunning": F.col("long_running"),
        "commandIssues": (important_failures() > 0) | (F.coalesce("repeated_failure_clusters", F.lit(0)) > 0),
        "opusOnly": F.lower(F.coalesce("model", F.lit(""))).contains("opus"),
    }


# ---------------------------------------------------------------- windows of time

ROLLING_HOURS = {"lastHour": 1, "last6": 6, "last12": 12, "last24": 24}
ROLLING_DAYS = {"last7": 7, "last14": 14, "last30": 30}
PRESETS = [*ROLLING_HOURS, *ROLLING_DAYS, "thisWeek", "thisMonth", "all"]


def preset_range(preset: str, now: datetime) -> tuple[str, str]:
    """(from, to) of a named range; empty strings for no bound."""
    now = now.astimezone(timezone.utc)
    if preset in ROLLING_HOURS:
        start = now - timedelta(hours=ROLLING_HOURS[preset])
        return tuple(d.isoformat(timespec="milliseconds").replace("+00:00", "Z") for d in (start, now))
    today = now.date()
    if preset in ROLLING_DAYS:
        return str(today - timedelta(days=ROLLING_DAYS[preset])), str(today)
    if preset == "thisWeek":
        return str(today - timedelta(days=today.weekday())), str(today)
    if preset == "thisMonth":
        return str(today.replace(day=1)), str(today)
    return "", ""


def preset_columns(preset: str, now: Column) -> Column:
    """The same range as a struct of two strings, for a column of instants."""
    millis = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"

    def day(c: Column) -> Column:
        return F.date_format(c, "yyyy-MM-dd")

    if preset in ROLLING_HOURS:
        start, end = F.date_format(F.timestamp_add("HOUR", F.lit(-ROLLING_HOURS[preset]), now), millis), F.date_format(now, millis)
    elif preset in ROLLING_DAYS:
        start, end = day(F.timestamp_add("DAY", F.lit(-ROLLING_DAYS[preset]), now)), day(now)
    elif preset == "thisWeek":
        start, end = day(F.date_trunc("week", now)), day(now)
    elif preset == "thisMonth":
        start, end = day(F.date_trunc("month", now)), day(now)
    else:
        start, end = F.lit(""), F.lit("")
    return F.struct(F.lit(preset).alias("preset"), start.alias("start"), end.alias("end"))


def file_may_overlap(start_ms: int | None, end_ms: int | None, mtime_ms: str = "mtime_ms") -> Column:
    """Keep files that may hold records of a window, by modification time."""
    tests = []
    if start_ms:
        tests.append(F.col(mtime_ms) >= start_ms)
    if end_ms:
        tests.append(F.col(mtime_ms) <= end_ms)
    return F.coalesce(_all(tests), F.lit(True))


def thread_may_overlap(start_ms: int | None, end_ms: int | None) -> Column:
    """Keep thread rows by updated_ms (else created_ms) and created_ms."""
    tests = []
    if start_ms is not None:
        tests.append(F.coalesce(F.coalesce("updated_ms", "created_ms") >= start_ms, F.lit(True)))
    if end_ms is not None:
        tests.append(F.coalesce(F.col("created_ms") <= end_ms, F.lit(True)))
    return _all(tests)


def search_timeline(items: DataFrame, role: str, text: str) -> DataFrame:
    """Timeline items of a role ('all' for any) whose text holds a phrase."""
    found = items if role == "all" else items.where(F.col("role") == role)
    phrase = text.strip().lower()
    return found.where(F.lower("text").contains(phrase)) if phrase else found


def list_totals(sessions: DataFrame) -> DataFrame:
    """One row of totals over a session list."""
    read = ["shell_command_count", "file_edit_count", "important_command_failures", "failed_tool_call_count", "non_zero_command_events", "repeated_failure_clusters", "session_outcome"]
    outliers = with_overall_outliers(once(sessions, *read))
    return outliers.agg(
        F.count("*").alias("sessions"), total("total_tokens").alias("total_tokens"), F.sum("cost_micro").alias("cost_micro"),
        total("shell_command_count").alias("commands"), total("file_edit_count").alias("edits"),
        F.count_if(needs_command_review()).alias("to_review"), F.count_if("cost_outlier").alias("cost_outliers"),
    )
