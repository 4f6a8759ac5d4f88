"""Exports. Each builds the rows to write; ``write_*`` hands them to Spark's writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentally.functions import labels as L
from tokentally.functions import text
from tokentally.operators.groups import important_failures

# Export column -> session column.
CSV_COLUMNS = {
    "id": "id", "sourceClient": "source_client", "sourceApp": "source_app", "sourceAppRaw": "source_app_raw", "sourcePath": "source_path",
    "repoRoot": "repo_root", "repoName": "repo_name", "cwd": "cwd", "gitRemoteUrl": "git_remote_url", "gitBranch": "git_branch", "title": "title",
    "startedAt": "started_at", "endedAt": "ended_at", "model": "model", "provider": "provider", "inputTokens": "input_tokens",
    "cachedInputTokens": "cached_input_tokens", "cacheCreationInputTokens": "cache_write_tokens", "cacheCreationInputTokens5m": "cache_write_5m",
    "cacheCreationInputTokens1h": "cache_write_1h", "cacheCreationInputTokens30m": "cache_write_30m", "cacheCreationInputTokens12h": "cache_write_12h",
    "outputTokens": "output_tokens", "reasoningTokens": "reasoning_tokens", "reasoningOutputTokens": "reasoning_tokens", "totalTokens": "total_tokens",
    "tokenAggregationMethod": "token_aggregation_method", "tokenConfidence": "token_confidence", "tokenSnapshotCount": "token_snapshot_count",
    "estimatedCostUsd": "cost_micro", "messageCount": "message_count", "rawTokenTotal": "raw_token_total", "warnings": "warnings", "codexHome": "home",
    "durationMs": "duration_ms", "rawEventCount": "raw_event_count", "parseStatus": "parse_status", "parseErrors": "parse_errors",
    "detectedSurface": "detected_surface", "surfaceConfidence": "surface_confidence", "surfaceReason": "surface_reason",
    "userPromptCount": "user_prompt_count", "assistantMessageCount": "assistant_message_count", "toolCallCount": "tool_call_count",
    "shellCommandCount": "shell_command_count", "failedToolCallCount": "failed_tool_call_count", "nonZeroCommandEvents": "non_zero_command_events",
    "importantCommandFailures": "important_command_failures", "harmlessNonZeroEvents": "harmless_non_zero_events",
    "exploratoryMisses": "exploratory_misses", "repeatedFailureClusters": "repeated_failure_clusters", "commandIssueSeverity": "command_issue_severity",
    "commandIssueImpact": "command_issue_impact", "topFailureType": "top_failure_type", "fileReadCount": "file_read_count",
    "fileEditCount": "file_edit_count", "sessionOutcome": "session_outcome",
}


def _exported(sessions: DataFrame, column: str) -> Column:
    if column not in sessions.columns:
        return F.lit(None).cast("string")
    kind = sessions.schema[column].dataType.typeName()
    if column == "cost_micro":
        return F.col(column).cast("double") / 1_000_000.0
    if kind == "timestamp":
        return text.iso_millis(F.col(column))
    if kind == "array":
        return F.array_join(column, ";")
    return F.col(column)


def csv_rows(sessions: DataFrame) -> DataFrame:
    """The 57 export columns; lists joined by ';', instants as ISO text."""
    return sessions.select(*[_exported(sessions, column).alias(name) for name, column in CSV_COLUMNS.items()])


def sessions_csv_rows(sessions: DataFrame) -> DataFrame:
    """The 22 columns of the presentation export."""
    def zero(name: str) -> Column:
        return F.coalesce(name, F.lit(0))

    first_prompt = F.col("first_prompt") if "first_prompt" in sessions.columns else F.lit(None).cast("string")
    return sessions.select(
        F.col("repo_name").alias("repo"), F.col("repo_root").alias("repoRoot"), L.source_label(F.col("source_client")).alias("source"),
        F.coalesce("source_app", L.surface_label(F.col("detected_surface"))).alias("app"),
        L.display_title(F.col("title"), first_prompt, F.col("id")).alias("session"), F.col("id").alias("sessionId"),
        F.coalesce("model", F.lit("Unknown")).alias("model"), F.coalesce(text.iso_millis(F.col("started_at")), F.lit("")).alias("startedAt"),
        F.col("duration_ms").alias("durationMs"), (F.col("cost_micro").cast("double") / 1_000_000.0).alias("estimatedCostUsd"),
        F.col("total_tokens").alias("totalTokens"), F.col("input_tokens").alias("inputTokens"), F.col("cached_input_tokens").alias("cachedInputTokens"),
        F.col("output_tokens").alias("outputTokens"), F.col("reasoning_tokens").alias("reasoningTokens"), F.col("message_count").alias("messages"),
        zero("user_prompt_count").alias("prompts"), zero("shell_command_count").alias("commands"), important_failures().alias("commandIssues"),
        zero("file_edit_count").alias("fileEdits"), F.coalesce("session_outcome", F.lit("unknown")).alias("outcome"),
        F.coalesce("token_confidence", F.lit("unknown")).alias("tokenConfidence"),
    )


def intensity_label() -> Column:
    """Tokens per edit of a repo row, as text."""
    return F.when(F.col("tokens_per_edit").isNull(), "No edits").otherwise(F.concat(text.compact_number(F.col("tokens_per_edit")), F.lit(" tokens / edit")))


def repos_csv_rows(repos: DataFrame) -> DataFrame:
    """The 13 columns of the repo export."""
    return repos.select(
        F.col("label").alias("repo"), F.col("id").alias("repoRoot"), (F.col("cost_micro").cast("double") / 1_000_000.0).alias("estimatedCostUsd"),
        F.col("total_tokens").alias("totalTokens"), F.col("input_tokens").alias("inputTokens"), F.col("cached_input_tokens").alias("cachedInputTokens"),
        F.col("output_tokens").alias("outputTokens"), F.col("reasoning_tokens").alias("reasoningTokens"), F.col("session_count").alias("sessions"),
        F.col("file_edit_count").alias("fileEdits"), F.col("failed_command_count").alias("commandIssues"), intensity_label().alias("tokenRoi"),
        F.array_join("warnings", "; ").alias("warnings"),
    )


def json_rows(sessions: DataFrame) -> DataFrame:
    """One JSON document per session; unknown fields are left out."""
    return sessions.select("id", F.to_json(F.struct("*")).alias("json"))


def group_report(groups: DataFrame) -> DataFrame:
    """name, cost to four decimals or 'unknown', tokens, sessions."""
    tenths = F.call_function("div", F.col("cost_micro") + 50, F.lit(100))  # ten-thousandths of a dollar
    cost = F.concat(F.lit("$"), F.call_function("div", tenths, F.lit(10_000)).cast("string"), F.lit("."), F.lpad(F.pmod(tenths, F.lit(10_000)).cast("string"), 4, "0"))
    return groups.select(F.col("label").alias("name"), F.coalesce(cost, F.lit("unknown")).alias("cost"), F.col("total_tokens").alias("tokens"), F.col("session_count").alias("sessions"))


def doctor_metrics(confidence: DataFrame) -> DataFrame:
    """(metric, value) rows of the data-confidence row."""
    c = F.col

    def coverage(pct: str, part: str, whole: str, word: str = "") -> Column:
        return F.concat(F.floor(c(pct) * 100 + 0.5).cast("string"), F.lit(f"%{word} ("), c(part).cast("string"), F.lit("/"), c(whole).cast("string"), F.lit(")"))

    values = [
        ("Sessions", c("session_count").cast("string")),
        ("Token data coverage", coverage("token_data_pct", "token_data_sessions", "session_count")),
        ("Pricing coverage", coverage("pricing_coverage_pct", "priced_token_sessions", "token_data_sessions")),
        ("Repo grouping", coverage("verified_repo_pct", "verified_repo_sessions", "session_count", " verified")),
        ("Parse issues", c("parse_issue_count").cast("string")),
        ("Source warnings", c("source_warning_count").cast("string")),
    ]
    return confidence.select(F.inline(F.array(*[F.struct(F.lit(name).alias("metric"), value.alias("value")) for name, value in values])))


def doctor_sources(stats: DataFrame) -> DataFrame:
    """The per-source table of the doctor report."""
    return stats.select(
        L.source_label(F.col("source")).alias("source"), F.col("sessions_imported").alias("imported"), F.col("session_file_count").alias("files"),
        F.col("parse_failure_count").alias("parse_issues"), F.when(F.col("session_file_count") > 0, "found").otherwise("missing").alias("primary_data"),
    )


def scan_report(summary: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: the sources seen, and the session count, cost and tokens."""
    sources = stats.agg(F.array_join(F.array_sort(F.collect_list("source")), ";")).scalar()
    return summary.select(sources.alias("sources"), "session_count", "cost_micro", "total_tokens", "repo_count")


def write_csv(rows: DataFrame, path: str) -> None:
    """Write CSV files with a header; quotes are doubled inside quoted fields."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def write_json(sessions: DataFrame, path: str) -> None:
    sessions.write.mode("overwrite").json(path)
