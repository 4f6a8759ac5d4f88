"""Sort orders by key. An id breaks every tie, so a sort is the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentally.functions import labels as L
from tokentally.functions import text
from tokentally.operators.groups import important_failures, ratio
from tokentally.runtime import reliable_checkpoint
from tokentally.sources.files import ROW_BITS

LOWEST = -1  # an unknown cost sorts below every known one


def _direction(keys: list[Column], descending: bool) -> list[Column]:
    return [k.desc() if descending else k.asc() for k in keys]


def repo_keys() -> dict[str, Column]:
    edits = F.coalesce("file_edit_count", F.lit(0))
    return {
        "repo": F.col("label"), "cost": F.coalesce("cost_micro", F.lit(LOWEST)), "tokens": F.col("total_tokens"), "input": F.col("input_tokens"),
        "cached": F.col("cached_input_tokens"), "output": F.col("output_tokens"), "reasoning": F.col("reasoning_tokens"),
        "sessions": F.col("session_count"), "files": edits, "failed": F.col("failed_command_count"),
        "roi": F.when(edits == 0, F.lit(float("inf"))).otherwise(F.col("total_tokens").cast("double") / F.nullif(edits, F.lit(0)).cast("double")),
        "warnings": F.size("warnings"), "cache": ratio(F.col("cached_input_tokens"), F.col("input_tokens")),
    }


def model_keys() -> dict[str, Column]:
    return {
        "model": F.col("label"), "cost": F.coalesce("cost_micro", F.lit(LOWEST)), "tokens": F.col("total_tokens"), "input": F.col("input_tokens"),
        "cached": F.col("cached_input_tokens"), "output": F.col("output_tokens"), "reasoning": F.col("reasoning_tokens"),
        "sessions": F.col("session_count"), "cache": F.col("cache_rate"), "repo": F.coalesce("top_repo", F.lit("")), "latest": F.col("latest_session"),
    }


def session_keys() -> dict[str, Column]:
    def zero(name: str) -> Column:
        return F.coalesce(name, F.lit(0))

    return {
        "repo": F.col("repo_name"), "app": F.concat_ws(" ", L.source_label(F.col("source_client")), "source_app"), "session": F.coalesce("title", "id"),
        "model": F.coalesce("model", F.lit("Unknown")), "started": F.col("started_at"), "cost": F.coalesce("cost_micro", F.lit(LOWEST)),
        "tokens": F.col("total_tokens"), "input": F.col("input_tokens"), "cached": F.col("cached_input_tokens"), "output": F.col("output_tokens"),
        "reasoning": F.col("reasoning_tokens"), "duration": zero("duration_ms"), "prompts": zero("user_prompt_count"), "commands": zero("shell_command_count"),
        "files": zero("file_edit_count"), "failed": important_failures(), "warnings": F.size("warnings"), "messages": F.col("message_count"),
    }


def saved_command_keys() -> dict[str, Column]:
    return {
        "command": F.col("command"), "count": F.coalesce("count", F.lit(0)), "saved": F.coalesce(text.token_amount(F.col("saved")), F.lit(0)),
        "reduction": F.coalesce("average_saved_percent", F.lit(-1.0)), "runtime": text.duration_amount(F.col("time")),
    }


def sort_repos(repos: DataFrame, key: str, descending: bool = False) -> DataFrame:
    return repos.orderBy(*_direction([repo_keys()[key]], descending), "id")


def sort_models(models: DataFrame, key: str, descending: bool = False) -> DataFrame:
    return models.orderBy(*_direction([model_keys()[key]], descending), "id")


def sort_sessions(sessions: DataFrame, key: str, descending: bool = False) -> DataFrame:
    return sessions.orderBy(*_direction([session_keys()[key]], descending), "id")


def sort_saved_commands(commands: DataFrame, key: str, descending: bool = False) -> DataFrame:
    return commands.orderBy(*_direction([saved_command_keys()[key]], descending), "command", *[c for c in ("host", "file") if c in commands.columns])


def sort_review(sessions: DataFrame) -> DataFrame:
    """Failures, repeated clusters, tokens, largest first."""
    return sessions.orderBy(important_failures().desc(), F.coalesce("repeated_failure_clusters", F.lit(0)).desc(), F.col("total_tokens").desc(), "id")


def with_position(ordered: DataFrame) -> DataFrame:
    """The place of each row of a sorted table, from 0, as ``position``.

    A row's number in its task is added to the sizes of the tasks before it, so
    no task numbers all rows.
    """
    kept = reliable_checkpoint(ordered.withColumn("_at", F.monotonically_increasing_id()))
    placed = kept.withColumn("_task", F.shiftright("_at", 33))
    # One row for each task of the sort.
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_task").agg(F.count("*").alias("_n")).select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    row = F.col("_at").bitwiseAND(F.lit(ROW_BITS))
    return placed.join(sizes, "_task").withColumn("position", F.col("_before") + row).drop("_task", "_at", "_before")
