"""Normalized sessions from each source's records, and their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentally.functions import models as M
from tokentally.functions import records as R
from tokentally.operators import events, friction, otel, paths, pricing, rollout, transcripts, workspace
from tokentally.operators.rollout import FILE
from tokentally.operators.sessions import cost_warnings, service_tier_summary
from tokentally.runtime import parsed_once, reliable_checkpoint

THREAD_COLUMNS = [
    "id", "rollout_path", "created_at", "updated_at", "cwd", "title", "model_provider", "model", "tokens_used", "source", "thread_source",
]


def known_columns(table: DataFrame, wanted: list[str] = THREAD_COLUMNS) -> DataFrame:
    """A table's known columns; those it lacks are NULL, others are dropped."""
    present = {c.lower(): c for c in table.columns}
    return table.select(*[F.col(present[w]).alias(w) if w in present else F.lit(None).cast("string").alias(w) for w in wanted])


def _bucket_defaults(df: DataFrame) -> DataFrame:
    """Add the billing buckets a source does not report, as 0."""
    return df.withColumns({b: F.lit(0).cast("bigint") for b in pricing.BUCKETS if b not in df.columns})


def _priced(requests: DataFrame, cards: DataFrame, key: list[str], models: DataFrame | None) -> DataFrame:
    return pricing.session_costs(pricing.session_slices(_bucket_defaults(requests), cards, key, models), key)


def _with_repo(sessions: DataFrame, roots: DataFrame | None, aliases: DataFrame | None) -> DataFrame:
    """Repo root and name; a folder without a git root carries a warning."""
    if roots is None or aliases is None:
        base = F.coalesce(F.nullif(F.regexp_extract("cwd", r"([^/]+)/?$", 1), F.lit("")), F.lit("unknown-workspace"))
        named = sessions.withColumn("repo_root", F.col("cwd")).withColumn("repo_name", base).withColumn("verified", F.lit(False))
    else:
        named = paths.repo_identity(sessions, "cwd", roots, aliases)
    unverified = F.when(F.col("verified"), F.array().cast("array<string>")).otherwise(F.array(F.lit("repo_unverified_no_git_root")))
    return named.withColumn("warnings", F.array_distinct(F.concat(unverified, "warnings"))).drop("verified")


def _zero(*names: str) -> dict[str, Column]:
    return {n: F.lit(0).cast("bigint") for n in names}


NO_FRICTION = [
    "non_zero_command_events", "important_command_failures", "harmless_non_zero_events", "exploratory_misses", "repeated_failure_clusters",
]


def rollout_sessions(records: DataFrame, cards: DataFrame, roots: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Sessions of rollout logs, one per file (records parsed as ROLLOUT)."""
    records = parsed_once(records)
    facts, totals = rollout.session_fold(records), reliable_checkpoint(rollout.token_totals(records))
    issues = friction.issue_rollup(friction.command_issues(records, totals))
    models = facts.select(*FILE, F.col("model").alias("session_model"))
    costs = _priced(rollout.token_requests(records), cards, FILE, models).select(*FILE, "cost_micro", "model_usage", "price_warnings", "price_assumptions")
    joined = facts
    for part in (totals, rollout.message_counts(records), friction.tool_counts(records), issues, costs):
        joined = joined.join(part, FILE, "left")
    none = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("cached_input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)) + F.coalesce("reasoning_tokens", F.lit(0)) == 0
    raw = rollout.source_raw(F.col("thread_source"), F.col("source"), F.col("originator"))
    surface = rollout.detect_surface(raw, F.col("thread_source"))
    counts = [*pricing.BUCKETS, "token_snapshot_count", "message_count", "user_prompt_count", "assistant_message_count", "tool_call_count", "shell_command_count",
              "file_read_count", "file_edit_count", *NO_FRICTION]
    filled = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) if c in joined.columns else F.lit(0).cast("bigint") for c in counts})
    named = filled.withColumns({
        "id": F.coalesce("id", R.file_stem(F.col("file"))), "source_client": F.lit("codex"), "source_app": rollout.app_label(raw, F.col("thread_source")), "source_app_raw": raw,
        "cwd": F.coalesce("cwd", R.parent_path(F.col("file"))), "provider": F.coalesce("provider", M.rollout_provider(F.col("model"))),
        "detected_surface": surface["surface"], "surface_confidence": surface["confidence"], "surface_reason": surface["reason"],
        "token_aggregation_method": F.coalesce("token_aggregation_method", F.lit("unknown")), "token_confidence": F.coalesce("token_confidence", F.lit("low")),
        "failed_tool_call_count": F.col("important_command_failures"), "warnings": F.coalesce("warnings", F.array().cast("array<string>")),
    }).withColumn("session_outcome", R.infer_outcome()).withColumn("warnings", cost_warnings("codex", ~none))
    return _finish(_with_repo(named, roots, aliases))


def transcript_sessions(records: DataFrame, cards: DataFrame, roots: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Sessions of project transcripts, split by day and model (records parsed as TRANSCRIPT)."""
    # Nothing here looks at the text of a line again.
    records = parsed_once(records.drop("line"))
    events = parsed_once(transcripts.with_buckets(transcripts.distinct_usage(transcripts.usage_rows(records))))
    pieces = transcripts.split_sessions(events)
    flags = pieces.select(*FILE, "split").distinct()
    suffix = transcripts.piece_suffix(F.date_format("at", transcripts.DAY))
    keyed = events.join(flags, FILE).withColumn("suffix", F.when(F.col("split"), suffix).otherwise(""))
    key = [*FILE, "suffix"]
    billed = transcripts.billed_events(keyed)
    models = pieces.select(*key, F.col("model").alias("session_model"))
    costs = _priced(billed, cards, key, models).select(*key, "cost_micro", "price_warnings", "price_assumptions")
    tiers = service_tier_summary(keyed, key).withColumnRenamed("detail", "service_tier_detail")
    facts = transcripts.session_facts(records)
    whole = ["user_prompt_count", "tool_call_count", "shell_command_count", "file_read_count", "file_edit_count", "failed_tool_call_count"]
    piece = pieces.withColumnsRenamed({"started_at": "_from", "ended_at": "_to", "model": "_model"})
    joined = facts.join(piece, FILE, "left").withColumn("suffix", F.coalesce("suffix", F.lit("")))
    joined = joined.join(costs, key, "left").join(tiers, key, "left")
    split = F.coalesce("split", F.lit(False))
    named = joined.withColumns({
        **{c: F.when(split, F.lit(0)).otherwise(F.col(c)).cast("bigint") for c in whole},
        **{c: F.when(split, F.col("events")).otherwise(F.col(c)) for c in ("message_count", "assistant_message_count", "raw_event_count")},
        "started_at": F.when(split, F.col("_from")).otherwise(F.col("started_at")), "ended_at": F.when(split, F.col("_to")).otherwise(F.col("ended_at")),
        "model": F.col("_model"), "token_snapshot_count": F.coalesce("events", F.lit(0)), **{b: F.coalesce(b, F.lit(0)) for b in transcripts.BUCKETS},
        "reasoning_tokens": F.lit(0).cast("bigint"), "id": F.concat(F.coalesce("id", R.file_stem(F.col("file"))), "suffix"),
    })
    some = F.col("token_snapshot_count") > 0
    notes = F.array_compact(F.array(
        F.when(split, "claude_session_split_by_activity_day"), F.when(F.col("cwd").isNull(), "repo_inferred_from_claude_project_dir"),
        F.when(F.col("model").isNull() & ~some & (F.col("synthetic_count") > 0), "claude_synthetic_zero_usage"), F.when(~some, "missing_token_breakdown"),
    ))
    out = _bucket_defaults(named).withColumns({
        "total_tokens": F.col("input_tokens") + F.col("output_tokens"), "source_client": F.lit("claude"), "source_app": transcripts.app_label(F.col("entrypoint")),
        "source_app_raw": F.col("entrypoint"), "cwd": F.coalesce("cwd", R.project_path(R.parent_path(F.col("file")))), "provider": F.lit("anthropic"),
        "detected_surface": transcripts.surface(F.col("entrypoint")), "surface_confidence": F.lit("medium"), "warnings": notes,
        "surface_reason": F.coalesce(F.concat(F.lit("Claude Code entrypoint: "), "entrypoint"), F.lit("Claude Code transcript")),
        "token_aggregation_method": F.when(some, "direct_usage").otherwise("unknown"), "token_confidence": F.when(some, "high").otherwise("low"),
    }).withColumn("session_outcome", R.infer_outcome()).withColumn("warnings", cost_warnings("claude", some))
    return _finish(_with_repo(out.withColumns(_zero(*NO_FRICTION)), roots, aliases))


def otel_sessions(records: DataFrame, cards: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Sessions of telemetry files (records parsed as OTEL); no folder is logged there."""
    found = parsed_once(otel.file_events(records).select(*events.EVENT))
    merged = parsed_once(otel.merge_events(found))
    sessions = otel.merged_sessions(found, merged)
    if hints is not None:
        sessions = otel.apply_hints(sessions, hints)
    named = sessions.withColumns({
        "message_count": F.col("events"), "assistant_message_count": F.col("events"), "parse_status": F.lit("ok"), "surface": F.lit("cli"), "cwd": F.lit(None).cast("string"),
    })
    return _assistant_sessions(named, merged, cards, False)


def editor_sessions(records: DataFrame, cards: DataFrame, hints: DataFrame | None = None, roots: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Sessions of telemetry, debug logs, transcripts and session states together (records of ``sources.editor``)."""
    sessions, merged = events.merged_sessions(records, hints)
    return _assistant_sessions(sessions, merged, cards, True, roots, aliases)


def _assistant_sessions(sessions: DataFrame, merged: DataFrame, cards: DataFrame, located: bool, roots: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Priced sessions from their merged rows and token events; those without input tokens have no price."""
    key = ["host", "session_id"]
    requests = merged.withColumn("model", events.known_model(F.col("model")))
    total = F.col("input_tokens") + F.col("output_tokens") + F.col("reasoning_tokens")
    models = sessions.select(*key, M.pricing_model_id(F.col("model")).alias("session_model"))
    costs = _priced(requests.withColumn("total_tokens", total), cards, key, models).select(*key, "cost_micro", "price_warnings", "price_assumptions")
    priced = (total > 0) & (F.col("input_tokens") > 0)
    some = F.col("cwd").isNotNull()
    notes = F.array_compact(F.array(
        F.when(~some, "repo_unverified_no_git_root"), F.when(~some, "copilot_missing_cwd"), F.when((total > 0) & ~priced, "copilot_partial_token_breakdown"), F.when(total <= 0, "missing_token_breakdown")
    ))
    editor = F.col("surface") == "vscode"
    joined = _bucket_defaults(sessions.join(costs, key, "left").withColumns({
        "cost_micro": F.when(priced, F.col("cost_micro")), "total_tokens": total, "id": F.col("session_id"), "file": F.col("source_path"), "source_client": F.lit("copilot"),
        "source_app": F.when(editor, "VS Code").otherwise("Copilot CLI"), "source_app_raw": F.col("surface"),
        "provider": M.copilot_provider(F.col("model")), "model": M.pricing_model_id(F.col("model")), "detected_surface": F.when(editor, "vscode_extension").otherwise("terminal_cli"),
        "surface_confidence": F.lit("high"), "surface_reason": F.when(editor, "GitHub Copilot VS Code workspace storage").otherwise("GitHub Copilot OpenTelemetry export"),
        "token_aggregation_method": F.when(total > 0, "direct_usage").otherwise("unknown"),
        "token_confidence": F.when(total > 0, "high").otherwise("low"), "token_snapshot_count": F.col("events"), "warnings": F.array_distinct(F.concat(notes, "warnings")), "_priced": priced,
    }))
    told = joined.withColumn("warnings", cost_warnings("copilot", F.col("_priced"))).withColumns(_zero(*NO_FRICTION))
    unknown = {"repo_root": F.lit("unknown-copilot-repo"), "repo_name": F.lit("Unknown repo/folder"), "cwd": F.lit("")}
    if not located:
        return _finish(told.withColumns(unknown))
    return _finish(told.where(~some).withColumns(unknown)).unionByName(_finish(_with_repo(told.where(some), roots, aliases)))


def workspace_sessions(parts: DataFrame, cards: DataFrame, order: str, roots: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Sessions of workspace fragments, merged by id and priced as one request of unknown size."""
    merged = workspace.merge_fragments(parts, order).withColumnRenamed("cost_micro", "recorded_micro")
    first = parts.where("id is not null").select("host", "id", "file", F.col(order).alias("place"))
    rows = merged.join(first.dropDuplicates(["host", "id", "place"]), ["host", "id", "place"], "left")
    some = workspace.has_tokens()
    priced = pricing.price_requests(_bucket_defaults(rows).withColumn("request_input_tokens", F.lit(None).cast("bigint")), cards)
    none = F.array().cast("array<string>")
    notes = F.array_compact(F.array(
        F.when(F.col("merged"), "cursor_duplicate_session_merged"), F.when(F.col("estimated"), "cursor_prompt_token_breakdown_estimate"), F.when(~some, "missing_token_breakdown")
    ))
    surface = workspace.surface(F.col("file"))
    out = priced.withColumns({
        "cost_micro": F.when(some, pricing.pico_to_micro(F.col("cost_pico"))), "price_warnings": F.when(F.col("price_warning").isNotNull(), F.array("price_warning")).otherwise(none),
        "price_assumptions": F.when(F.col("price_assumption").isNotNull(), F.array("price_assumption")).otherwise(none),
    })
    out = workspace.with_recorded_cost(out).withColumns({
        "started_at": F.timestamp_millis("started_ms"), "ended_at": F.timestamp_millis("ended_ms"), "source_client": F.lit("cursor"), "source_app_raw": surface,
        "source_app": F.when(surface == "cli", "Cursor CLI").when(surface == "desktop", "Cursor Desktop").otherwise("Cursor"),
        "detected_surface": F.when(surface == "cli", "terminal_cli").when(surface == "desktop", "vscode_extension").otherwise("unknown"),
        "surface_confidence": F.when(surface == "unknown", "low").otherwise("medium"), "cwd": F.coalesce("cwd", R.parent_path(F.col("file"))),
        "surface_reason": F.when(surface == "cli", "Cursor local JSONL transcript").when(surface == "desktop", "Cursor local SQLite/vscdb storage").otherwise("Cursor local data"),
        "provider": M.workspace_provider(F.col("model")), "token_aggregation_method": F.when(some, F.when(F.col("estimated"), "estimated").otherwise("direct_usage")).otherwise("unknown"),
        "token_confidence": F.when(F.col("estimated") | ~some, "low").otherwise("medium"), "token_snapshot_count": F.lit(1).cast("bigint"), "parse_status": F.lit("ok"), "warnings": notes,
    }).withColumn("session_outcome", R.infer_outcome()).withColumn("warnings", cost_warnings("cursor", some))
    return _finish(_with_repo(out.withColumns(_zero(*NO_FRICTION)).withColumn("important_command_failures", F.col("failed_tool_call_count")), roots, aliases))


# Columns of the normalized session table, with the type of those a source may lack.
COLUMNS = {
    "host": "string", "id": "string", "source_client": "string", "source_app": "string", "source_app_raw": "string", "source_path": "string", "repo_root": "string",
    "repo_name": "string", "cwd": "string", "title": "string", "started_at": "timestamp", "ended_at": "timestamp", "duration_ms": "bigint", "model": "string", "provider": "string",
    **dict.fromkeys(pricing.BUCKETS, "bigint"), "token_aggregation_method": "string", "token_confidence": "string", "token_snapshot_count": "bigint", "cost_micro": "bigint",
    "raw_token_total": "bigint", "message_count": "bigint", "warnings": "array<string>", "raw_event_count": "bigint", "parse_status": "string", "parse_error_count": "bigint",
    "detected_surface": "string", "surface_confidence": "string", "surface_reason": "string", "session_outcome": "string", "service_tier": "string", "service_tier_detail": "string",
    "user_prompt_count": "bigint", "assistant_message_count": "bigint", "tool_call_count": "bigint", "shell_command_count": "bigint", "failed_tool_call_count": "bigint",
    **dict.fromkeys(NO_FRICTION, "bigint"), "command_issue_severity": "string", "command_issue_impact": "string", "top_failure_type": "string",
    "file_read_count": "bigint", "file_edit_count": "bigint",
}


def _finish(sessions: DataFrame) -> DataFrame:
    """The normalized columns, in order, with the model slices where a source has them."""
    slices = (
        "array<struct<model:string,request_count:bigint,input_tokens:bigint,cached_input_tokens:bigint,cache_write_tokens:bigint,cache_write_30m:bigint,"
        "cache_write_12h:bigint,output_tokens:bigint,reasoning_tokens:bigint,total_tokens:bigint,cost_micro:bigint>>"
    )
    out = sessions.withColumns({
        "source_path": F.col("file"), "duration_ms": R.duration_ms(F.col("started_at"), F.col("ended_at")), "raw_token_total": F.nullif("total_tokens", F.lit(0)),
    })
    failed = F.col("failed_tool_call_count") > 0 if "failed_tool_call_count" in out.columns else F.lit(False)
    for name, on in (("command_issue_severity", "warning"), ("command_issue_impact", "medium")):
        if name not in out.columns:
            out = out.withColumn(name, F.when(failed, on).otherwise("none"))
    kept = [(F.col(c) if c in out.columns else F.lit(None)).cast(kind).alias(c) for c, kind in COLUMNS.items()]
    usage = (F.col("model_usage") if "model_usage" in out.columns else F.lit(None)).cast(slices).alias("model_usage")
    return out.select(*kept, usage)


def union_sources(sessions: list[DataFrame]) -> DataFrame:
    """All sources as one table."""
    return reduce(lambda a, b: a.unionByName(b), sessions)
