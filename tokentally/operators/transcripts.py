"""Project transcripts: usage of streamed messages, counted once, and split sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentally.functions import models as M
from tokentally.functions import records as R
from tokentally.functions.records import first_count, first_text
from tokentally.operators.rollout import FILE

RAW = ["raw_input", "cache_read", "cache_created", "created_5m", "created_1h", "raw_output"]
BUCKETS = ["input_tokens", "cached_input_tokens", "cache_write_tokens", "cache_write_5m", "cache_write_1h", "output_tokens"]
DAY = "yyyy-MM-dd"


def usage_rows(records: DataFrame) -> DataFrame:
    """Records that bill tokens: raw counts, clean model, time, and the request key.

    The key is host, request and message id; a record without both ids has none.
    """
    u = "rec.message.usage"
    rows = records.where("NOT bad").selectExpr(
        *FILE, "ord", "mtime_ms", "try_cast(rec.timestamp AS timestamp) AS at", f"if(rec.message.model <> '<synthetic>', {first_text('rec.message.model')}, NULL) AS model",
        "if(rec.requestId <> '' AND rec.message.id <> '', concat(rec.requestId, ':', rec.message.id), NULL) AS request_key",
        f"{first_count(u, 'input_tokens')} AS raw_input", f"try_cast({u}.input_tokens AS bigint) >= 0 AS has_input",
        f"{first_count(u, 'cache_read_input_tokens')} AS cache_read", f"{first_count(u, 'cache_creation_input_tokens')} AS cache_created",
        f"{first_count(u + '.cache_creation', 'ephemeral_5m_input_tokens')} AS created_5m", f"{first_count(u + '.cache_creation', 'ephemeral_1h_input_tokens')} AS created_1h",
        f"{first_count(u, 'output_tokens')} AS raw_output", f"nullif({u}.service_tier, '') AS service_tier", f"nullif({u}.speed, '') AS speed",
    )
    return rows.where("raw_input + cache_read + greatest(cache_created, created_5m + created_1h) + raw_output > 0")


def with_buckets(usages: DataFrame) -> DataFrame:
    """Token buckets: input counts cache reads and writes; there is no reasoning."""
    written = "greatest(cache_created, created_5m + created_1h)"
    return usages.selectExpr(
        f"* except ({', '.join(RAW)}, has_input)", f"raw_input + cache_read + {written} AS input_tokens", "cache_read AS cached_input_tokens",
        f"{written} AS cache_write_tokens", "created_5m AS cache_write_5m", "created_1h AS cache_write_1h", "raw_output AS output_tokens",
        f"if(has_input, raw_input + cache_read + {written}, NULL) AS request_input_tokens",
    )


PART = ["host", "request_key", "first", *RAW, "has_input", "tier", "pace", "copies"]


def usage_parts(usages: DataFrame) -> DataFrame:
    """What some of the copies of each request say of it: the first copy, the largest counts, the first
    known tier and speed, each with its place, and how many copies there are.

    Parts of any shares of the copies, made in any order, merge to the part of all of them. Usage without a key is a part of its own.
    """
    place = ["mtime_ms", "file", "ord"]

    def placed(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.struct(*place, F.col(name).alias("value")))

    own = F.concat(F.lit("\u0000"), "file", F.lit(":"), F.col("ord").cast("string"))
    return usages.select(
        "host", F.coalesce("request_key", own).alias("request_key"), F.struct(*place, "at", "model").alias("first"), *RAW, "has_input",
        placed("service_tier").alias("tier"), placed("speed").alias("pace"), F.lit(1).cast("bigint").alias("copies"),
    )


def merge_usage(parts: DataFrame) -> DataFrame:
    """One part of each request. Copies are reduced by aggregates with map-side partials, so a request logged
    any number of times, in any number of files, costs one row per task."""
    place = F.struct("first.mtime_ms", "first.file", "first.ord")
    return parts.groupBy("host", "request_key").agg(
        F.min_by("first", place).alias("first"), *[F.max(c).alias(c) for c in RAW], F.max("has_input").alias("has_input"),
        F.min("tier").alias("tier"), F.min("pace").alias("pace"), F.sum("copies").alias("copies"),
    ).select(*PART)


def distinct_usage(usages: DataFrame) -> DataFrame:
    """Each request once: the largest value of every count over its streamed copies, the
    first known tier and speed, credited to the first copy (oldest file, then line).
    """
    # Usage without a key meets no other, not even its equal, so all records are read and merged in one pass.
    alone = F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string"))
    return merged_usage(merge_usage(usage_parts(usages.withColumn("request_key", F.coalesce("request_key", alone)))))


def merged_usage(parts: DataFrame) -> DataFrame:
    """Requests from their merged parts."""
    key = F.when(~F.col("request_key").startswith("\u0000"), F.col("request_key"))
    return parts.select(
        "host", "first.file", "first.ord", "first.mtime_ms", "first.at", "first.model", key.alias("request_key"), *RAW, "has_input",
        F.col("tier.value").alias("service_tier"), F.col("pace.value").alias("speed"), "copies",
    )


def _sums() -> list[Column]:
    return [F.sum(b).alias(b) for b in BUCKETS]


def piece_suffix(day: Column) -> Column:
    """What a piece of a split session adds to its id: its day and model."""
    return F.concat(F.lit("#"), F.coalesce(day, F.lit("unknown-date")), F.coalesce(F.concat(F.lit("#"), F.col("model")), F.lit("")))


def split_sessions(events: DataFrame) -> DataFrame:
    """Session rows per file: one, or one per day and model when timed usage spans several.

    Usage without a time is a piece of an unknown date in files that are split.
    """
    day = F.date_format("at", DAY)
    cells = events.withColumn("day", day).groupBy(*FILE, "day", "model").agg(
        *_sums(), F.count("*").alias("events"), F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.min("ord").alias("_ord"), F.max("ord").alias("_last")
    )
    timed = F.col("day").isNotNull()
    split = F.count_if(timed).over(Window.partitionBy(*FILE)) > 1
    # A cell of a split file is a group of its own; all cells of another file are one. Files are read in one pass.
    named = cells.withColumn("split", split).withColumn("suffix", F.when(F.col("split"), piece_suffix(F.col("day"))).otherwise(""))
    own = F.when(F.col("split"), F.struct("day", "model"))
    latest = F.max_by("model", F.when(F.col("model").isNotNull(), F.col("_last")))
    return named.groupBy(*FILE, "split", "suffix", own.alias("_cell")).agg(
        F.when(F.col("split"), F.max("model")).otherwise(latest).alias("model"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"),
        F.sum("events").alias("events"), *_sums(),
    ).select(*FILE, "suffix", "model", "started_at", "ended_at", "events", *BUCKETS, "split")


def billed_events(events: DataFrame) -> DataFrame:
    """Distinct usage as priced requests: fast requests need a fast-mode card."""
    return events.withColumn("model", M.fast_mode_model(F.col("model"), F.col("speed"))).withColumns({
        "cache_write_30m": F.lit(0).cast("bigint"), "cache_write_12h": F.lit(0).cast("bigint"), "reasoning_tokens": F.lit(0).cast("bigint"),
        "total_tokens": F.col("input_tokens") + F.col("output_tokens"),
    })


def _signals() -> tuple[str, str, str]:
    """Role, names of the tools called, and whether the result failed, of a record."""
    role = f"coalesce({first_text('rec.message.role')}, {first_text('rec.type')})"
    names = "transform(filter(coalesce(try_cast(rec.message.content AS array<variant>), array()), x -> try_variant_get(x, '$.type', 'string') = 'tool_use'), x -> lower(coalesce(try_variant_get(x, '$.name', 'string'), '')))"
    r = "rec.toolUseResult"
    code = f"coalesce(try_cast({r}.exit_code AS double), try_cast({r}.exitCode AS double), try_cast({r}.status_code AS double), try_cast({r}.statusCode AS double), 0)"
    failed = f"coalesce({r} IS NOT NULL AND ({r}.is_error = 'true' OR {r}.error = 'true' OR {code} <> 0 OR lower({r}.status) IN ('failed', 'error')), false)"
    return role, names, f"coalesce({failed}, {code} <> 0, false)"


def _calls(*wanted: str) -> str:
    listed = ", ".join(f"'{w}'" for w in wanted)
    return f"cast(size(filter(names, n -> n IN ({listed}))) AS bigint)"


def session_facts(records: DataFrame) -> DataFrame:
    """One row per transcript: identity, time bounds, message, tool and failure counts, all from one pass over the records."""
    names = {"id": "sessionId", "cwd": "cwd", "git_branch": "gitBranch", "entrypoint": "entrypoint", "title": "aiTitle"}
    role, called, failed = _signals()
    fields = records.selectExpr(
        *FILE, "ord", *[f"nullif(rec.{key}, '') AS {name}" for name, key in names.items()], "try_cast(rec.timestamp AS timestamp) AS at", "bad",
        "coalesce(rec.message.model = '<synthetic>' AND rec.message.usage IS NOT NULL AND coalesce(try_cast(rec.message.usage.input_tokens AS bigint), 0) "
        "+ coalesce(try_cast(rec.message.usage.output_tokens AS bigint), 0) = 0, false) AS synthetic",
        # Lines that are not JSON, and those of no file, give no signals.
        "NOT bad AND host IS NOT NULL AND file IS NOT NULL AS good", f"{role} AS role", f"{called} AS names", f"{failed} AS failed",
    ).selectExpr(
        "* except (names)", "cast(size(names) AS bigint) AS tools", f"{_calls('bash')} AS shells", f"{_calls('read')} AS reads", f"{_calls('edit', 'multiedit', 'write', 'notebookedit')} AS edits",
    )
    good = F.col("good")

    def of_good(count: Column) -> Column:
        return F.when(F.count_if(good) > 0, count)

    joined = fields.groupBy(*FILE).agg(
        *[F.min_by(n, F.when(F.col(n).isNotNull(), F.col("ord"))).alias(n) for n in names], F.min("at").alias("started_at"), F.max("at").alias("ended_at"),
        F.count_if(~F.col("bad")).alias("raw_event_count"), F.count_if("bad").alias("parse_error_count"), F.count_if("synthetic").alias("synthetic_count"),
        of_good(F.count_if(good & (F.col("role") == "user"))).alias("user_prompt_count"), of_good(F.count_if(good & (F.col("role") == "assistant"))).alias("assistant_message_count"),
        *[F.sum(F.when(good, F.col(n))).alias(name) for n, name in (("tools", "tool_call_count"), ("shells", "shell_command_count"), ("reads", "file_read_count"), ("edits", "file_edit_count"))],
        of_good(F.count_if(good & F.col("failed"))).alias("failed_tool_call_count"),
    ).withColumn("parse_status", R.parse_status(F.col("parse_error_count"), F.col("raw_event_count")))
    return joined.withColumn("message_count", F.col("user_prompt_count") + F.col("assistant_message_count")).withColumn("session_outcome", R.infer_outcome())


def surface(entrypoint: Column) -> Column:
    e = F.lower(F.coalesce(entrypoint, F.lit("")))
    return F.when(e.contains("vscode"), "vscode_extension").when(e.contains("local-agent") | e.contains("desktop"), "local_agent").otherwise("terminal_cli")


def app_label(entrypoint: Column) -> Column:
    e = F.lower(F.coalesce(entrypoint, F.lit("")))
    return (
        F.when(e.contains("vscode"), "VS Code").when(e.contains("local-agent") | e.contains("desktop"), "Claude Desktop App")
        .when((e == "cli") | e.contains("terminal"), "Terminal").otherwise("Claude Code")
    )
