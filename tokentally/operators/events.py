"""Event logs of an editor assistant: activity of each file, and its merge with telemetry into sessions.

Files come as parsed records (schema OTEL) with ``kind`` (otel, debug, transcript or session_state),
``surface`` (cli or vscode), ``fallback_cwd`` and ``mtime_ms``. Only transcripts and session states tell of
activity; any file may hold telemetry. A session is put together from the parts that files hold of it, in
the order of their paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentally.functions import models as M
from tokentally.functions.records import collapse, file_stem, first_text, scaled_instant
from tokentally.operators import otel
from tokentally.operators.rollout import FILE
from tokentally.runtime import by_merge, parsed_once, reliable_checkpoint

# File kinds that tell of activity.
ACTIVITY_KINDS = ("transcript", "session_state")
COUNTS = ["message_count", "user_prompt_count", "assistant_message_count", "tool_call_count", "shell_command_count", "file_edit_count", "file_read_count"]


def _instant(*names: str) -> str:
    return "coalesce(" + ", ".join(f"{scaled_instant(n)}, if(try_cast({n} AS double) IS NULL, try_cast({n} AS timestamp), NULL)" for n in names) + ")"


def _text_of(variant: str) -> str:
    """A VARIANT's text; NULL when it is no text."""
    return f"if(schema_of_variant({variant}) = 'STRING', cast({variant} AS string), NULL)"


def event_rows(records: DataFrame) -> DataFrame:
    """One slim row per line: where it stands, whether it parsed, and for events of a transcript or session state
    time, role, text, session, folder, model, title, tokens and tool use.
    """
    arguments = f"lower(coalesce({_text_of('r.arguments')}, ''))"
    name = "lower(coalesce(r.name, ''))"

    def requests(test: str) -> str:
        return f"coalesce(size(filter(rec.data.toolRequests, r -> {test})), 0)"

    output = "try_cast(rec.data.outputTokens AS double)"
    model = first_text(*[f"trim(rec.{n})" for n in ("data.newModel", "data.currentModel", "data.model", "model")])
    kinds = ", ".join(f"'{k}'" for k in ACTIVITY_KINDS)
    return records.selectExpr(
        *FILE, "ord", "kind", "surface", "fallback_cwd", "bad", f"NOT bad AND kind IN ({kinds}) AS active",
        f"coalesce({_instant('rec.timestamp', 'rec.ts', 'rec.data.startTime')}, if(kind = 'transcript', timestamp_millis(mtime_ms), NULL)) AS at",
        "CASE WHEN startswith(trim(rec.type), 'user.') THEN 'user' WHEN startswith(trim(rec.type), 'assistant.') THEN 'assistant' WHEN trim(rec.data.role) IN ('user', 'assistant') THEN trim(rec.data.role) END AS role",
        f"{first_text('trim(rec.data.sessionId)', 'trim(rec.sessionId)', 'trim(rec.sid)')} AS session",
        f"{first_text('trim(rec.data.cwd)', 'trim(rec.cwd)', 'trim(rec.data.context.cwd)', 'trim(rec.data.context.gitRoot)')} AS cwd",
        f"{model} AS model", f"if(trim(rec.type) = 'session.start', {first_text('trim(rec.data.title)')}, NULL) AS title",
        f"if({output} >= 1, cast({output} AS bigint), 0L) AS output_tokens",
        f"coalesce({_text_of('rec.data.content')}, if(rec.data.content IS NULL, {_text_of('rec.content')}, NULL)) AS text",
        "coalesce(size(rec.data.toolRequests), 0) AS tools",
        f"""{requests(f"contains({name}, 'terminal') OR contains({arguments}, '\"command\"')")} AS shell""",
        f"{requests(f'''contains({name}, 'edit') OR contains({arguments}, 'edit')''')} AS edits",
        f"{requests(f'''contains({name}, 'read') OR contains({arguments}, 'read_file')''')} AS reads",
    )


def activity_rows(events: DataFrame) -> DataFrame:
    """The events that tell of activity."""
    return events.where("active")


def _at(value: str, keep: str, last: bool = False) -> Column:
    """The first or last value, by place in the file, among rows that meet a condition."""
    pick = F.max_by if last else F.min_by
    return pick(value, F.when(F.expr(keep), F.col("ord")))


def file_activity(rows: DataFrame) -> DataFrame:
    """One row per file: the context its events carry forward, and sums over them.

    The session id is the last one told, the folder and title the first, the model the last
    that is not automatic (else automatic, if that is all).
    """
    return rows.groupBy(*FILE).agg(
        _at("session", "session is not null", last=True).alias("told_id"), _at("cwd", "cwd is not null").alias("told_cwd"), _at("title", "title is not null").alias("title"),
        F.coalesce(_at("model", "model <> 'auto'", last=True), F.max(F.when(F.col("model") == "auto", "auto"))).alias("model"),
        F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.count("role").alias("message_count"), F.count_if(F.col("role") == "user").alias("user_prompt_count"),
        F.count_if(F.col("role") == "assistant").alias("assistant_message_count"), F.sum("tools").alias("tool_call_count"), F.sum("shell").alias("shell_command_count"),
        F.sum("edits").alias("file_edit_count"), F.sum("reads").alias("file_read_count"),
    )


def prompt_rows(rows: DataFrame) -> DataFrame:
    """Messages with text, white space collapsed, in file order."""
    return rows.where("role is not null and trim(text) <> ''").select(*FILE, "ord", "role", F.expr(collapse("text")).alias("text"), "at")


def files_of(events: DataFrame) -> DataFrame:
    """One row per file: kind, surface, folder, records, unparsable lines, and its activity."""
    listed = events.groupBy(*FILE).agg(
        F.max("kind").alias("kind"), F.max("surface").alias("surface"), F.max(F.nullif(F.trim("fallback_cwd"), F.lit(""))).alias("fallback_cwd"),
        F.count_if(~F.col("bad")).alias("raw_event_count"), F.count_if("bad").alias("parse_error_count"),
    )
    joined = listed.join(file_activity(activity_rows(events)), FILE, "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in COUNTS})
    return joined.withColumn("id", F.coalesce("told_id", file_stem(F.col("file")))).withColumn("cwd", F.coalesce("fallback_cwd", "told_cwd")).drop("told_id", "told_cwd", "fallback_cwd")


def output_events(events: DataFrame, files: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Token events of activity files without telemetry: output counts alone, so any detailed file of the session replaces them."""
    some = activity_rows(events).where("output_tokens > 0").select(*FILE, "ord", "at", "output_tokens")
    named = some.join(files.select(*FILE, F.col("id").alias("session_id")), FILE).join(telemetry.select(*FILE).distinct(), FILE, "left_anti")
    zero = {c: F.lit(0).cast("bigint") for c in otel.TOKENS if c != "output_tokens"}
    key = F.concat(F.lit("transcript-output:"), "file", F.lit(":"), F.col("ord").cast("string"))
    return named.withColumns({**zero, "dedup_key": key, "detailed": F.lit(False), **{c: F.lit(None).cast(kind) for c, kind in (("model", "string"), ("duration_ms", "bigint"), ("request_input_tokens", "bigint"))}})


EVENT = [*FILE, "ord", "session_id", "dedup_key", "detailed", "at", "model", "duration_ms", "request_input_tokens", *otel.TOKENS]


def all_events(events: DataFrame, files: DataFrame, telemetry: DataFrame) -> DataFrame:
    return telemetry.select(*EVENT).unionByName(output_events(events, files, telemetry).select(*EVENT))


def session_parts(files: DataFrame, telemetry: DataFrame) -> DataFrame:
    """What each file holds of each session: one row per (file, session of its telemetry), or one per file without any.

    Activity goes to every session of the file. A file that holds nothing at all has no part.
    """
    start = F.when(F.col("duration_ms") > 0, F.timestamp_add("MILLISECOND", -F.col("duration_ms"), F.col("at"))).otherwise(F.col("at"))
    groups = telemetry.groupBy(*FILE, "session_id").agg(
        F.count("*").alias("_n"), F.min(start).alias("_from"), F.max("at").alias("_to"), _at("model", "model is not null", last=True).alias("_model")
    )
    joined = files.join(groups, FILE, "left").where("session_id is not null or message_count > 0 or raw_event_count > 0 or parse_error_count > 0")
    n = F.coalesce("_n", F.lit(0))
    return joined.withColumns({
        "session_id": F.coalesce("session_id", "id"), "model": F.coalesce("_model", "model"), "started_at": F.least("started_at", "_from"), "ended_at": F.greatest("ended_at", "_to"),
        "message_count": F.greatest("message_count", n), "assistant_message_count": F.greatest("assistant_message_count", n),
        "parse_status": F.when(F.col("parse_error_count") == 0, "ok").when((F.col("raw_event_count") > 0) | F.col("_n").isNotNull(), "partial").otherwise("failed"),
    }).drop("_n", "_from", "_to", "_model", "id", "kind")


def merged_parts(parts: DataFrame) -> DataFrame:
    """One row per session: the first title, folder, model and surface by path, bounds of time, the largest counts."""
    def first(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("file")))

    return parts.groupBy(*otel.SESSION).agg(
        *[first(c).alias(c) for c in ("title", "cwd", "model", "surface")], F.min("file").alias("source_path"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"),
        *[F.max(c).alias(c) for c in [*COUNTS, "raw_event_count"]], F.sum("parse_error_count").alias("parse_error_count"),
        F.when(F.sum("parse_error_count") == 0, "ok").when(F.count("*") == 1, F.max("parse_status")).otherwise("partial").alias("parse_status"),
    )


def merged_sessions(records: DataFrame, hints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sessions of telemetry and event logs, and their token events after the merge."""
    # Slim rows are kept, so that records are parsed once for telemetry and once for activity.
    rows = reliable_checkpoint(event_rows(records))
    telemetry = reliable_checkpoint(otel.file_events(records).select(*EVENT))
    files = reliable_checkpoint(files_of(rows))
    found = parsed_once(all_events(rows, files, telemetry))
    events = reliable_checkpoint(otel.merge_events(found))
    sums = events.groupBy(*otel.SESSION).agg(*[F.sum(c).alias(c) for c in otel.TOKENS], F.count("*").alias("events")).join(by_merge(otel.session_fragments(found)), otel.SESSION)
    sessions = merged_parts(session_parts(files, telemetry)).join(sums, otel.SESSION, "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in [*otel.TOKENS, "events"]})
    if hints is not None:
        sessions = otel.apply_hints(sessions, hints)
    again = F.when(F.col("fragments") > 1, F.array(F.lit("copilot_duplicate_session_merged"))).otherwise(F.array().cast("array<string>"))
    return sessions.withColumn("warnings", again).drop("fragments"), events


def known_model(column: Column) -> Column:
    return F.when(M.known_copilot_model(column), M.pricing_model_id(column))
