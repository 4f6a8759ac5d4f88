"""Telemetry and chat logs: usage records, trace context, priorities, fragments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentally.functions import models as M
from tokentally.functions.records import first_text, pair_instant, scaled_instant
from tokentally.operators.rollout import FILE
from tokentally.runtime import by_merge, parsed_once

# Usage sources, strongest first, and session attributes with their priority.
SOURCES = ["chat_span", "inference_log", "agent_turn_log", "agent_summary_span"]
SESSION_ATTRIBUTES = [
    ("gen_ai.conversation.id", 3), ("copilot_chat.session_id", 3), ("copilot_chat.chat_session_id", 3), ("session.id", 3),
    ("github.copilot.interaction_id", 2), ("gen_ai.response.id", 1),
]
TOKENS = ["input_tokens", "cached_input_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens"]


def attribute(name: str) -> str:
    return f"nullif(trim(rec.attributes['{name}']), '')"


def _count(*names: str) -> str:
    """First positive whole number among the attributes, else 0."""
    parts = [f"if(try_cast(rec.attributes['{n}'] AS double) >= 1, cast(try_cast(rec.attributes['{n}'] AS double) AS bigint), NULL)" for n in names]
    return f"coalesce({', '.join(parts)}, 0L)"


def source_sql() -> str:
    op, event = attribute("gen_ai.operation.name"), attribute("event.name")
    body = first_text("trim(rec.body)", "trim(rec._body)")
    span = (
        "if(trim(rec.type) <> '', rec.type = 'span', coalesce(rec.name <> '', false) AND coalesce(nullif(rec.spanId, ''), nullif(rec.traceId, ''), cast(rec.startTime AS string), "
        "cast(rec.endTime AS string), rec.duration, rec.kind) IS NOT NULL)"
    )
    return f"""CASE WHEN {span} AND ({op} = 'chat' OR startswith(rec.name, 'chat ')) THEN 'chat_span'
      WHEN NOT {span} AND ({event} = 'gen_ai.client.inference.operation.details' OR startswith({body}, 'GenAI inference:')) THEN 'inference_log'
      WHEN NOT {span} AND ({event} = 'copilot_chat.agent.turn' OR startswith({body}, 'copilot_chat.agent.turn')) THEN 'agent_turn_log'
      WHEN {span} AND ({op} = 'invoke_agent' OR startswith(rec.name, 'invoke_agent ')) THEN 'agent_summary_span' END"""


def attributed(records: DataFrame) -> DataFrame:
    """Records with attributes: source, ids, token counts, time and duration."""
    pairs = [f"if({attribute(n)} IS NOT NULL, named_struct('p', {-p}, 'i', {i}, 'v', {attribute(n)}), NULL)" for i, (n, p) in enumerate(SESSION_ATTRIBUTES)]
    instants = [pair_instant(f"rec.{n}") for n in ("endTime", "startTime", "hrTime", "_hrTime")] + [scaled_instant("rec.timestamp"), scaled_instant("rec.observedTimestamp")]
    nanos = "if(try_cast(rec.timeUnixNano AS double) > 0, timestamp_millis(cast(floor(try_cast(rec.timeUnixNano AS double) / 1e6) AS bigint)), NULL)"
    rows = records.where("NOT bad AND rec.attributes IS NOT NULL").selectExpr(
        *FILE, "ord", f"{source_sql()} AS source", f"{first_text('trim(rec.traceId)', 'trim(rec.spanContext.traceId)')} AS trace_id",
        f"{first_text('trim(rec.spanId)', 'trim(rec.spanContext.spanId)')} AS span_id", f"{attribute('gen_ai.response.id')} AS response_id",
        f"coalesce({attribute('gen_ai.response.model')}, {attribute('gen_ai.request.model')}) AS own_model",
        f"array_min(array_compact(array({', '.join(pairs)}))) AS own_session", f"coalesce({', '.join(instants)}, {nanos}) AS at",
        f"{pair_instant('rec.startTime')} AS _from", f"{pair_instant('rec.endTime')} AS _to", "try_cast(rec.duration AS double) AS _duration",
        f"coalesce({attribute('turn.index')}, {attribute('copilot_chat.turn.index')}) AS turn",
        f"{_count('gen_ai.usage.input_tokens')} AS input_tokens", f"{_count('gen_ai.usage.cache_read.input_tokens')} AS cached_input_tokens",
        f"{_count('gen_ai.usage.cache_write.input_tokens', 'gen_ai.usage.cache_creation.input_tokens')} AS cache_write_tokens",
        f"{_count('gen_ai.usage.output_tokens')} AS _output", f"{_count('gen_ai.usage.reasoning.output_tokens', 'gen_ai.usage.reasoning_tokens')} AS reasoning_tokens",
        f"{_count('gen_ai.usage.total_tokens', 'gen_ai.usage.total.token_count')} AS _total", "rec.attributes['gen_ai.usage.input_tokens'] IS NOT NULL AS _sized",
    )
    inferred = "if(_total > 0 AND _total >= input_tokens + reasoning_tokens, _total - input_tokens - reasoning_tokens, 0L)"
    length = "if(_to > _from, unix_millis(_to) - unix_millis(_from), if(_duration > 0, cast(if(_duration >= 1e6, _duration / 1e6, _duration) AS bigint), NULL))"
    return rows.selectExpr(
        "* except (_output, _total, _sized, _from, _to, _duration)", f"if(_output > 0, _output, {inferred}) AS output_tokens", f"{length} AS duration_ms",
        "if(_sized AND input_tokens >= cached_input_tokens + cache_write_tokens, input_tokens, NULL) AS request_input_tokens",
    )


def trace_contexts(rows: DataFrame) -> DataFrame:
    """(file, trace): the first model, and the session of the best attribute, first on ties."""
    known = F.col("own_session").isNotNull()
    return rows.where("trace_id is not null").groupBy(*FILE, "trace_id").agg(
        F.min_by("own_model", F.when(F.col("own_model").isNotNull(), F.col("ord"))).alias("trace_model"),
        F.min_by("own_session.v", F.when(known, F.struct("own_session.p", "ord"))).alias("trace_session"),
    )


# Rows of a trace stand together from the context to the priorities: one shuffle serves both. A row without a trace is alone.
TRACE = [*FILE, "trace_id", "_alone"]


def _all_known(*names: str) -> Column:
    """Whether no part of a key is missing; rows without the whole key share it with none."""
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])


def _first_in_trace(value: str, *order: str) -> Column:
    """The first value among rows of the trace that have one, as in ``trace_contexts``; the one read first on ties."""
    told = F.when(F.col(value).isNotNull() & F.col("ord").isNotNull(), F.struct(*order, "ord", "_place"))
    return F.when(_all_known(*FILE, "trace_id"), F.min_by(value, told).over(Window.partitionBy(*TRACE)))


def candidates(records: DataFrame) -> DataFrame:
    """Usage records with session, model and dedup key; the trace fills what a record lacks.

    Records are parsed in one pass and shuffled once, by trace, with the columns that a caller reads and no others;
    records that neither count nor tell a trace of anything stay behind. ``_place`` is where a record was read, which
    tells records of one ordinal apart.
    """
    usage = "source IS NOT NULL AND input_tokens + output_tokens + cached_input_tokens + cache_write_tokens + reasoning_tokens > 0"
    rows = attributed(records).selectExpr("*", "monotonically_increasing_id() AS _place", f"{usage} AS _usage")
    rows = rows.where("_usage OR (trace_id IS NOT NULL AND (own_model IS NOT NULL OR own_session IS NOT NULL))").selectExpr(
        "* except (own_session)", "if(trace_id IS NULL, _place, NULL) AS _alone", "own_session.v AS _session", "own_session.p AS _priority"
    )
    # Shuffled as they are: what the trace orders its rows by would else be shuffled beside them.
    told = rows.repartition(*TRACE).withColumns({"trace_model": _first_in_trace("own_model"), "trace_session": _first_in_trace("_session", "_priority")})
    named = told.where("_usage").selectExpr(
        "* except (trace_model, trace_session, own_model, _session, _priority, _usage)", "coalesce(_session, trace_session, trace_id, 'unknown-session') AS session_id", "coalesce(own_model, trace_model) AS model"
    )
    iso = "coalesce(date_format(at, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\"), 'unknown')"
    key = f"""CASE WHEN source IN ('chat_span', 'agent_summary_span') AND trace_id IS NOT NULL AND span_id IS NOT NULL THEN concat(trace_id, ':', span_id)
      WHEN source = 'inference_log' AND trace_id IS NOT NULL AND span_id IS NOT NULL THEN concat('log:', trace_id, ':', span_id)
      WHEN source = 'agent_turn_log' AND trace_id IS NOT NULL THEN concat('agent-turn:', trace_id, ':', coalesce(turn, concat('idx-', ord)))
      WHEN source = 'agent_turn_log' THEN concat('agent-turn:', session_id, ':', coalesce(turn, concat('idx-', ord)), ':', ord)
      ELSE concat(source, ':', session_id, ':', {iso}, ':', ord) END"""
    return named.selectExpr("* except (turn)", f"{key} AS dedup_key")


def _rank() -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))


def suppress_weaker(rows: DataFrame) -> DataFrame:
    """Drop a candidate when a stronger source of the file shares its trace or response.

    Candidates lie by trace already. Only those with a response are shuffled again, by response; the others are told apart
    by that column alone, as a test of file or trace would be worked out below the shuffle, which both parts read.
    """
    def best(*key: str) -> Column:
        return F.coalesce(F.when(_all_known(*FILE, key[0]), F.min("_rank").over(Window.partitionBy(*FILE, *key))), "_rank")

    ranked = rows.withColumn("_rank", _rank()).withColumn("_best", best("trace_id", "_alone"))
    met = ranked.where("response_id IS NOT NULL").withColumn("_best", F.least("_best", best("response_id")))
    return ranked.where("response_id IS NULL").unionByName(met).where("_rank <= _best").select(rows.columns)


def first_occurrences(rows: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key. Each task sends on the first of its rows alone, and of those only the columns that are read."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def file_events(records: DataFrame) -> DataFrame:
    """Token events of each file: stronger sources only, each dedup key once; of records of one ordinal, the last read."""
    kept = first_occurrences(suppress_weaker(candidates(records)), [*FILE, "dedup_key"], ["ord", F.desc("_place")]).drop("_place", "_alone")
    sized = F.when(F.col("source").isin("chat_span", "inference_log"), F.col("request_input_tokens"))
    detailed = (F.col("input_tokens") > 0) | (F.col("cached_input_tokens") > 0) | (F.col("cache_write_tokens") > 0) | (F.col("reasoning_tokens") > 0)
    return kept.withColumn("request_input_tokens", sized).withColumn("detailed", detailed)


SESSION = ["host", "session_id"]


def fragment_flags(events: DataFrame) -> DataFrame:
    """(host, session, file): whether its events stay, and how many files the session has.

    When any file of a session has detailed counts, only such files stay.
    """
    files = events.where(_all_known(*SESSION)).groupBy(*SESSION, "file").agg(F.bool_or("detailed").alias("_file"))
    whole = Window.partitionBy(*SESSION)
    return files.select(*SESSION, "file", (F.col("_file") | ~F.bool_or("_file").over(whole)).alias("_keep"), F.count("*").over(whole).alias("fragments"))


def session_fragments(events: DataFrame) -> DataFrame:
    """(host, session): how many files it has, before any is left out."""
    return fragment_flags(events).groupBy(*SESSION).agg(F.max("fragments").alias("fragments"))


def merge_events(events: DataFrame) -> DataFrame:
    """Events of each session over all files, each dedup key once, from the first file by path.

    A detailed event is of a detailed file, which stays; so only events without details are matched with their file.
    """
    placed, detailed = events.where(_all_known(*SESSION, "file")), F.coalesce("detailed", F.lit(False))
    stay = by_merge(fragment_flags(events).where("_keep").select(*SESSION, "file"))
    kept = placed.where(detailed).unionByName(placed.where(~detailed).join(stay, [*SESSION, "file"], "left_semi"))
    return first_occurrences(kept, [*SESSION, "dedup_key"], ["file", "ord"])


# Columns of an event that its session is merged from.
MERGED = [*FILE, "ord", "session_id", "dedup_key", "detailed", "at", "model", "duration_ms", *TOKENS]


def merged_sessions(events: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """One row per session: tokens, bounds, event count and the merge warning.

    Events are read several times: a caller that has stored them passes them with what ``merge_events`` made of them, else they are stored here.
    """
    if merged is None:
        events = parsed_once(events.select(*MERGED))
        merged = merge_events(events)
    start = F.when(F.col("duration_ms") > 0, F.timestamp_add("MILLISECOND", -F.col("duration_ms"), F.col("at"))).otherwise(F.col("at"))
    sums = merged.groupBy(*SESSION).agg(
        *[F.sum(c).alias(c) for c in TOKENS], F.count("*").alias("events"), F.min(start).alias("started_at"), F.max("at").alias("ended_at"),
        F.max_by("model", F.when(F.col("model").isNotNull(), F.struct("file", "ord"))).alias("model"), F.min("file").alias("source_path"),
    )
    counted = sums.join(by_merge(session_fragments(events)), SESSION)
    warning = F.when(F.col("fragments") > 1, F.array(F.lit("copilot_duplicate_session_merged"))).otherwise(F.array().cast("array<string>"))
    return counted.withColumn("warnings", warning)


# ---------------------------------------------------------------- chat model hints

def chat_model_hints(records: DataFrame) -> DataFrame:
    """(host, session_id, hint) of chat session files: the last model that was picked or resolved."""
    body = "coalesce(rec.v.{0}, rec.data.{0}, rec.{0})"

    def at(name: str) -> str:
        return body.format(name)

    picked = [at(f"inputState.selectedModel.{n}") for n in ("metadata.version", "metadata.family", "id", "identifier")]
    picked += [at(f"selectedModel.{n}") for n in ("metadata.version", "metadata.family", "id", "identifier")]
    resolved = [at("metadata.resolvedModel"), at("response.metadata.resolvedModel")]
    rows = records.where("NOT bad").select(
        *FILE, "ord", M.chat_model_candidate(*[F.expr(e) for e in picked + resolved]).alias("model"), F.expr(first_text(at("sessionId"), at("metadata.sessionId"))).alias("session_id")
    )
    last = rows.groupBy(*FILE).agg(
        F.max_by("model", F.when(F.col("model").isNotNull(), F.col("ord"))).alias("hint"), F.max_by("session_id", F.when(F.col("session_id").isNotNull(), F.col("ord"))).alias("session_id"),
    )
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), r"(?i)\.jsonl$", "")
    named = last.where("hint is not null").select("host", F.coalesce("session_id", stem).alias("session_id"), "hint", "file")
    return named.groupBy("host", "session_id").agg(F.max_by("hint", "file").alias("hint"))


def apply_hints(sessions: DataFrame, hints: DataFrame) -> DataFrame:
    """Sessions whose model is missing or automatic take the hint."""
    joined = sessions.join(hints, ["host", "session_id"], "left")
    model = F.when(M.known_copilot_model(F.col("model")), F.col("model")).otherwise(F.coalesce("hint", "model"))
    return joined.withColumn("model", model).drop("hint")
