"""Rollout logs: records to requests, timeline, counts and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentally.functions import records as R
from tokentally.functions.records import first_count, first_text, instant, message_text
from tokentally.operators import folds
from tokentally.operators.scans import forward_fill, keep_where, row_places, with_chunk
from tokentally.runtime import by_merge, parsed_once, reliable_checkpoint

FILE = ["host", "file"]
USAGE = ["input_tokens", "cached_input_tokens", "cache_write_tokens", "cache_write_30m", "cache_write_12h", "output_tokens", "reasoning_tokens", "total_tokens"]


def with_usage(df: DataFrame, node: str, name: str) -> DataFrame:
    """Add the token buckets of a usage struct; NULL when there are none.

    Output excludes reasoning. Writes are the larger of the declared count and
    the sum of the lifetime split.
    """
    split = df.selectExpr(
        "*", f"coalesce({node}.input_tokens_details, {node}.inputTokensDetails, {node}.prompt_tokens_details, {node}.promptTokensDetails) AS _in",
        f"coalesce({node}.output_tokens_details, {node}.outputTokensDetails) AS _out",
    ).selectExpr("*", f"coalesce({node}.cache_write_tokens_details, {node}.cacheWriteTokensDetails, _in.cache_write_tokens_details, _in.cacheWriteTokensDetails) AS _ttl")

    def probed(flat: str, part: str, nested: str) -> str:
        return f"coalesce(nullif({first_count(node, *flat.split())}, 0L), {first_count(part, *nested.split())})"

    counts = {
        "i": first_count(node, "input_tokens", "inputTokens", "prompt_tokens", "promptTokens"),
        "c": probed("cached_input_tokens cachedInputTokens cached_tokens cachedTokens cache_read_input_tokens", "_in", "cached_tokens cachedTokens"),
        "o": first_count(node, "output_tokens", "outputTokens", "completion_tokens", "completionTokens"),
        "r": probed("reasoning_tokens reasoningTokens reasoning_output_tokens reasoningOutputTokens", "_out", "reasoning_tokens reasoningTokens"),
        "t": first_count(node, "total_tokens", "totalTokens", "tokens_used", "tokensUsed"),
        "w30": first_count("_ttl", "ttl_30m_tokens", "ttl30mTokens", "ttl_30m"),
        "w12": first_count("_ttl", "ttl_12h_tokens", "ttl12hTokens", "ttl_12h"),
        "w": probed("cache_creation_input_tokens cacheCreationInputTokens cache_write_input_tokens cacheWriteInputTokens cache_write_tokens cacheWriteTokens",
                    "_in", "cache_write_tokens cacheWriteTokens cache_creation_input_tokens cacheCreationInputTokens"),
    }
    raw = split.selectExpr("*", "named_struct(" + ", ".join(f"'{k}', {e}" for k, e in counts.items()) + ") AS _raw")
    buckets = raw.selectExpr("*", "greatest(_raw.o - _raw.r, 0L) AS _visible", "greatest(_raw.w, _raw.w30 + _raw.w12) AS _write")
    values = ["_raw.i", "_raw.c", "_write", "_raw.w30", "_raw.w12", "_visible", "_raw.r", "coalesce(nullif(_raw.t, 0L), _raw.i + _visible + _raw.r)"]
    struct = "named_struct(" + ", ".join(f"'{u}', {e}" for u, e in zip(USAGE, values)) + ")"
    some = f"{node} IS NOT NULL AND _raw.i + _raw.c + _visible + _raw.r + _raw.t + _write <> 0"
    return buckets.selectExpr("* except (_in, _out, _ttl, _raw, _visible, _write)", f"if({some}, {struct}, NULL) AS {name}")


def token_usages(records: DataFrame) -> DataFrame:
    """Records that carry token counts, with kind and, for deltas, the paired snapshot.

    kind is delta (last_token_usage), cumulative (total_token_usage) or direct
    (any other usage object). Needs host, file, ord and rec.
    """
    top = ", ".join(f"'{f.name}', rec.{f.name}" for f in records.schema["rec"].dataType["usage"].dataType.fields)
    nodes = records.selectExpr(
        *FILE, "ord", "rec.payload.info.last_token_usage AS _last", "rec.payload.info.total_token_usage AS _whole",
        "coalesce(rec.usage, rec.token_usage, rec.tokens, rec.response.usage, rec.payload.usage, rec.payload.token_usage, rec.payload.tokens, "
        f"if(rec._corrupt IS NULL, named_struct({top}), NULL)) AS _plain",
    )
    kinds = nodes.selectExpr(
        *FILE, "ord", "CASE WHEN _last IS NOT NULL THEN 'delta' WHEN _whole IS NOT NULL THEN 'cumulative' ELSE 'direct' END AS kind",
        "coalesce(_last, _whole, _plain) AS _node", "if(_last IS NOT NULL, _whole, NULL) AS _paired",
    )
    found = with_usage(with_usage(kinds, "_node", "_u"), "_paired", "_s").drop("_node", "_paired")
    named = keep_where(found, "_u IS NOT NULL")
    return named.select(*FILE, "ord", "kind", "_u.*", *[F.col(f"_s.{u}").alias(f"snap_{n}") for u, n in zip(USAGE, folds.SNAPSHOT)])


def is_valid() -> Column:
    counts = ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_tokens", "total_tokens"]
    out = F.lit(True)
    for name in counts:
        out = out & (F.col(name) >= 0)
    return out


def drop_stale_snapshots(usages: DataFrame, chunk: int = folds.CHUNK) -> DataFrame:
    """Delta and direct records without rebroadcast and stale ones; ``kept`` tells which stay."""
    return folds.fold_rows(usages, FILE, "ord", folds.stale_snapshot_step, chunk)


# A record without a payload is its own payload.
PAYLOAD = "if(rec.payload IS NOT NULL, rec.payload.{0}, rec.{0})"


def in_payload(name: str) -> str:
    return PAYLOAD.format(name)


def declared_model() -> str:
    return first_text(in_payload("model"), in_payload("collaboration_mode.settings.model"))


def active_model(records: DataFrame) -> DataFrame:
    """Records with the model last declared at or before them."""
    return forward_fill(records, FILE, "ord", {"active_model": F.expr(declared_model())})


def token_requests(records: DataFrame) -> DataFrame:
    """Billed requests of each file.

    With any valid cumulative record the file is one request of unknown size
    and no model: the largest total, the later one on a tie. Otherwise every
    kept delta or direct record is a request with the model active then.
    """
    return requests_of(reliable_checkpoint(token_usages(records)), records)


def requests_of(usages: DataFrame, records: DataFrame) -> DataFrame:
    """token_requests over usage rows that are already at hand."""
    usages = usages.where(is_valid())
    files = usages.groupBy(*FILE).agg(F.bool_or(F.col("kind") == "cumulative").alias("_cumulative"))
    # One row per file. Not by_merge: its sort would put usage rows of one ordinal in another order before the fold.
    marked = usages.join(files, FILE)
    best = F.max_by(F.struct("ord", *USAGE), F.struct("total_tokens", "ord"))
    final = marked.where("_cumulative and kind = 'cumulative'").groupBy(*FILE).agg(best.alias("b")).select(
        *FILE, "b.*", F.lit(None).cast("bigint").alias("request_input_tokens"), F.lit(None).cast("string").alias("model"), F.lit("final_snapshot").alias("method")
    )
    kept = drop_stale_snapshots(marked.where("not _cumulative").drop("_cumulative")).where("kept")
    models = active_model(records.select(*FILE, "ord", "rec")).select(*FILE, "ord", F.col("active_model").alias("model"))
    deltas = kept.join(by_merge(models), [*FILE, "ord"], "left").select(
        *FILE, "ord", *USAGE, F.col("input_tokens").alias("request_input_tokens"), "model", F.lit("delta_sum").alias("method")
    )
    return final.unionByName(deltas)


def token_totals(records: DataFrame) -> DataFrame:
    """One row per file: token sums, method, confidence, snapshot count and warnings."""
    usages = reliable_checkpoint(token_usages(records))
    counts = usages.groupBy(*FILE).agg(
        F.count("*").alias("token_snapshot_count"), F.count_if(~is_valid()).alias("_invalid"),
        F.count_if(is_valid() & (F.col("kind") != "cumulative")).alias("_direct"), F.count_if(F.col("kind") != "cumulative").alias("_all_direct"),
    )
    requests = requests_of(usages, records)
    sums = requests.groupBy(*FILE).agg(F.min("method").alias("_method"), F.count("*").alias("_n"), *[F.sum(u).alias(u) for u in USAGE])
    method = F.coalesce("_method", F.lit("unknown"))
    warnings = F.array_compact(F.array(
        F.when(F.col("_invalid") > 0, F.concat(F.lit("invalid_token_snapshots:"), F.col("_invalid").cast("string"))),
        F.when((method == "final_snapshot") & (F.col("_all_direct") > 0), "token_direct_usage_ignored_after_cumulative_snapshot"),
        F.when((method == "delta_sum") & (F.col("_direct") > F.col("_n")), "duplicate_or_stale_token_snapshots_skipped"),
    ))
    return counts.join(by_merge(sums), FILE, "left").select(
        *FILE, *[F.coalesce(u, F.lit(0)).alias(u) for u in USAGE], method.alias("token_aggregation_method"),
        F.when(method == "unknown", "low").otherwise("high").alias("token_confidence"), "token_snapshot_count", warnings.alias("warnings"),
    )


# ---------------------------------------------------------------- messages

def messages(records: DataFrame) -> DataFrame:
    """User and assistant messages: role, text with collapsed white space, time."""
    kind, who = in_payload("type"), in_payload("role")
    role = f"CASE WHEN {kind} = 'user_message' OR {who} = 'user' THEN 'user' WHEN {kind} = 'agent_message' OR {who} = 'assistant' THEN 'assistant' END"
    text = f"coalesce({message_text('rec.payload')}, {message_text('rec')})"
    rows = records.selectExpr(
        *FILE, "ord", f"{role} AS role", f"{R.collapse(text)} AS text",
        f"{instant('rec.payload.timestamp', 'rec.timestamp', 'rec.payload.created_at', 'rec.created_at')} AS at",
    )
    return keep_where(rows, f"role IS NOT NULL AND text <> '' AND NOT {R.is_startup_context('text')}")


def distinct_messages(found: DataFrame, chunk: int = folds.CHUNK) -> DataFrame:
    """Messages without near duplicates of the same role and whole text in one file.

    Copies at the same instant are reduced to the first before the ordered fold.
    """
    keyed = found.withColumn("at_ms", F.unix_millis("at"))
    first = keyed.groupBy(*FILE, "role", "text", "at_ms").agg(F.min("ord").alias("ord"), F.min("at").alias("at"))
    key = [*FILE, "role", "text"]
    cut_rows = with_chunk(parsed_once(first), "ord", chunk)
    later = Window.partitionBy(*key).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    mins = cut_rows.groupBy(*key, "_chunk").agg(F.min("at_ms").alias("_min")).select(*key, "_chunk", F.min("_min").over(later).alias("later_min"))
    rows = cut_rows.join(mins, [*key, "_chunk"]).drop("_chunk")
    kept = folds.fold_rows(rows, key, "ord", folds.near_duplicate_step, chunk, folds.near_duplicate_close)
    return kept.where("kept").select(*FILE, "ord", "role", "text", "at")


def timeline_of(found: DataFrame, limit: int | None = 80, shown: int | None = 1000) -> DataFrame:
    """The messages of each file with their place, from 1; the report displays the first ``limit`` of them, ``shown`` characters each (None: all)."""
    items = row_places(distinct_messages(found), FILE, "ord", "place", ("role", "text"))
    cut = items if shown is None else items.withColumn("text", F.substring("text", 1, shown))
    return cut if limit is None else cut.where(F.col("place") <= limit)


def prompt_timeline(records: DataFrame, limit: int | None = 80, shown: int | None = 1000) -> DataFrame:
    return timeline_of(messages(records), limit, shown)


def message_counts(records: DataFrame) -> DataFrame:
    """Messages per file: logged ones, and prompts and replies without near duplicates."""
    logged = records.selectExpr(*FILE, "rec.type AS t", "rec.payload.type AS pt", "rec.payload.role AS r").groupBy(*FILE).agg(
        F.count_if((F.col("t") == "event_msg") & F.col("pt").isin("user_message", "agent_message")).alias("_events"),
        F.count_if((F.col("t") == "response_item") & (F.col("pt") == "message") & F.col("r").isin("user", "assistant")).alias("_responses"),
    )
    said = distinct_messages(messages(records)).groupBy(*FILE).agg(
        F.count_if(F.col("role") == "user").alias("user_prompt_count"), F.count_if(F.col("role") == "assistant").alias("assistant_message_count")
    )
    return logged.join(said, FILE, "left").select(
        *FILE, F.when(F.col("_events") > 0, F.col("_events")).otherwise(F.col("_responses")).alias("message_count"),
        F.coalesce("user_prompt_count", F.lit(0)).alias("user_prompt_count"), F.coalesce("assistant_message_count", F.lit(0)).alias("assistant_message_count"),
    )


# ---------------------------------------------------------------- compaction

def compactions(records: DataFrame) -> DataFrame:
    """Compaction events with their trigger: manual after a /compact message, else auto."""
    kind, who = in_payload("type"), in_payload("role")
    is_user = f"({kind} = 'user_message' OR (rec.type = 'response_item' AND {kind} = 'message' AND {who} = 'user'))"
    rows = records.selectExpr(
        *FILE, "ord", f"{instant('rec.timestamp', 'rec.payload.timestamp')} AS at",
        "coalesce(rec.type = 'event_msg' AND rec.payload.type = 'context_compacted', false) AS compacted",
        f"if({is_user}, coalesce({message_text('rec.payload')}, {message_text('rec')}), NULL) AS user_text",
    )
    rows = keep_where(rows, "user_text IS NOT NULL OR compacted")
    filled = forward_fill(rows, FILE, "ord", {"last_user_text": F.col("user_text")}).where("compacted")
    manual = F.coalesce(F.col("last_user_text").rlike(r"^\s*/compact\b"), F.lit(False))
    return filled.select(*FILE, "ord", "at", "last_user_text", F.when(manual, "manual").otherwise("auto").alias("trigger"))


def compaction_stats(records: DataFrame) -> DataFrame:
    return compactions(records).groupBy(*FILE).agg(
        F.count("*").alias("count"), F.count_if(F.col("trigger") == "auto").alias("auto_count"), F.count_if(F.col("trigger") == "manual").alias("manual_count"),
        F.min("at").alias("first_at"), F.max("at").alias("last_at"),
    )


# ---------------------------------------------------------------- session fields

IDENTITY = {
    "id": "id", "cwd": "cwd", "title": "title", "model": None, "provider": "model_provider", "source": "source",
    "originator": "originator", "thread_source": "thread_source",
}


def session_fold(records: DataFrame) -> DataFrame:
    """One row per file: first known identity fields, time bounds, record and error counts."""
    fields = [f"{declared_model() if key is None else first_text(in_payload(key))} AS {name}" for name, key in IDENTITY.items()]
    at = instant("rec.timestamp", "rec.payload.timestamp")
    start = f"if(rec.type = 'session_meta', coalesce({instant('rec.payload.timestamp')}, {at}), {at})"
    rows = records.selectExpr(*FILE, "ord", *fields, f"{start} AS _start", f"{at} AS _at", "NOT bad AS _ok")
    firsts = [F.min_by(name, F.when(F.col(name).isNotNull(), F.col("ord"))).alias(name) for name in IDENTITY]
    folded = rows.groupBy(*FILE).agg(
        *firsts, F.min("_start").alias("started_at"), F.max("_at").alias("ended_at"), F.count_if("_ok").alias("raw_event_count"), F.count_if(~F.col("_ok")).alias("parse_error_count")
    )
    return folded.withColumn("parse_status", R.parse_status(F.col("parse_error_count"), F.col("raw_event_count")))


def source_raw(thread_source: Column, source: Column, originator: Column, row_source: Column | None = None) -> Column:
    """What the log says started the session."""
    desktop = F.lower(originator).rlike(r"codex\s+desktop")
    return F.when(desktop, originator).otherwise(F.coalesce(*([row_source] if row_source is not None else []), source, originator, thread_source))


def app_label(source: Column, thread_source: Column) -> Column:
    words = F.transform(
        F.filter(F.split(F.regexp_replace(source, r"^codex[_-]", ""), "[_-]"), lambda w: w != ""),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))),
    )
    return (
        F.when(F.coalesce(thread_source == "subagent", F.lit(False)), "Codex subagent")
        .when(source.isNull(), "Codex")
        .when(F.lower(source).rlike(r"codex\s+desktop"), "Codex Desktop")
        .when(source.isin("vscode", "codex_vscode", "codex-vscode"), "VS Code")
        .when(source.isin("cli", "terminal", "codex-tui"), "Terminal")
        .when(source.isin("codex_app", "codex-app"), "Codex app")
        .when(F.trim(source).startswith("{"), "Codex")
        .otherwise(F.array_join(words, " "))
    )


def detect_surface(source: Column, thread_source: Column) -> Column:
    """STRUCT<surface, confidence, reason>."""
    raw = F.lower(F.concat_ws(" ", source, thread_source))

    def found(surface: str, confidence: str, reason: str) -> Column:
        return F.struct(F.lit(surface).alias("surface"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))

    return (
        F.when(F.coalesce(thread_source == "subagent", F.lit(False)), found("codex_exec", "medium", "thread_source is subagent"))
        .when(raw.contains("codex desktop"), found("local_agent", "high", "originator metadata identifies Codex Desktop"))
        .when(raw.contains("vscode"), found("vscode_extension", "high", "source metadata includes vscode"))
        .when(raw.rlike("cli|terminal|tui"), found("terminal_cli", "high", "source metadata indicates CLI/terminal"))
        .when(raw.contains("exec"), found("codex_exec", "medium", "source metadata includes exec"))
        .when(raw.rlike("codex_app|codex-app"), found("codex_app_cloud", "low", "source metadata references codex app; local logs may be incomplete"))
        .otherwise(found("unknown", "low", "no recognized local surface metadata"))
    )


# ---------------------------------------------------------------- threads

def parent_thread(source: Column) -> Column:
    doc = F.try_parse_json(F.when(F.trim(source).startswith("{"), source))
    return F.try_variant_get(doc, "$.subagent.thread_spawn.parent_thread_id", "string")


def attribute_subagents(sessions: DataFrame) -> DataFrame:
    """Subagent sessions take the app of their parent, one level up.

    Needs host, id, source_app, surface_reason and parent_id.
    """
    parents = sessions.where("source_app <> 'Codex subagent'").select(
        F.col("host").alias("_h"), F.col("id").alias("_p"), F.struct("source_app", "surface_reason").alias("_s")
    ).groupBy("_h", "_p").agg(F.min("_s").alias("_s")).select("_h", "_p", F.col("_s.source_app").alias("_app"), F.col("_s.surface_reason").alias("_why"))
    is_child = F.col("source_app") == "Codex subagent"
    joined = sessions.join(parents, is_child & (F.col("parent_id") == F.col("_p")) & F.col("host").eqNullSafe(F.col("_h")), "left")
    reason = F.concat(F.lit("subagent attributed to parent thread "), F.col("_p"), F.lit(": "), F.col("_why"))
    return joined.withColumn("source_app", F.coalesce("_app", "source_app")).withColumn(
        "surface_reason", F.when(F.col("_p").isNotNull(), reason).otherwise(F.col("surface_reason"))
    ).drop("_h", "_p", "_app", "_why")


def thread_files(threads: DataFrame, files: DataFrame) -> DataFrame:
    """Log file of each thread: its own path, the file of the same id, else the first
    file whose id contains, or is contained in, the thread's.

    The longer id is cut into its runs of every length that a shorter id has, and
    a run meets the shorter id by equality, so only true matches meet. Threads are
    rows of (host, id, rollout_path), files of (host, id, path).
    """
    exact = files.select("host", F.col("id"), F.col("path").alias("_exact"))
    named = threads.join(exact, ["host", "id"], "left")
    done = named.where("rollout_path is not null or _exact is not null").select("host", "id", F.coalesce("rollout_path", "_exact").alias("path"))
    left = named.where("rollout_path is null and _exact is null and id is not null").select("host", "id")
    candidates = files.where("id <> ''").select("host", F.col("id").alias("_fid"), "path")

    def runs(df: DataFrame, column: str, shorter: DataFrame, name: str) -> DataFrame:
        # Lengths of ids: no more than the longest id has characters.
        sizes = shorter.select(F.length(name).alias("n")).distinct().agg(F.collect_set("n")).scalar()
        text = F.col(column)
        cut = F.transform(
            F.filter("_sizes", lambda n: (n > 0) & (n <= F.length(text))),
            lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n)),
        )
        return df.withColumn("_sizes", sizes).withColumn(name, F.explode(F.array_distinct(F.flatten(cut)))).drop("_sizes")

    in_thread = runs(left, "id", candidates, "_fid").join(candidates, ["host", "_fid"])
    in_file = runs(candidates, "_fid", left, "id").join(left, ["host", "id"])
    loose = in_thread.select("host", "id", "path").unionByName(in_file.select("host", "id", "path")).groupBy("host", "id").agg(F.min("path").alias("path"))
    return done.unionByName(loose)


def standalone_files(files: DataFrame, imported: DataFrame) -> DataFrame:
    """Files (host, id, path) not yet imported by id or by path (host, id, source_path)."""
    by_id = files.join(imported.select("host", "id").distinct(), ["host", "id"], "left_anti")
    paths = imported.select("host", R.comparable_path(F.col("source_path")).alias("_path")).where("_path <> ''").distinct()
    return by_id.withColumn("_path", R.comparable_path(F.col("path"))).join(paths, ["host", "_path"], "left_anti").drop("_path")


def import_votes(records: DataFrame) -> DataFrame:
    """Most frequent assistant model of each imported transcript (host, file, rec as TRANSCRIPT); the first by name on ties."""
    kind, model = first_text("trim(rec.type)", "trim(rec.payload.type)"), first_text("trim(rec.message.model)", "trim(rec.payload.message.model)", "trim(rec.model)")
    rows = records.where("NOT bad").selectExpr(*FILE, f"{kind} AS t", f"{model} AS model")
    counts = keep_where(rows, "model <> '<synthetic>' AND (t IS NULL OR t = 'assistant')").groupBy(*FILE, "model").agg(F.count("*").alias("n"))
    return counts.groupBy(*FILE).agg(F.min_by("model", F.struct(-F.col("n"), F.col("model"))).alias("model"))


def import_entries(documents: DataFrame) -> DataFrame:
    """(host, id, source_path, place) of the entries of import index documents (host, file, body), in their order.

    Entries without an id or a path are passed over; a document that does not parse has none (see ``import_index_errors``).
    """
    listed = "try_cast(variant_get(doc, '$.records', 'variant') AS array<variant>)"
    parsed = documents.select("host", "file", F.try_parse_json("body").alias("doc")).where("doc is not null")
    entries = parsed.selectExpr("host", "file", f"posexplode({listed}) AS (place, entry)").selectExpr(
        "host", "file", "place", "nullif(trim(try_variant_get(entry, '$.imported_thread_id', 'string')), '') AS id", "nullif(trim(try_variant_get(entry, '$.source_path', 'string')), '') AS source_path"
    )
    return entries.where("id is not null and source_path is not null").select("host", "id", "source_path", F.struct("file", "place").alias("place"))


def import_index_errors(documents: DataFrame) -> DataFrame:
    """One row per index document that is not JSON."""
    return documents.where(F.try_parse_json("body").isNull()).select("host", "file", F.lit("unreadable_import_index").alias("error"))


def imported_models(entries: DataFrame, records: DataFrame) -> DataFrame:
    """(host, id, imported_model): the voted model of the last entry of each id whose transcript is there and names one."""
    votes = import_votes(records).withColumn("_path", R.comparable_path(F.col("file")))
    named = entries.withColumn("_path", R.comparable_path(F.col("source_path"))).join(votes.select("host", "_path", F.col("model").alias("imported_model")), ["host", "_path"])
    return named.groupBy("host", "id").agg(F.max_by("imported_model", "place").alias("imported_model"))


def fill_imported_models(sessions: DataFrame, votes: DataFrame) -> DataFrame:
    """Sessions without a model take the voted one (host, id, imported_model), with a warning."""
    joined = sessions.join(votes.select("host", "id", "imported_model"), ["host", "id"], "left")
    inferred = F.col("model").isNull() & F.col("imported_model").isNotNull()
    marked = F.when(inferred, F.array_append("warnings", F.lit("model_inferred_from_import_source"))).otherwise(F.col("warnings"))
    return joined.withColumn("warnings", marked).withColumn("model", F.coalesce("model", "imported_model")).drop("imported_model")
