"""Fields of log records, parsed into the structs of ``sources.schemas``.

Helpers that return text build Spark SQL for ``selectExpr``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds from start to end; NULL when either is missing or end is earlier."""
    return F.when(end >= start, F.unix_millis(end) - F.unix_millis(start))


def first_text(*names: str) -> str:
    """First non-empty text."""
    return "coalesce(" + ", ".join(f"nullif({n}, '')" for n in names) + ")"


def first_count(holder: str, *names: str) -> str:
    """First number among the spellings, 0 without one."""
    return "coalesce(" + ", ".join(f"try_cast({holder}.{n} AS bigint)" for n in names) + ", 0L)"


def instant(*names: str) -> str:
    """First instant: ISO text, or a number of seconds, or of milliseconds above 10^10."""
    parts = []
    for n in names:
        number = f"try_cast({n} AS double)"
        parts += [f"timestamp_millis(cast(if({number} > 1e10, {number}, {number} * 1000) AS bigint))", f"try_cast({n} AS timestamp)"]
    return "coalesce(" + ", ".join(parts) + ")"


def scaled_instant(name: str) -> str:
    """An instant as seconds, milli-, micro- or nanoseconds, told apart by size."""
    raw = f"try_cast({name} AS double)"
    millis = f"CASE WHEN {raw} >= 1e17 THEN {raw} / 1e6 WHEN {raw} >= 1e14 THEN {raw} / 1e3 WHEN {raw} >= 1e11 THEN {raw} ELSE {raw} * 1e3 END"
    return f"if({raw} > 0, timestamp_millis(cast({millis} AS bigint)), NULL)"


def pair_instant(name: str) -> str:
    """An instant as [seconds, nanoseconds] in a VARIANT."""
    seconds, nanos = f"try_variant_get({name}, '$[0]', 'bigint')", f"try_variant_get({name}, '$[1]', 'bigint')"
    return f"if({seconds} > 0, timestamp_millis({seconds} * 1000 + coalesce({nanos}, 0L) div 1000000), NULL)"


def message_part(name: str) -> str:
    """Text of a VARIANT that is text, or a list of texts and of objects with text or content."""
    def text(v: str) -> str:
        return f"if(schema_of_variant({v}) = 'STRING', nullif(cast({v} AS string), ''), NULL)"

    inner = [text(f"try_variant_get(x, '$.{k}', 'variant')") for k in ("text", "content")]
    parts = f"filter(transform(try_cast({name} AS array<variant>), x -> coalesce({text('x')}, {', '.join(inner)})), t -> trim(t) <> '')"
    return f"coalesce(if(trim({text(name)}) <> '', {text(name)}, NULL), nullif(array_join({parts}, '\\n'), ''))"


def message_text(holder: str) -> str:
    """Message text under text, message, content or input."""
    return "coalesce(" + ", ".join(message_part(f"{holder}.{k}") for k in ("text", "message", "content", "input")) + ")"


def collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\\\s+', ' '))"


def is_startup_context(text: str) -> str:
    """Injected environment or instruction messages of a rollout log."""
    return f"(contains({text}, '<environment_context>') AND (contains({text}, '# AGENTS.md instructions') OR contains({text}, '<INSTRUCTIONS>')))"


def infer_outcome() -> Column:
    """Session outcome from parse status, failures, edits, commands and messages."""
    def some(name: str) -> Column:
        return F.coalesce(name, F.lit(0)) > 0

    return (
        F.when(F.col("parse_status") == "failed", "failed")
        .when(some("failed_tool_call_count"), "partial")
        .when(some("file_edit_count"), "completed")
        .when(some("shell_command_count"), "setup_debugging")
        .when(some("user_prompt_count") | some("assistant_message_count"), "research_only")
        .otherwise("unknown")
    )


def parse_status(errors: Column, records: Column) -> Column:
    """ok without errors, partial with some records left, failed with none."""
    return F.when(errors == 0, "ok").when(records > 0, "partial").otherwise("failed")


def declared_total(value: Column) -> Column:
    """Token total declared as a number, numeric text or a JSON object; 0 otherwise."""
    doc = F.try_parse_json(value)
    keys = [F.try_variant_get(doc, f"$.{k}", "bigint") for k in ("total_tokens", "totalTokens", "tokens_used", "tokensUsed")]
    return F.coalesce(value.try_cast("double").cast("bigint"), *keys, F.lit(0).cast("bigint"))


# ---------------------------------------------------------------- nested values

def nested_text(text: str, keys: tuple[str, ...]) -> str:
    """Text, or a list of texts, under the first of some keys that any object of a JSON document has, at any depth.

    Objects are visited from the document inwards, the last written child first, each before what it holds; in each the keys
    are tried in their order. A stack of objects and lists as JSON text, which keeps the written order, is
    worked down one step for each bracket of the text, which bounds their number. NULL without a find.
    """
    kind = "schema_of_variant({})"
    tried = []
    for key in keys:
        value = f"try_element_at(x.v, '{key}')"
        tried.append(
            f"CASE WHEN {kind.format(value)} = 'STRING' THEN nullif(cast({value} AS string), '') "
            f"WHEN {kind.format(value)} IN ('ARRAY<STRING>', 'ARRAY<VOID>') AND NOT exists(cast({value} AS array<variant>), i -> is_variant_null(i)) THEN array_join(cast({value} AS array<string>), ' ') END"
        )
    inner = f"(t, v) -> if(startswith({kind.format('v')}, 'OBJECT') OR startswith({kind.format('v')}, 'ARRAY'), t, NULL)"
    children = f"array_compact(zip_with(coalesce(map_values(x.t), x.at), coalesce(map_values(x.v), x.av), {inner}))"

    def read(first: str, form: str) -> str:
        return f"if(startswith(ltrim(c), '{first}'), from_json(c, '{form}'), NULL)"

    parsed = f"named_struct('t', {read('{', 'map<string, string>')}, 'v', {read('{', 'map<string, variant>')}, 'at', {read('[', 'array<string>')}, 'av', {read('[', 'array<variant>')})"
    rest = "slice(s.stack, 1, size(s.stack) - 1)"
    visit = f"x -> named_struct('stack', concat({rest}, coalesce({children}, cast(array() AS array<string>))), 'found', coalesce({', '.join(tried)}))"
    step = f"get(transform(array(element_at(s.stack, -1)), c -> get(transform(array({parsed}), {visit}), 0)), 0)"
    steps = f"sequence(1, greatest(1, length({text}) - length(translate({text}, '{{[', ''))))"
    return f"aggregate({steps}, named_struct('stack', array({text}), 'found', cast(NULL AS string)), (s, i) -> if(s.found IS NOT NULL OR size(s.stack) = 0, s, {step}), s -> s.found)"


# ---------------------------------------------------------------- paths

def file_stem(path_column: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path_column, r"([^/\\]+)$", 1), r"(?i)\.(jsonl|json|log)$", "")


def parent_path(path_column: Column) -> Column:
    return F.regexp_extract(path_column, r"^(.*)/", 1)


def comparable_path(path_column: Column) -> Column:
    """A path that compares equal however Windows spelled it."""
    return F.regexp_replace(F.regexp_replace(path_column, r"^\\\\\?\\", ""), r"\\", "/")


def _dashes_to_path(name: Column) -> Column:
    parts = F.filter(F.split(name, "-"), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def project_path(project_dir: Column) -> Column:
    """Working folder a transcript project folder stands for: -a-b-c -> /a/b/c."""
    name = F.regexp_extract(project_dir, r"([^/]+)/?$", 1)
    return F.when(name.startswith("-"), _dashes_to_path(F.substring(name, 2, 10_000))).otherwise(project_dir)


def workspace_project_path(file_path: Column, home: Column) -> Column:
    """Working folder behind .../projects/<id>/...: known roots first, then dashes."""
    project = F.regexp_extract(file_path, r"^.*/projects/([^/]+)", 1)
    tokens = F.filter(F.split(F.regexp_replace(project, "^-", ""), "-"), lambda p: p != "")
    first, rest = F.get(tokens, F.lit(0)), F.array_join(F.slice(tokens, 2, 1_000), "/")
    two = F.size(tokens) >= 2
    drive = F.concat(F.upper(first), F.lit(":\\"), F.array_join(F.slice(tokens, 2, 1_000), "\\"))
    return (
        F.when(project == "", None)
        .when(two & first.isin("Users", "home", "tmp"), F.concat(F.lit("/"), first, F.lit("/"), rest))
        .when(two & first.rlike("^[A-Za-z]$"), drive)
        .when(project.startswith("-"), _dashes_to_path(project))
        .otherwise(F.concat(home, F.lit("/projects/"), project))
    )


def path_epoch(file_path: Column) -> Column:
    """Instant named by a path part of 10 to 13 digits."""
    digits = F.regexp_extract(file_path, r"(?:^|/)(\d{10,13})(?=/|$)", 1).try_cast("bigint")
    return F.timestamp_millis(F.when(digits < 10_000_000_000, digits * 1000).otherwise(digits))


def join_key(key: Column, ord_: Column) -> Column:
    """A key to join by: rows without one get keys of their own that match nothing, so they spread evenly."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), ord_.cast("string")))
