"""Savings reports of a command proxy: text with labelled values and ranked tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.functions import text

REPORT = ["host", "file"]


def read_reports(spark: SparkSession, path: str | list[str], glob: str = "*.txt", host_pattern: str = r"/host=([^/]+)/") -> DataFrame:
    """One row per report file: host, file, body."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True).select(
        F.regexp_extract("_metadata.file_path", host_pattern, 1).alias("host"), F.col("_metadata.file_path").alias("file"), F.col("value").alias("body")
    )


def _with_lines(reports: DataFrame) -> DataFrame:
    return reports.withColumn("lines", F.transform(F.split("body", r"\r?\n"), lambda l: F.trim(l)))


def _first_line(starts: str) -> Column:
    """1-based place of the first line that starts with a text; 0 without one."""
    return F.array_position(F.transform("lines", lambda l: l.startswith(starts)), F.lit(True))


def _line_is(marker: str) -> Column:
    return F.array_position(F.transform("lines", lambda l: l == marker), F.lit(True))


def _value(label: str) -> Column:
    line = F.get(F.filter("lines", lambda l: l.startswith(label + ":")), F.lit(0))
    return F.trim(F.substr(line, F.lit(len(label) + 2)))


def _section(start: Column, skip: int, end: Column) -> Column:
    """Lines after a marker and ``skip`` more, up to the end marker behind it."""
    first = start + 1 + skip
    size = F.when(end > start, end - first).otherwise(F.size("lines") - first + 1)
    return F.when((start > 0) & (size > 0), F.slice("lines", first.cast("int"), size.cast("int"))).otherwise(F.array().cast("array<string>"))


def _number(value: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(value, ",", ""), r"(\d+)", 1).try_cast("bigint")


def _percent(value: Column) -> Column:
    return F.regexp_extract(value, r"([\d.]+)%", 1).try_cast("double")


def report_totals(reports: DataFrame) -> DataFrame:
    """One row per report: its labelled values."""
    saved, run = _value("Tokens saved"), _value("Total exec time")
    return _with_lines(reports).select(
        *REPORT, _number(_value("Total commands")).alias("total_commands"), _value("Input tokens").alias("input_tokens"), _value("Output tokens").alias("output_tokens"),
        F.regexp_replace(saved, r"\s+\(.+\)$", "").alias("tokens_saved"), _percent(saved).alias("saved_percent"),
        F.regexp_replace(run, r"\s+\(.+\)$", "").alias("total_exec_time"), F.nullif(F.regexp_extract(run, r"\(avg\s+(.+)\)", 1), F.lit("")).alias("average_exec_time"),
    )


def saved_commands(reports: DataFrame) -> DataFrame:
    """Ranked command rows: command, count, saved, average percent, time."""
    rows = _section(_line_is("By Command"), 0, _line_is("Recent Commands"))
    ranked = _with_lines(reports).select(*REPORT, F.explode(rows).alias("line")).where(F.col("line").rlike(r"^\d+\.\s+"))
    columns = F.filter(F.split(F.regexp_replace("line", r"^\d+\.\s+", ""), r"\s{2,}"), lambda c: c != "")
    cells = ranked.withColumn("c", columns)

    def cell(place: int) -> Column:
        return F.get("c", F.lit(place))

    return cells.select(
        *REPORT, cell(0).alias("command"), _number(cell(1)).alias("count"), cell(2).alias("saved"), _percent(cell(3)).alias("average_saved_percent"), cell(4).alias("time")
    ).where("command is not null")


def recent_commands(reports: DataFrame, limit: int | None = 6) -> DataFrame:
    """The recent lines of a report, split into time, command and savings; the report shows ``limit`` (None: all)."""
    marker = _line_is("Recent Commands")
    rows = F.filter(_section(marker, 1, F.lit(0)), lambda l: (l != "") & ~l.startswith("─"))
    rows = rows if limit is None else F.slice(rows, 1, limit)
    lines = _with_lines(reports).select(*REPORT, F.posexplode(rows).alias("place", "line"))
    parts = F.transform(F.split("line", "•"), lambda p: F.trim(p))
    rest = F.coalesce(F.get(parts, F.lit(1)), F.col("line"))
    savings = F.nullif(F.regexp_extract(rest, r"(-?\d+(?:\.\d+)?%\s*\([^)]+\))$", 1), F.lit(""))
    command = F.when(savings.isNotNull(), F.expr("substring(_rest, 1, length(_rest) - length(_savings))")).otherwise(F.col("_rest"))
    staged = lines.withColumn("_rest", rest).withColumn("_savings", savings).withColumn("_time", F.get(parts, F.lit(0)))
    return staged.select(
        *REPORT, "place", F.when((F.col("_time") != "") & (F.col("_time") != F.col("_rest")), F.col("_time")).alias("time"),
        text.collapse_spaces(command).alias("command"), F.col("_savings").alias("savings"),
    )


def _table_rows(reports: DataFrame, start: str, end: str, pattern: str) -> DataFrame:
    rows = _section(_first_line(start), 2, _first_line(end))
    lines = _with_lines(reports).select(*REPORT, F.explode(rows).alias("line"))
    return lines.where("line <> '' AND NOT startswith(line, '─') AND NOT startswith(line, 'Command')").where(F.col("line").rlike(pattern))


def coverage_gaps(reports: DataFrame) -> DataFrame:
    """Missed savings: command, count, equivalent, status, estimate."""
    pattern = r"^(.+?)\s{2,}(\d+)\s{2,}(.+?)\s{2,}(.+?)\s{2,}(.+)$"
    found = _table_rows(reports, "MISSED SAVINGS", "Total:", pattern)

    def part(place: int) -> Column:
        return F.trim(F.regexp_extract("line", pattern, place))

    return found.select(*REPORT, part(1).alias("command"), part(2).cast("bigint").alias("count"), part(3).alias("equivalent"), part(4).alias("status"),
                        F.trim(F.regexp_replace(part(5), "^~", "")).alias("estimated_savings"))


def unhandled_commands(reports: DataFrame) -> DataFrame:
    """Commands without an equivalent: command, count, example."""
    pattern = r"^(.+?)\s{2,}(\d+)\s{2,}(.+)$"
    found = _table_rows(reports, "TOP UNHANDLED COMMANDS", "->", pattern)
    return found.select(*REPORT, *[F.trim(F.regexp_extract("line", pattern, i)).alias(n) for i, n in ((1, "command"), (3, "example"))],
                        F.regexp_extract("line", pattern, 2).cast("bigint").alias("count"))


def savings_summary(reports: DataFrame, rate: Column) -> DataFrame:
    """Per report: tokens with and without the proxy, avoided tokens and cost, top saver."""
    totals = report_totals(reports)
    avoided, given, shown = (text.token_amount(F.col(c)) for c in ("tokens_saved", "input_tokens", "output_tokens"))
    known = F.nullif(F.coalesce(shown, F.lit(0)) + F.coalesce(avoided, F.lit(0)), F.lit(0))
    order = F.struct(-F.coalesce(text.token_amount(F.col("saved")), F.lit(0)), F.col("command"))
    top = saved_commands(reports).groupBy(*REPORT).agg(F.min_by(text.collapse_spaces(F.col("command")), order).alias("top_command"))
    rows = totals.withColumns({"avoided_tokens": avoided, "without_tokens": F.coalesce(given, known), "_shown": shown})
    with_tokens = F.coalesce("_shown", F.greatest(F.col("without_tokens") - F.col("avoided_tokens"), F.lit(0)))
    cost = F.round(F.col("avoided_tokens").cast("double") * rate.cast("double")) / 1_000_000.0
    return rows.join(top, REPORT, "left").select(*REPORT, "total_commands", "avoided_tokens", "without_tokens", with_tokens.alias("with_tokens"), cost.alias("avoided_usd"), "saved_percent", "top_command")
