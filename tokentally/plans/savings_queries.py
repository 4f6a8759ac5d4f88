"""Savings reports, one per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.operators import reports, sorts
from tokentally.plans.binding import Tables
from tokentally.plans.registry import query
from tokentally.runtime import parsed_once
from tokentally.sources import savings


def _reports(t: Tables) -> DataFrame:
    lines = [
        "'Token Savings'", "concat('Total commands:    ', format_number(c_custkey * 3 + 1000, 0))", "concat('Input tokens:      ', c_custkey + 1, 'K')", "concat('Output tokens:     ', c_custkey div 2, 'K')",
        "concat('Tokens saved:      ', c_custkey + 1, '00 (', c_custkey % 90, '.5%)')", "concat('Total exec time:   ', c_custkey % 50, 'm3s (avg ', c_custkey % 9, 'ms)')", "''", "'By Command'", "'------'",
        "concat('1.  git  diff', '')", "concat('2.  pnpm test   ', c_custkey % 7, '   ', c_custkey % 11, 'K   ', c_custkey % 100, '.0%   ', c_custkey % 60, 's')",
        "concat('3.  ls -la   ', c_custkey % 5, '   ', c_custkey % 13, 'K   ', c_custkey % 70, '.5%   2m1s')",
        "''", "'MISSED SAVINGS'", "'h1'", "'h2'", "concat('cat file   ', c_custkey % 8, '   proxy read   existing   ~', c_custkey % 9, 'K tokens')", "'Total: x'", "'TOP UNHANDLED COMMANDS'", "'h1'", "'h2'",
        "concat('make all   ', c_custkey % 6, '   make all -j8')", "'-> add'",
        "''", "'Recent Commands'", "'──────'", "concat('12:0', c_custkey % 10, ' • cargo  test -', c_custkey % 30, '% (1.2K)')", "array_join(transform(sequence(1, 4 + c_custkey % 6), i -> concat('13:', 10 + i, ' • make t', i, ' -1% (', i, 'K)')), '\\n')",
    ]
    return t.table("customer").selectExpr("concat('h', c_custkey % 3) AS host", "concat('/r/', c_custkey, '.txt') AS file", f"concat_ws('\\n', {', '.join(lines)}) AS body")


KEY = "'/r/' || c_custkey || '.txt' AS file"


@query("scan_savings_report", f"""SELECT {KEY}, c_custkey * 3 + 1000 AS total_commands, (c_custkey + 1) || 'K' AS input_tokens, (c_custkey // 2) || 'K' AS output_tokens, (c_custkey + 1) || '00' AS tokens_saved,
  (c_custkey % 90)::DOUBLE + 0.5::DOUBLE AS saved_percent, (c_custkey % 50) || 'm3s' AS total_exec_time, (c_custkey % 9) || 'ms' AS average_exec_time FROM customer""")
def _(t: Tables) -> DataFrame:
    return savings.report_totals(_reports(t)).drop("host")


COMMANDS = f"""SELECT {KEY}, 'git' AS command, NULL::BIGINT AS count, NULL AS saved, NULL::DOUBLE AS average_saved_percent, NULL AS time FROM customer
UNION ALL SELECT {KEY}, 'pnpm test', c_custkey % 7, (c_custkey % 11) || 'K', (c_custkey % 100)::DOUBLE, (c_custkey % 60) || 's' FROM customer
UNION ALL SELECT {KEY}, 'ls -la', c_custkey % 5, (c_custkey % 13) || 'K', (c_custkey % 70)::DOUBLE + 0.5::DOUBLE, '2m1s' FROM customer"""


SAVED_ORDER = "coalesce(replace(saved, 'K', '')::BIGINT * 1000, 0) DESC, command, file"


@query("sort_saved_commands", f"SELECT *, row_number() OVER (ORDER BY {SAVED_ORDER}) - 1 AS position FROM ({COMMANDS.replace('NULL AS saved', 'NULL::VARCHAR AS saved')})")
def _(t: Tables) -> DataFrame:
    # A sort reads its rows twice, first to find the ranges; reports are parsed once.
    return sorts.with_position(sorts.sort_saved_commands(parsed_once(savings.saved_commands(_reports(t)).drop("host")), "saved", descending=True))


@query("recent_saved_commands", f"""SELECT {KEY}, 0 AS place, '12:0' || (c_custkey % 10) AS time, 'cargo test' AS command, '-' || (c_custkey % 30) || '% (1.2K)' AS savings FROM customer
UNION ALL SELECT file, i::INTEGER, '13:' || (10 + i), 'make t' || i, '-1% (' || i || 'K)' FROM (SELECT {KEY}, unnest(range(1, 5 + c_custkey % 6)) AS i FROM customer)""")
def _(t: Tables) -> DataFrame:
    return savings.recent_commands(_reports(t), limit=None).select("file", "place", "time", "command", "savings")


@query("savings_coverage_gaps", f"SELECT {KEY}, 'cat file' AS command, c_custkey % 8 AS count, 'proxy read' AS equivalent, 'existing' AS status, (c_custkey % 9) || 'K tokens' AS estimated_savings FROM customer")
def _(t: Tables) -> DataFrame:
    return savings.coverage_gaps(_reports(t)).drop("host")


@query("savings_unhandled", f"SELECT {KEY}, 'make all' AS command, c_custkey % 6 AS count, 'make all -j8' AS example FROM customer")
def _(t: Tables) -> DataFrame:
    return savings.unhandled_commands(_reports(t)).drop("host")


@query("savings_summary", f"""
SELECT {KEY}, c_custkey * 3 + 1000 AS total_commands, (c_custkey + 1) * 100 AS avoided_tokens, (c_custkey + 1) * 1000 AS without_tokens, (c_custkey // 2) * 1000 AS with_tokens,
  ((c_custkey + 1) * 100 * 5)::DOUBLE / 1000000.0 AS avoided_usd, (c_custkey % 90)::DOUBLE + 0.5::DOUBLE AS saved_percent,
  CASE WHEN c_custkey % 13 = 0 AND c_custkey % 11 = 0 THEN 'git' WHEN c_custkey % 13 >= c_custkey % 11 THEN 'ls -la' ELSE 'pnpm test' END AS top_command FROM customer""")
def _(t: Tables) -> DataFrame:
    return savings.savings_summary(_reports(t), reports.avoided_cost_rate(t.cards)).drop("host")
