"""Nothing is cut before it is searched, classified or counted; edited cards take effect."""

import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from tokentally import rates
from tokentally.functions import warnings
from tokentally.operators import friction, pricing, reports, rollout, workspace
from tokentally.runtime import local_table
from test_pricing import card, requests


def test_record_is_searched_to_its_end():
    deep = {"model": "gpt-5", "inputTokens": 7}
    for _ in range(40):
        deep = {"inner": deep}
    record = {"items": [{"n": i} for i in range(300)] + [deep]}
    found = workspace.record_fields(record)
    assert found["model"] == "gpt-5" and found["input_tokens"] == 7


def test_first_field_in_written_order():
    found = workspace.record_fields({"a": {"title": "inner", "b": [{"title": "deeper"}]}, "title": "outer"})
    assert found["title"] == "outer"
    assert workspace.record_fields([{"a": {"title": "first"}}, {"title": "second"}])["title"] == "first"


def test_term_anywhere_makes_a_row_interesting(spark):
    df = spark.createDataFrame([("k", "x" * 5000 + "composer"), ("k", "x" * 5000)], "key string, value string")
    assert [r.i for r in df.select(workspace.interesting(F.col("key"), F.col("value")).alias("i")).collect()] == [True, False]


def _issues(spark, rows):
    schema = "host string, file string, ord bigint, line string, kind string, call_id string, output string, exit_code bigint, own_command string, command string"
    return spark.createDataFrame([("h", "f", i, "{}", "shell", None, output, 1, None, command) for i, (command, output) in enumerate(rows)], schema)


def test_output_and_command_are_read_whole(spark):
    long = "node run.js " + "a" * 300
    rows = friction.classified(_issues(spark, [(long + "1", "x " * 2000 + "permission denied"), (long + "2", "x")])).orderBy("ord").collect()
    assert rows[0].severity == "critical" and rows[1].severity == "info"
    assert [r.command for r in rows] == [long + "1", long + "2"]


def test_clusters_count_every_issue(spark):
    issues = friction.repeat_failures(friction.classified(_issues(spark, [("pnpm build", "failed")] * 20)))
    row = friction.issue_clusters(issues, "host").collect()[0]
    assert (row["count"], row.sessions) == (20, 1)
    rollup = friction.issue_rollup(issues).collect()[0]
    assert (rollup.non_zero_command_events, rollup.repeated_failure_clusters) == (20, 1)


def test_timeline_compares_whole_texts(spark):
    rows = [("h", "f", i, "user", "same " * 300 + str(i), None) for i in range(90)]
    said = spark.createDataFrame(rows, "host string, file string, ord bigint, role string, text string, at timestamp")
    assert rollout.timeline_of(said).count() == 80 and rollout.timeline_of(said, None).count() == 90


def test_edited_card_takes_effect(spark, tmp_path):
    path = str(tmp_path / "cards")
    rows = requests(spark, [("s", "my-model", 10, 1_000_000, 0, 0, 0, 0)])

    def cost(price):
        local_table(spark, [card("my-model", input=price, output=1)], rates.CARD_SCHEMA).write.mode("overwrite").parquet(path)
        saved = spark.read.schema(rates.CARD_SCHEMA).parquet(path)
        cards = pricing.load_cards(rates.bundled_cards_df(spark), saved)
        return pricing.price_requests(rows, cards).agg(F.sum("cost_pico")).first()[0]

    assert cost(10) == 10 * cost(1)


def test_thread_meets_only_files_that_share_its_id(spark):
    threads = spark.createDataFrame([("h", f"thread-{i:08d}", None) for i in range(30)] + [("h", "own", "/own")], "host string, id string, rollout_path string")
    files = spark.createDataFrame([("h", f"rollout-x-thread-{i:08d}", f"/logs/{i}") for i in range(0, 30, 2)] + [("h", "00000003", "/logs/short")], "host string, id string, path string")
    found = {r.id: r.path for r in rollout.thread_files(threads, files).collect()}
    assert found == {"own": "/own", "thread-00000003": "/logs/short"} | {f"thread-{i:08d}": f"/logs/{i}" for i in range(0, 30, 2)}


def test_entry_works_without_the_corpus_package():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[0] == 'corpus_pipeline' or name.startswith('tokentally.llm'):
            raise ModuleNotFoundError(f'No module named {name!r}', name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert 'group_by_repo' in e.queries() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)


def test_report_files_and_json_export(spark, tmp_path):
    from tokentally.sources import savings, sinks

    folder = tmp_path / "host=a"
    folder.mkdir()
    (folder / "r.txt").write_text("Token Savings\nTotal commands:    1,234\nTokens saved:      5K (2.5%)\n")
    reports = savings.read_reports(spark, str(tmp_path))
    row = savings.report_totals(reports).collect()[0]
    assert (row.host, row.total_commands, row.tokens_saved, row.saved_percent) == ("a", 1234, "5K", 2.5)
    out = str(tmp_path / "out")
    sinks.write_json(spark.createDataFrame([("s", 1.5)], "id string, cost_usd double"), out)
    assert [tuple(r) for r in spark.read.json(out).select("id", "cost_usd").collect()] == [("s", 1.5)]


def test_later_file_wins_for_an_id(spark):
    from tokentally.operators.filters import file_may_overlap
    from tokentally.sources import files

    rows = spark.createDataFrame([("h", f"/{d}/a.jsonl", 10 * d, 1, 1, "a") for d in (1, 3, 2)], "host string, file string, mtime_ms bigint, size bigint, lines bigint, id string")
    assert [r.file for r in files.latest_per_id(rows).collect()] == ["/3/a.jsonl"]
    assert sorted(r.file for r in rows.where(file_may_overlap(15, None)).collect()) == ["/2/a.jsonl", "/3/a.jsonl"]


def test_long_names_in_warnings_and_apps_stay_apart(spark):
    long = "m" * 1200
    codes = [f"unknown_pricing_model:{long}{i}" for i in range(2)]
    row = spark.createDataFrame([(codes,)], "warnings array<string>")
    assert row.select(reports.unpriced_models().alias("m")).first().m == [long + "0", long + "1"]
    other = spark.createDataFrame([(f"{long}{i}",) for i in range(2)], "w string")
    told = row.selectExpr("explode(warnings) AS w").select(warnings.readable(F.col("w")).alias("t")).collect()
    assert [long + str(i) in r.t for i, r in enumerate(told)] == [True, True]
    assert {r.t for r in other.select(warnings.detail(F.col("w"))["title"].alias("t")).collect()} == {"M" + long[1:] + "0", "M" + long[1:] + "1"}
    assert {r.t for r in other.select(rollout.app_label(F.col("w"), F.lit(None).cast("string")).alias("t")).collect()} == {"M" + long[1:] + "0", "M" + long[1:] + "1"}
