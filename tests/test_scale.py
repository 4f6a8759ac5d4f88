"""Inputs are read once, and nothing is broadcast because its size was estimated too low."""

import json

import pytest
from pyspark.sql import functions as F

from tokentally.operators import friction, otel, reports, rollout, scans, transcripts
from tokentally.plans import registry
from tokentally.runtime import prepare
from tokentally.sources import schemas
from tokentally.sources.files import parse_records

registry.load()


def executed(df) -> str:
    """The plan as it ran."""
    query = df._jdf.queryExecution()
    df._jdf.rdd().count()
    return query.executedPlan().toString()


def leaves(df) -> int:
    """How often the plan reads its input, a range."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Range (")


def telemetry(spark, n):
    attributes = "map('gen_ai.response.model', 'gpt-5', 'gen_ai.usage.input_tokens', '10')"
    line = f"to_json(named_struct('name', 'chat x', 'type', 'span', 'traceId', concat('a-rather-long-trace-id-', id), 'spanId', 's', 'attributes', {attributes}))"
    return parse_records(spark.range(n).selectExpr("'h' AS host", "concat('/f', id % 7) AS file", "id AS ord", f"{line} AS line"), schemas.OTEL)


def test_trace_contexts_are_not_broadcast_by_an_estimate(spark):
    prepare(spark)
    found = otel.candidates(telemetry(spark, 30_000))
    assert "BroadcastExchange" not in executed(found)
    assert found.count() == 30_000
    assert "BroadcastExchange" not in executed(otel.suppress_weaker(found))


def test_usage_rows_are_not_broadcast_by_an_estimate(spark):
    prepare(spark)
    counts = "named_struct('input_tokens', 5, 'output_tokens', 1)"
    line = f"to_json(named_struct('type', 'event_msg', 'payload', named_struct('type', 'token_count', 'info', named_struct('last_token_usage', {counts}))))"
    records = parse_records(spark.range(30_000).selectExpr("'h' AS host", "concat('/a-rather-long-file-name-', id) AS file", "id AS ord", f"{line} AS line"), schemas.ROLLOUT)
    requests = rollout.token_requests(records)
    assert "BroadcastExchange" not in executed(requests)
    assert requests.count() == 30_000


@pytest.fixture
def broadcasts_by_estimate(spark):
    """A caller's settings, under which a plan built earlier is run."""
    prepare(spark)
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "1g")
    yield
    for n, value in before.items():
        spark.conf.set(n, value)


def test_telemetry_joins_do_not_depend_on_the_callers_broadcast_settings(spark, broadcasts_by_estimate):
    records = telemetry(spark, 200)
    found = otel.candidates(records)
    assert "BroadcastExchange" not in executed(found)
    assert found.count() == 200
    merged = otel.merged_sessions(otel.file_events(records))
    assert "BroadcastExchange" not in executed(merged)
    assert merged.agg(F.sum("events")).first()[0] == 200


@pytest.mark.parametrize("method", ["delta_sum", "final_snapshot"])
def test_rollout_joins_do_not_depend_on_the_callers_broadcast_settings(spark, broadcasts_by_estimate, method):
    kind = "last_token_usage" if method == "delta_sum" else "total_token_usage"
    line = f"to_json(named_struct('type', 'event_msg', 'payload', named_struct('type', 'token_count', 'info', named_struct('{kind}', named_struct('input_tokens', 5, 'output_tokens', 1)))))"
    records = parse_records(spark.range(200).selectExpr("'h' AS host", "concat('/f', id) AS file", "id AS ord", f"{line} AS line"), schemas.ROLLOUT)
    requests, totals = rollout.token_requests(records), rollout.token_totals(records)
    # A key of host and file alone is the table of files; rows have their ordinal as a third.
    sent = [line for made in (requests, totals) for line in executed(made).splitlines() if "BroadcastExchange" in line]
    assert not [line for line in sent if "input[2, " in line]
    assert {(r.method, r.n) for r in requests.groupBy("method").agg(F.count("*").alias("n")).collect()} == {(method, 200)}
    assert totals.where("token_confidence = 'high' AND input_tokens = 5").count() == 200


def test_scans_do_not_depend_on_the_callers_broadcast_settings(spark, broadcasts_by_estimate):
    rows = spark.range(40).selectExpr("'h' AS host", "id AS ord", "if(id % 7 = 0, id, NULL) AS v")
    key = ["host"]
    summed = scans.running_sum(rows, key, "ord", F.lit(1), "n", chunk=9)
    placed = scans.row_places(rows, key, "ord", "n", chunk=9)
    filled = scans.forward_fill(rows, key, "ord", {"last": F.col("v")}, chunk=9)
    for made in (summed, placed, filled):
        assert "BroadcastExchange" not in executed(made)
    assert {r.ord + 1 - r.n for r in summed.collect() + placed.collect()} == {0}
    assert all(r.last == r.ord // 7 * 7 for r in filled.collect())


def test_fold_reads_its_input_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    rows = spark.range(40).selectExpr("'h' AS host", "'f' AS file", "id AS ord", "'user' AS role", "concat('t', id % 2) AS text", "timestamp_millis(id * 2000) AS at")
    kept = rollout.distinct_messages(rows.withColumn("text", F.udf(seen).asNondeterministic()("text").alias("text")), chunk=3)
    assert kept.count() == 20
    assert read.value == 40


def test_requests_are_merged_in_one_pass_and_unkeyed_copies_stay(spark):
    line = "to_json(named_struct('requestId', if(id < 4, 'r', NULL), 'timestamp', '2026-01-01T00:00:00Z', 'message', named_struct('id', 'm', 'model', 'claude-x', 'usage', named_struct('input_tokens', id))))"
    lines = spark.range(1, 7).selectExpr("'h' AS host", "'/f' AS file", "if(id > 4, 5L, id) AS ord", "0L AS mtime_ms", f"{line} AS line")
    once = transcripts.distinct_usage(transcripts.usage_rows(parse_records(lines, schemas.TRANSCRIPT)))
    rows = sorted((r.request_key or "", r.raw_input, r.copies) for r in once.collect())
    assert rows == [("", 4, 1), ("", 5, 1), ("", 6, 1), ("r:m", 3, 3)]
    assert leaves(once) == 1
    assert leaves(transcripts.split_sessions(transcripts.with_buckets(once))) == 1


def test_transcript_facts_take_one_pass(spark):
    tool = json.dumps({"message": {"role": "assistant", "content": [{"type": "tool_use", "name": "Bash"}]}, "toolUseResult": {"exit_code": 1}})
    lines = spark.range(4).selectExpr("'h' AS host", "if(id < 3, '/a', '/b') AS file", "id AS ord", f"if(id < 2, '{tool}', '{{cut') AS line")
    facts = transcripts.session_facts(parse_records(lines, schemas.TRANSCRIPT))
    got = {r.file: (r.tool_call_count, r.shell_command_count, r.failed_tool_call_count, r.assistant_message_count, r.parse_error_count, r.parse_status, r.session_outcome) for r in facts.collect()}
    assert got == {"/a": (2, 2, 2, 2, 1, "partial", "partial"), "/b": (None, None, None, None, 1, "failed", "failed")}
    assert leaves(facts) == 1


def test_lines_are_not_built_again_below_the_parse(spark):
    line = "to_json(named_struct('type', cast(id AS string)))"
    records = parse_records(spark.range(9).selectExpr("'h' AS host", "'/f' AS file", "id AS ord", f"if(id < 8, {line}, '{{cut') AS line"), schemas.TRANSCRIPT)
    good = records.where("not bad").select("file", "ord", "rec.type")
    assert good.count() == 8
    assert good._jdf.queryExecution().optimizedPlan().toString().count("StructsToJsonEvaluator") == 1


def test_prompt_timeline_numbers_all_whole_messages(spark, tmp_path):
    turns = spark.range(100).selectExpr("if(id < 95, 7L, 8L) AS conv_id", "cast(id AS int) AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat(cast(id AS string), 600) AS text")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    rows = registry.QUERIES["prompt_timeline"](spark, str(tmp_path)).collect()
    long = sorted((r.place, r.turn, len(r.text)) for r in rows if r.conv_id == 7)
    assert long == [(i + 1, i, 600 * len(str(i))) for i in range(95)]
    assert sorted(r.place for r in rows if r.conv_id == 8) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_row_places(spark, chunk):
    rows = spark.range(20).selectExpr("id % 3 AS k", "id div 6 AS ord", "id")
    got = [(r.id, r.n) for r in scans.row_places(rows, ["k"], "ord", "n", ("id",), chunk).orderBy("id").collect()]
    assert got == [(i, i // 3 + 1) for i in range(20)]


def test_split_pieces_without_ordinals_keep_their_model(spark):
    line = "to_json(named_struct('timestamp', concat('2026-01-0', id, 'T00:00:00Z'), 'message', named_struct('model', concat('claude-', id), 'usage', named_struct('input_tokens', 1))))"
    lines = spark.range(1, 4).selectExpr("'h' AS host", "'/f' AS file", "cast(NULL AS bigint) AS ord", "0L AS mtime_ms", f"{line} AS line")
    events = transcripts.with_buckets(transcripts.distinct_usage(transcripts.usage_rows(parse_records(lines, schemas.TRANSCRIPT))))
    assert sorted(r.model for r in transcripts.split_sessions(events).collect()) == ["claude-1", "claude-2", "claude-3"]


def test_records_of_one_ordinal_are_told_apart_by_their_place(spark):
    attributes = "map('gen_ai.usage.input_tokens', cast(id AS string), 'gen_ai.conversation.id', concat('c', id))"
    line = f"to_json(named_struct('name', 'chat x', 'type', 'span', 'traceId', 't', 'spanId', 's', 'attributes', {attributes}))"
    lines = spark.range(1, 9, 1, 4).selectExpr("'h' AS host", "'/f' AS file", "5L AS ord", f"{line} AS line")
    rows = otel.file_events(parse_records(lines, schemas.OTEL)).collect()
    assert [(r.session_id, r.input_tokens) for r in rows] == [("c8", 8)]


def test_groups_are_worked_out_once(spark):
    table = spark.range(20).selectExpr("concat('g', id) AS id", "concat('G', id) AS label", "id AS total_tokens")
    assert leaves(reports.model_share(table, "total_tokens", 8)) == 0
    rows = reports.filter_options(table, "label", ["G1", "H"])
    assert leaves(rows) == 1  # the one row of wanted values
    assert sorted((r.value, r.usage) for r in rows.collect())[-1] == ("H", 0)


def test_issues_are_worked_out_once(spark):
    rows = spark.range(6).selectExpr(
        "'h' AS host", "'/f' AS file", "id AS ord", "'make' AS command", "'unknown' AS category", "false AS harmless", "'unknown' AS classification", "'info' AS severity", "'low' AS impact"
    )
    found = friction.repeat_failures(rows)
    assert leaves(found) == 0
    assert [r.clustered for r in found.collect()] == [True] * 6


def test_model_rows_gather_no_warnings(spark):
    from tokentally.operators import groups

    slices = "array(named_struct('model', 'a', 'cost_micro', 5L, " + ", ".join(f"'{c}', 2L" for c in groups.TOKENS) + "))"
    sessions = spark.range(4).selectExpr(
        "cast(id AS string) AS id", "concat('/r', id % 2) AS repo_root", "timestamp_millis(id) AS started_at", "timestamp_millis(id) AS ended_at", "'a' AS model", f"{slices} AS model_usage",
        *[f"2L AS {c}" for c in groups.TOKENS], "5L AS cost_micro", "3L AS message_count", "array('w', cast(id AS string)) AS warnings",
    )
    made = reports.model_usage(sessions)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "_code" not in plan
    row = made.first()
    assert (row.id, row.cost_micro, row.session_count, row.message_count, row.total_tokens, row.top_repo, row.latest_session) == ("a", 20, 4, 12, 8, "/r0", "3")


def usage_sessions(spark, n):
    from tokentally.operators import groups

    return spark.range(n).selectExpr(
        "cast(id AS string) AS id", "concat('t', id) AS title", "concat('/r', id % 2) AS repo_root", "concat('a', id % 3) AS source_app", "'codex' AS source_client", "'a' AS model",
        "array(named_struct('model', 'a', 'cost_micro', 5L, " + ", ".join(f"'{c}', 2L" for c in groups.TOKENS) + ")) AS model_usage",
        *[f"2L AS {c}" for c in groups.TOKENS], "if(id = 1, 50L, 5L) AS cost_micro", "3L AS message_count", "array('w', concat('v', id % 2)) AS warnings", "'ok' AS parse_status", "0L AS parse_error_count",
        "'cli' AS detected_surface", "1L AS file_edit_count", "9L AS shell_command_count", "0L AS important_command_failures", "0L AS failed_tool_call_count",
    )


def test_model_groups_sum_slices_in_a_hash_aggregate(spark):
    from tokentally.operators import groups

    made = groups.by_model(usage_sessions(spark, 4))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    spread = [line for line in plan.splitlines() if "Aggregate [_id" in line]
    assert len(spread) == 1 and "_code" in spread[0].split("]")[0] and "collect_set" not in spread[0]
    row = made.first()
    assert (row.id, row.cost_micro, row.session_count, row.message_count, row.total_tokens, row.warnings) == ("a", 20, 4, 12, 8, ["v0", "v1", "w"])


def test_health_facts_are_summed_in_numbers(spark):
    from tokentally.operators import rules

    made = rules.health_signals(usage_sessions(spark, 4))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and "Aggregate [repo_root" in plan
    rows = {r.id: r.metric for r in made.collect()}
    assert rows["cost-concentration"] == "76.9%" and rows["app-attribution"] == "3 apps" and rows["repo-grouping"] == "4 sessions"
    assert [r.id for r in rules.health_affected(usage_sessions(spark, 4)).where("signal = 'cost-concentration'").collect()] == ["1"]
