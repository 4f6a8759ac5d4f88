"""Readers of the log formats, on small files and records."""

import json

from pyspark.sql import functions as F

from tokentally import rates
from tokentally.operators import friction, otel, rollout, transcripts, workspace
from tokentally.sources import files, schemas, sessions, sinks


def lines(spark, records, file="/logs/a.jsonl", mtime=0):
    rows = [("h", file, i, r if isinstance(r, str) else json.dumps(r), mtime) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "host string, file string, ord bigint, line string, mtime_ms bigint")


def rollout_records(spark, records, **kwargs):
    return files.parse_records(lines(spark, records, **kwargs), schemas.ROLLOUT)


def turn(last, total=None):
    info = {"last_token_usage": dict(zip(("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens"), last))}
    if total:
        info["total_token_usage"] = dict(zip(("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens"), total))
    return {"type": "event_msg", "payload": {"type": "token_count", "info": info}}


def totals(spark, records):
    row = rollout.token_totals(rollout_records(spark, records)).collect()[0]
    return (row.input_tokens, row.cached_input_tokens, row.output_tokens, row.reasoning_tokens), row


def test_turns_are_summed_over_a_compaction(spark):
    got, row = totals(spark, [turn((100, 20, 50, 10), (100, 20, 50, 10)), turn((120, 40, 40, 5), (220, 60, 90, 15)), turn((50, 20, 25, 5), (50, 20, 25, 5))])
    assert got == (270, 80, 95, 20) and row.token_aggregation_method == "delta_sum" and row.token_snapshot_count == 3


def test_repeated_snapshot_is_skipped(spark):
    got, row = totals(spark, [turn((100, 20, 60, 10), (100, 20, 60, 10)), turn((100, 20, 60, 10), (100, 20, 60, 10)), turn((50, 10, 25, 5), (150, 30, 85, 15))])
    assert got == (150, 30, 70, 15) and row.warnings == ["duplicate_or_stale_token_snapshots_skipped"]


def test_cumulative_snapshot_wins_over_direct_usage(spark):
    whole = {"payload": {"info": {"total_token_usage": {"input_tokens": 9, "output_tokens": 3, "total_tokens": 12}}}}
    got, row = totals(spark, [{"usage": {"input_tokens": 5, "output_tokens": 5}}, whole])
    assert got == (9, 0, 3, 0) and row.total_tokens == 12 and row.warnings == ["token_direct_usage_ignored_after_cumulative_snapshot"]


def test_nested_cache_writes(spark):
    usage = {"input_tokens": 100, "input_tokens_details": {"cached_tokens": 7, "cache_write_tokens": 5, "cache_write_tokens_details": {"ttl_30m_tokens": 4, "ttl_12h_tokens": 6}}, "output_tokens": 2}
    row = rollout.token_usages(rollout_records(spark, [{"usage": usage}])).collect()[0]
    assert (row.cached_input_tokens, row.cache_write_tokens, row.cache_write_30m, row.cache_write_12h, row.total_tokens) == (7, 10, 4, 6, 102)


def call(i, command, name="exec_command"):
    return {"type": "response_item", "payload": {"type": "function_call", "name": name, "call_id": f"c{i}", "arguments": json.dumps(command)}}


def output(i, text="", code=None):
    payload = {"type": "function_call_output", "call_id": f"c{i}", "output": text}
    return {"type": "response_item", "payload": payload | ({"exit_code": code} if code is not None else {})}


def test_failures_take_the_command_that_started_the_session(spark):
    records = [
        call(1, {"cmd": "pnpm test"}), output(1, "Process running with session ID 7"), call(2, {"session_id": 7}, "write_stdin"), output(2, "Process running with session ID 7"),
        call(3, {"session_id": 7}, "write_stdin"), output(3, "Process exited with code 1"), call(4, {"command": ["rg", "x"]}), output(4, code=1),
    ]
    parsed = rollout_records(spark, records)
    issues = friction.command_issues(parsed, rollout.token_totals(parsed))
    got = sorted((r.command, r.category, r.classification, r.severity) for r in issues.collect())
    assert got == [("pnpm test", "test", "blocking_failure", "warning"), ("rg x", "search", "exploratory_miss", "ignored")]


def test_three_failures_of_a_command_block(spark):
    records = [r for i in range(3) for r in (call(i, {"command": "pnpm build"}), output(i, code=2))]
    parsed = rollout_records(spark, records)
    issues = friction.command_issues(parsed, rollout.token_totals(parsed))
    row = friction.issue_rollup(issues).collect()[0]
    assert (row.important_command_failures, row.repeated_failure_clusters, row.command_issue_severity, row.top_failure_type) == (3, 1, "critical", "build")


def claude(uses, request="r", message="m", model="claude-sonnet-4-5", at="2026-05-01T10:00:00.000Z"):
    usage = dict(zip(("input_tokens", "cache_read_input_tokens", "output_tokens"), uses))
    return {"type": "assistant", "requestId": request, "timestamp": at, "message": {"id": message, "role": "assistant", "model": model, "usage": usage}}


def test_streamed_copies_merge_to_the_largest(spark):
    records = files.parse_records(lines(spark, [claude((10, 20, 31)), claude((50, 40, 300))]), schemas.TRANSCRIPT)
    row = transcripts.with_buckets(transcripts.distinct_usage(transcripts.usage_rows(records))).collect()[0]
    assert (row.input_tokens, row.cached_input_tokens, row.output_tokens, row.copies, row.ord) == (90, 40, 300, 2, 0)


def test_copy_in_another_file_is_credited_to_the_older_one(spark):
    both = lines(spark, [claude((10, 0, 5))], "/p/projects/-a/new.jsonl", 2).union(lines(spark, [claude((7, 0, 9))], "/p/projects/-a/old.jsonl", 1))
    rows = transcripts.distinct_usage(transcripts.usage_rows(files.parse_records(both, schemas.TRANSCRIPT))).collect()
    assert [(r.file, r.raw_input, r.raw_output) for r in rows] == [("/p/projects/-a/old.jsonl", 10, 9)]


def test_transcript_sessions_split_by_day(spark):
    records = [claude((10, 0, 1), "r1", "m1"), claude((20, 0, 2), "r2", "m2", at="2026-05-02T10:00:00.000Z"), claude((99, 0, 9), "r3", "m3", at=None)]
    parsed = files.parse_records(lines(spark, records, "/p/projects/-home-me-app/s1.jsonl"), schemas.TRANSCRIPT)
    rows = sessions.transcript_sessions(parsed, rates.bundled_cards_df(spark)).orderBy("id").collect()
    assert [(r.id, r.total_tokens, r.cwd) for r in rows] == [
        ("s1#2026-05-01#claude-sonnet-4-5", 11, "/home/me/app"), ("s1#2026-05-02#claude-sonnet-4-5", 22, "/home/me/app"),
        ("s1#unknown-date#claude-sonnet-4-5", 108, "/home/me/app"),  # untimed usage is kept
    ]
    assert rows[0].cost_micro == 45 and "claude_session_split_by_activity_day" in rows[0].warnings


def test_stronger_source_suppresses_others_of_the_trace(spark):
    attributes = {"gen_ai.usage.input_tokens": 10, "gen_ai.usage.output_tokens": 2, "gen_ai.response.model": "gpt-5"}
    span = {"type": "span", "name": "chat gpt-5", "traceId": "t", "spanId": "a", "startTime": [1700000000, 0], "endTime": [1700000004, 834000000], "attributes": attributes}
    log = {"body": "GenAI inference: x", "traceId": "t", "spanId": "b", "attributes": attributes}
    events = otel.file_events(files.parse_records(lines(spark, [log, span]), schemas.OTEL)).collect()
    assert [(e.source, e.duration_ms, e.session_id) for e in events] == [("chat_span", 4834, "t")]


def test_nested_fields_follow_the_written_order():
    row = workspace.record_fields({"meta": {"conversationId": "c1"}, "usage": {"totalUsedTokens": 5, "input_tokens": "7"}, "role": "ai", "message": {"content": "hi"}})
    assert (row["id"], row["input_tokens"], row["estimated"], row["role"], row["text"]) == ("c1", 7, True, "assistant", "hi")


def test_lines_keep_their_order_and_bad_ones_are_marked(spark, tmp_path):
    folder = tmp_path / "host=box" / "logs"
    folder.mkdir(parents=True)
    body = [json.dumps({"type": "t", "id": str(i)}) for i in range(500)]
    body[100] = "{oops"
    (folder / "a b.jsonl").write_text("\n".join(body) + "\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = files.parse_records(files.read_lines(spark, str(tmp_path)), schemas.ROLLOUT).orderBy("ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.rec.id for r in rows if not r.bad] == [str(i) for i in range(500) if i != 100]
    assert len({r.ord for r in rows}) == 500 and {r.host for r in rows} == {"box"} and rows[0].file.endswith("/a b.jsonl")


def test_line_numbers_do_not_depend_on_the_split(spark, tmp_path):
    bodies = {"a.jsonl": "".join(f'{{"id": "{i}"}}' + ("\r\n" if i % 3 else "\n\n") for i in range(900)), "b.jsonl": '\n{bad\n{"id": "x"}', "c.log": "", "d.jsonl": '{"id": "' + "long" * 3000 + '"}\n{oops'}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body.encode())
    found = []
    for size in ("700", "5000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            records = files.parse_records(files.read_lines(spark, str(tmp_path)), schemas.ROLLOUT)
            found.append(sorted((r.file[-7:], r.ord, r.line) for r in records.collect()))
            errors = sorted((r.file[-7:], r.error) for r in files.parse_errors(records).collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert errors == [("b.jsonl", "jsonl_line_2"), ("d.jsonl", "jsonl_line_2")]
    expected = sorted((name, i, line.strip()) for name, body in bodies.items() for i, line in enumerate(body.replace("\r\n", "\n").split("\n")) if line.strip())
    assert [[(f.rsplit("/", 1)[-1], o, l) for f, o, l in rows] for rows in found] == [expected] * 3


def test_documents_are_lists_objects_or_lines(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"id": "a"},\n {"id": "b"}]')
    (tmp_path / "one.json").write_text('{\n"id": "c"}')
    (tmp_path / "lines.json").write_text('{"id": "d"}\n{"id": "e"}\n')
    rows = files.parse_records(files.read_documents(spark, str(tmp_path)), schemas.ROLLOUT).collect()
    assert sorted(r.rec.id for r in rows) == ["a", "b", "c", "d", "e"]


def test_csv_quotes_what_needs_it(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([('say "hi", you', "plain")], "a string, b string"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert '"say ""hi"", you",plain' in text.splitlines()
