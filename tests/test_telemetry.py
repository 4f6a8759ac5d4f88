"""Telemetry events: what is shuffled and stored for them, and brute-force checks on rows with missing and repeated keys."""

import json
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tokentally import rates
from tokentally.operators import otel
from tokentally.runtime import FREED, parsed_once, prepare
from tokentally.sources import schemas, sessions
from tokentally.sources.files import parse_records

BODIES = {"chat_span": {"name": "chat x", "type": "span"}, "inference_log": {"body": "GenAI inference: m"}, "agent_turn_log": {"body": "copilot_chat.agent.turn: 1"}, "other": {"body": "x"}}


def odd_lines(n: int, seed: int) -> list[tuple]:
    """(host, file, ord, line): few traces, responses and sessions, so that they meet, some of each missing."""
    pick = random.Random(seed)
    out = []
    for i in range(n):
        source = pick.choice(list(BODIES))
        attributes = {
            "gen_ai.response.id": pick.choice([None, None, "r1", "r2", "r3"]), "gen_ai.response.model": pick.choice([None, "m1", "m2"]), "gen_ai.conversation.id": pick.choice([None, "c1", "c2"]),
            "github.copilot.interaction_id": pick.choice([None, "i1"]), "gen_ai.usage.input_tokens": pick.choice([None, "0", "7"]), "gen_ai.usage.output_tokens": pick.choice([None, str(i + 1)]),
        }
        line = BODIES[source] | {"traceId": pick.choice([None, "t1", "t2", "t3", "t1:s"]), "spanId": pick.choice([None, "s1", "s2", "s:s1"]), "attributes": {k: v for k, v in attributes.items() if v is not None}}
        out.append((pick.choice([None, "h", "h"]), pick.choice([None, "/a", "/b", "/c"]), i, json.dumps({k: v for k, v in line.items() if v is not None})))
    return out


def records(spark, rows):
    return parse_records(spark.createDataFrame(rows, "host string, file string, ord bigint, line string").repartition(3, "ord"), schemas.OTEL)


def expected_events(rows) -> list[tuple]:
    """(host, file, ord, dedup_key, session, model, input, output) of the events that stay in each file, in plain Python."""
    found = []
    for host, file, place, line in rows:
        rec = json.loads(line)
        a = rec["attributes"]
        source = next(s for s, body in BODIES.items() if all(rec.get(k) == v for k, v in body.items()))
        own = next(((-p, i, a[n]) for i, (n, p) in enumerate(otel.SESSION_ATTRIBUTES) if n in a), None)
        found.append({
            "host": host, "file": file, "ord": place, "source": None if source == "other" else source, "trace": rec.get("traceId"), "span": rec.get("spanId"), "response": a.get("gen_ai.response.id"),
            "model": a.get("gen_ai.response.model"), "own": own, "input": int(a.get("gen_ai.usage.input_tokens", 0)), "output": int(a.get("gen_ai.usage.output_tokens", 0)),
        })

    def same(x, y, name):
        return None not in (x["host"], x["file"], x[name]) and all(x[k] == y[k] for k in ("host", "file", name))

    used = [x for x in found if x["source"] and x["input"] + x["output"] > 0]
    for x in used:
        mates = [y for y in found if same(x, y, "trace")]
        sessions_told = sorted((y["own"][0], y["ord"], y["own"][2]) for y in mates if y["own"])
        models = [y["model"] for y in mates if y["model"]]
        x["session"] = x["own"][2] if x["own"] else sessions_told[0][2] if sessions_told else x["trace"] or "unknown-session"
        x["named"] = x["model"] or (models[0] if models else None)
        trace, span, place = x["trace"], x["span"], x["ord"]
        if x["source"] == "chat_span" and trace and span:
            x["key"] = f"{trace}:{span}"
        elif x["source"] == "inference_log" and trace and span:
            x["key"] = f"log:{trace}:{span}"
        elif x["source"] == "agent_turn_log":
            x["key"] = f"agent-turn:{trace}:idx-{place}" if trace else f"agent-turn:{x['session']}:idx-{place}:{place}"
        else:
            x["key"] = f"{x['source']}:{x['session']}:unknown:{place}"
    rank = otel.SOURCES.index
    kept = {}
    for x in used:
        if not any(rank(y["source"]) < rank(x["source"]) and (same(x, y, "trace") or same(x, y, "response")) for y in used):
            kept.setdefault((x["host"], x["file"], x["key"]), x)
    return sorted(((x["host"], x["file"], x["ord"], x["key"], x["session"], x["named"], x["input"], x["output"]) for x in kept.values()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_events_and_sessions_equal_plain_python(spark, seed):
    rows = odd_lines(150, seed)
    made = otel.file_events(records(spark, rows))
    wanted = expected_events(rows)
    names = ["host", "file", "ord", "dedup_key", "session_id", "model", "input_tokens", "output_tokens"]
    assert sorted((tuple(r) for r in made.select(*names).collect()), key=str) == wanted
    sums = {}
    for host, session in {(e[0], e[4]) for e in wanted if e[0]}:
        events = [e for e in wanted if (e[0], e[4]) == (host, session)]
        detailed = {e[1] for e in events if e[6] > 0}
        first = {}
        for e in sorted((e for e in events if e[1] and (not detailed or e[1] in detailed)), key=lambda e: (e[1], e[2])):
            first.setdefault(e[3], e)
        if first:
            sums[host, session] = (len(first), sum(e[6] for e in first.values()), sum(e[7] for e in first.values()), len({e[1] for e in events}))
    merged = otel.merged_sessions(made).collect()
    assert {(r.host, r.session_id): (r.events, r.input_tokens, r.output_tokens, r.fragments) for r in merged} == sums
    assert all((r.fragments > 1) == (r.warnings == ["copilot_duplicate_session_merged"]) for r in merged)


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_first_occurrences_shuffle_what_is_read_once_by_trace(spark):
    prepare(spark)
    made = otel.file_events(records(spark, odd_lines(60, 1))).select("file", "ord", "dedup_key")
    optimized = made._jdf.queryExecution().optimizedPlan().toString()
    # The records themselves are read, not a stored copy of all columns.
    assert "from_json" in optimized
    plan = executed(made)
    sent = [line.split("Exchange hashpartitioning(")[1].split("plan_id")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "ReusedExchange" not in line]
    keys = sorted(name for line in sent for name in ("trace_id", "response_id", "dedup_key") if name in line)
    assert keys == ["dedup_key", "response_id", "trace_id"]
    assert "ReusedExchange" in plan and "SortMergeJoin" not in plan
    # Counts of tokens are no part of the answer: they end below the first shuffle.
    assert "input_tokens" not in optimized.split("RepartitionByExpression")[0]


def shuffled_files(spark) -> int:
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
    return sum(str(blocks.apply(i)).startswith("shuffle_") for i in range(blocks.size()))


def test_what_a_stored_table_shuffled_leaves_the_disk(spark):
    before, setting = shuffled_files(spark), spark.conf.get(FREED, None)
    table = parsed_once(spark.range(1000).repartition(5, F.col("id") % 5))
    for _ in range(50):  # they are deleted in the background
        if shuffled_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffled_files(spark) <= before
    assert (table.count(), table.agg(F.sum("id")).first()[0]) == (1000, 499_500)
    assert spark.conf.get(FREED, None) == setting
    with pytest.raises(Exception):
        parsed_once(spark.range(3).select(F.raise_error(F.lit("no")).alias("x")))
    assert spark.conf.get(FREED, None) == setting


def test_detailed_events_are_not_joined_with_their_files(spark):
    prepare(spark)
    events = spark.range(12).selectExpr(
        "'h' AS host", "concat('/f', id % 3) AS file", "id AS ord", "concat('s', id % 2) AS session_id", "concat('k', id div 3) AS dedup_key", "id % 3 < 2 AS detailed", "id AS input_tokens"
    )
    made = otel.merge_events(events)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == plan.count("Join LeftSemi") == 1
    left = plan.split("Join LeftSemi")[1]
    assert "NOT" in left and "detailed" in left.split("Range (")[0]
    rows = made.collect()
    assert all(r.detailed for r in rows)
    # Of the files of a key, the first by path.
    assert sorted((r.session_id, r.dedup_key, r.file) for r in rows) == sorted({(f"s{i % 2}", f"k{i // 3}", f"/f{i % 3}") for i in range(12) if i % 3 < 2 and not (i % 3 == 1 and (i - 1) % 2 == i % 2)})


def stored_columns(df) -> list[set[str]]:
    """Columns of each stored table that a plan reads, as they lie in the files."""
    spark = df.sparkSession
    folders = {str(Path(f.removeprefix("file://").removeprefix("file:")).parent) for f in df.inputFiles() if "tokentally-" in f}
    return [set(spark.read.parquet(folder).columns) for folder in sorted(folders)]


def test_session_tables_store_events_and_no_lines(spark):
    prepare(spark)
    cards = rates.bundled_cards_df(spark)
    telemetry = sessions.otel_sessions(records(spark, odd_lines(60, 2)), cards)
    stored = stored_columns(telemetry)
    assert len(stored) == 2 and all("dedup_key" in c and "span_id" not in c for c in stored)
    assert "from_json" not in telemetry._jdf.queryExecution().optimizedPlan().toString()
    usage = json.dumps({"sessionId": "x", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "assistant", "model": "claude-x", "usage": {"input_tokens": 5, "output_tokens": 2}}})
    lines = spark.createDataFrame([("h", "/p/a.jsonl", i, 0, usage) for i in range(3)], "host string, file string, ord bigint, mtime_ms bigint, line string")
    transcripts = sessions.transcript_sessions(parse_records(lines, schemas.TRANSCRIPT), cards)
    found = stored_columns(transcripts)
    assert {"rec", "bad"} <= set().union(*found) and not any("line" in c for c in found)
    assert "Scan ExistingRDD" not in transcripts._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.id, r.input_tokens, r.output_tokens, r.message_count) for r in transcripts.collect()] == [("x", 15, 6, 3)]
