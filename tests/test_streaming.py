"""Incremental ingest and streaming queries."""

import json
import os
import random

from pyspark.sql import functions as F

from tokentally.operators import transcripts
from tokentally.sources import files, schemas
from tokentally.streaming import ingest, usage


def test_grown_file_is_read_again(spark, tmp_path):
    source, lines_path, ledger = tmp_path / "src", str(tmp_path / "lines"), str(tmp_path / "ledger")
    source.mkdir()
    (source / "a.jsonl").write_text('{"n":1}\n')
    (source / "b.jsonl").write_text('{"n":2}\n')
    for path in source.iterdir():
        os.utime(path, (1_700_000_000, 1_700_000_000))

    def run():
        return sorted(r.line for r in ingest.ingest(spark, str(source), lines_path, ledger).collect())

    assert run() == ['{"n":1}', '{"n":2}']
    assert run() == ['{"n":1}', '{"n":2}']
    (source / "a.jsonl").write_text('{"n":1}\n{"n":3}\n')
    os.utime(source / "a.jsonl", (1_700_000_100, 1_700_000_100))
    assert run() == ['{"n":1}', '{"n":2}', '{"n":3}']
    assert spark.read.parquet(ledger).count() == 3


def _file(folder, host, lines, time):
    path = folder / f"host={host}" / "a.jsonl"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(f'{{"n":{i}}}\n' for i in range(lines)))
    os.utime(path, (time, time))


def test_late_file_with_an_older_time_is_read(spark, tmp_path):
    source, paths = tmp_path / "src", (str(tmp_path / "lines"), str(tmp_path / "ledger"))
    _file(source, "a", 3, 1_700_001_000)
    assert ingest.ingest(spark, str(source), *paths).count() == 3
    _file(source, "b", 5, 1_700_000_000)
    found = ingest.ingest(spark, str(source), *paths)
    assert sorted(r.host for r in found.collect()) == ["a"] * 3 + ["b"] * 5


def test_run_that_died_between_the_writes_leaves_nothing(spark, tmp_path, monkeypatch):
    source, paths = tmp_path / "src", (str(tmp_path / "lines"), str(tmp_path / "ledger"))
    _file(source, "a", 4, 1_700_000_000)

    def died(*args):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        # The state is made ready after the lines are written.
        m.setattr(ingest, "PARSER_VERSION", property(died))
        try:
            ingest.ingest(spark, str(source), *paths)
        except Exception:
            pass
    assert spark.read.parquet(paths[0]).count() == 4 and not os.path.exists(paths[1])
    assert ingest.ingest(spark, str(source), *paths).count() == 4
    assert ingest.ingest(spark, str(source), *paths).count() == 4


def test_hours_of_a_stream(spark, tmp_path):
    rows = [("s", 1, i % 3, f"2026-01-01 0{i % 3}:00:0{i % 2}", "gpt-5", 10) for i in range(6)] + [("z", 9, 9, "2026-01-02 00:00:00", "gpt-5", 1)]
    df = spark.createDataFrame(rows, "session_id string, request_id bigint, message_id bigint, at string, model string, total_tokens bigint").withColumn("ts", F.col("at").cast("timestamp")).drop("at")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = usage.usage_by_hour(usage.stream_requests(spark, str(tmp_path / "in"), df.schema))
    usage.run_available(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("requests"), F.sum("total_tokens")).first()
    assert tuple(got) == (3, 30)


def _copies(rng, n):
    """Transcript lines: streamed copies of requests with rising and falling counts, in several files, some without ids."""
    rows = []
    for i in range(n):
        counts = {k: rng.randint(0, 50) for k in ("input_tokens", "cache_read_input_tokens", "output_tokens")}
        if rng.random() < 0.5:
            counts["service_tier"] = rng.choice(["standard", "priority"])
        request = rng.choice([None, *(f"r{j}" for j in range(25))])
        record = {"type": "assistant", "requestId": request, "timestamp": f"2026-05-0{rng.randint(1, 9)}T10:00:00Z", "message": {"id": "m", "role": "assistant", "model": rng.choice(["a", "b"]), "usage": counts}}
        rows.append(("h", f"/p/{rng.randint(0, 4)}.jsonl", i, json.dumps(record), rng.randint(1, 3)))
    return rows


def test_streamed_usage_equals_the_batch_in_any_order_and_after_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = _copies(rng, 240)
    everything = spark.createDataFrame(rows, usage.LINES)
    expected = sorted(map(str, transcripts.distinct_usage(transcripts.usage_rows(files.parse_records(everything, schemas.TRANSCRIPT))).select("file", "ord", "model", *transcripts.RAW, "service_tier", "copies", "request_key").collect()))
    rng.shuffle(rows)
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    for i in range(0, 240, 80):
        spark.createDataFrame(rows[i : i + 80], usage.LINES).coalesce(1).write.mode("append").parquet(source)
        usage.keep_usage(usage.stream_transcript_usage(spark, source), out, check)
    # A batch whose commit was lost runs again, over the same rows.
    commits = sorted(p for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit())
    for path in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        path.unlink(missing_ok=True)
    usage.keep_usage(usage.stream_transcript_usage(spark, source), out, check)
    found = usage.usage_so_far(spark, out)
    assert sorted(map(str, found.select("file", "ord", "model", *transcripts.RAW, "service_tier", "copies", "request_key").collect())) == expected
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3
