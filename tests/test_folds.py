"""Chunked scans and folds equal one pass in order, at any chunk size."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tokentally.operators import folds, rollout, scans, workspace


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_forward_fill_and_running_sum(spark, chunk):
    rng = random.Random(1)
    data = [(f"k{rng.randrange(3)}", i, rng.choice([None, None, i])) for i in range(60)]
    df = spark.createDataFrame(data, "key string, ord bigint, v bigint")
    last, total, expected = {}, {}, []
    for key, i, v in data:
        last[key] = v if v is not None else last.get(key)
        total[key] = total.get(key, 0) + (v or 0)
        expected.append((key, i, last[key], total[key]))
    filled = scans.forward_fill(df, ["key"], "ord", {"f": F.col("v")}, chunk)
    summed = scans.running_sum(filled, ["key"], "ord", F.coalesce("v", F.lit(0)), "s", chunk)
    got = [(r.key, r.ord, r.f, r.s) for r in summed.orderBy("ord").collect()]
    assert got == expected


def snapshots(rng, n):
    rows, sums = [], [0, 0]
    for i in range(n):
        last = rng.randrange(1, 50)
        before = sums[i % 2]
        s = sums[i % 2] = before + last
        roll = rng.random()
        snap = None if roll < 0.1 else before or None if roll < 0.3 else last if roll < 0.35 else max(1, s - rng.randrange(0, 30)) if roll < 0.6 else s
        fields = None if snap is None else [10 * snap, 2 * snap, 0, 0, 0, 2 * snap, snap, 13 * snap]
        rows.append(("h", f"f{i % 2}", i, "delta", 10 * last, 2 * last, 0, 0, 0, 2 * last, last, 13 * last, *(fields or [None] * 8)))
    return rows


@pytest.mark.parametrize("chunk", [1, 2, 7, 1000])
def test_stale_snapshots_equal_one_pass(spark, chunk):
    names = ["host", "file", "ord", "kind", *rollout.USAGE, *[f"snap_{n}" for n in folds.SNAPSHOT]]
    data = snapshots(random.Random(chunk), 80)
    schema = ", ".join(f"{n} {'string' if n in ('host', 'file', 'kind') else 'bigint'}" for n in names)
    expected, states = [], {}
    for row in data:
        record = dict(zip(names, row))
        kept, states[record["file"]] = folds.stale_snapshot_step(states.get(record["file"]), record)
        expected.append((record["file"], record["ord"], kept))
    got = rollout.drop_stale_snapshots(spark.createDataFrame(data, schema), chunk)
    assert rows_of(got, "file", "ord", "kept") == sorted(expected)
    assert {e[2] for e in expected} == {True, False}


def brute_messages(data):
    kept = []
    for ord_, text, at in data:
        def near(other):
            return other[1] == text and (other[2] is None or at is None or abs(other[2] - at) <= 5_000)

        if not any(near(o) for o in kept):
            kept.append((ord_, text, at))
    return sorted(o for o, _, _ in kept)


@pytest.mark.parametrize("chunk, seed, untimed", [(1, 1, 0), (3, 2, 0), (1000, 3, 0), (4, 4, 0.1), (1000, 5, 0.1)])
def test_near_duplicates_equal_all_pairs(spark, chunk, seed, untimed):
    rng = random.Random(seed)
    data = [(i, rng.choice("ab"), None if rng.random() < untimed else i * 1_500 + rng.randrange(-9_000, 9_000)) for i in range(80)]
    df = spark.createDataFrame([("h", "f", o, "user", t, a) for o, t, a in data], "host string, file string, ord bigint, role string, text string, ms bigint")
    got = rollout.distinct_messages(df.withColumn("at", F.timestamp_millis("ms")).drop("ms"), chunk=chunk)
    assert sorted(r.ord for r in got.collect()) == brute_messages(data)


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_fragment_merge_equals_one_pass(spark, chunk):
    rng = random.Random(9)
    names = [*workspace.WINNER, *workspace.LARGEST, *workspace.COUNTS, "cost_micro", "estimated", "started_ms", "ended_ms"]
    data = []
    for i in range(40):
        fields = {n: rng.choice([None, f"{n}{i}"]) for n in workspace.WINNER}
        fields.update({n: rng.randrange(0, 4) for n in workspace.LARGEST})
        fields.update({n: rng.choice([0, 0, rng.randrange(1000)]) for n in workspace.COUNTS})
        fields.update(cost_micro=rng.choice([None, i]), estimated=rng.random() < 0.1, started_ms=1000 + i, ended_ms=2000 + i)
        data.append(("h", f"id{i % 3}", i, *[fields[n] for n in names]))
    kinds = {**dict.fromkeys(workspace.WINNER, "string"), "estimated": "boolean"}
    schema = "host string, id string, ord bigint, " + ", ".join(f"{n} {kinds.get(n, 'bigint')}" for n in names)
    df = spark.createDataFrame(data, schema).withColumn("started_at", F.timestamp_millis("started_ms")).withColumn("ended_at", F.timestamp_millis("ended_ms"))
    states = {}
    for _, key, ord_, *values in data:
        _, states[key] = workspace.merge_step(states.get(key), {**dict(zip(names, values)), "place": ord_})
    got = {r.id: r.asDict() for r in workspace.merge_fragments(df.drop("started_ms", "ended_ms"), "ord", chunk).collect()}
    for key, state in states.items():
        assert {n: got[key][n] for n in json.loads(json.dumps(state))} == state
