"""Values at any depth of a record, against a plain walk."""

import json
import random

from pyspark.sql import functions as F

from test_logs import output, rollout_records
from tokentally.functions.records import nested_text
from tokentally.operators import friction, rollout

KEYS = ("command", "cmd", "argv", "args")


def plain(document):
    stack = [document]
    while stack:
        value = stack.pop()
        if isinstance(value, dict):
            for key in KEYS:
                found = value.get(key)
                if isinstance(found, str) and found:
                    return found
                if isinstance(found, list) and all(isinstance(i, str) for i in found):
                    return " ".join(found)
            stack += value.values()
        elif isinstance(value, list):
            stack += value
    return None


def document(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice(["", '{"command":"no"}', "x y", 1, None, True, "a[b{", "é"])
    if kind < 0.5:
        return [document(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    if kind < 0.6:
        return [rng.choice(["p", "q r"]) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["z", "a", "m", "command", "cmd", "argv", "args", "b"]): document(rng, depth - 1) for _ in range(rng.randint(0, 4))}


def found(spark, documents):
    rows = spark.createDataFrame([(json.dumps(d, ensure_ascii=False),) for d in documents], "t string").coalesce(1)
    return [r.c for r in rows.select(F.expr(nested_text("t", KEYS)).alias("c")).collect()]


def test_search_equals_a_plain_walk(spark):
    rng = random.Random(3)
    documents = [{"z": document(rng, 5), "a": document(rng, 5), "m": document(rng, 6)} for _ in range(600)]
    assert found(spark, documents) == [plain(d) for d in documents]


def test_search_at_great_depth_and_order(spark):
    deep = {"command": "at the bottom"}
    for i in range(40):
        deep = {f"k{i}": [deep]} if i % 2 else {"text": "[{", f"k{i}": deep}
    last_first = {"b": {"command": "first written"}, "a": {"command": "last written"}}
    assert found(spark, [deep, last_first, {"args": []}, {"args": [None]}, {}, {"command": {"cmd": "inner"}}]) == ["at the bottom", "last written", "", None, None, "inner"]


def test_failed_command_five_levels_deep(spark):
    record = output(1, code=2)
    record["payload"]["detail"] = {"steps": [{"first": {"inner": {"argv": ["pnpm", "test"]}}}]}
    record["payload"].pop("call_id")
    parsed = rollout_records(spark, [record])
    rows = friction.command_issues(parsed, rollout.token_totals(parsed)).collect()
    assert [(r.command, r.category) for r in rows] == [("pnpm test", "filesystem")]
