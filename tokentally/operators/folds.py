"""Folds that must see the records of a key in order.

The next decision may depend on the last record that was *kept*, which no
window frame can state. Keys are cut into chunks; each chunk is folded in
order by a small Python step that streams over Arrow batches, and the state
at a chunk's end starts the next chunk. Chunks run in parallel on a guessed
start state; rounds repeat until no guess was wrong, so the result is that of
one pass in order. Most keys have one chunk and need no round at all.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentally.operators.scans import with_chunk
from tokentally.runtime import by_merge, parsed_once, reliable_checkpoint

# (state, row) -> (keep the row, new state); states are JSON values.
Step = Callable[[object, dict], tuple[bool, object]]
CHUNK = 1 << 18


def _folded(rows: DataFrame, key: list[str], order: str, step: Step, schema: T.StructType, ends: bool, close=None) -> DataFrame:
    """Stream chunks in order through ``step``: all rows with ``kept``, or the end state of each chunk.

    ``close(state, last row)`` may drop what no later chunk needs.
    """
    group = [*key, "_chunk"]
    names = [n for n in schema.names if n != "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(schema)
        current, state, last = None, None, None

        def end_row() -> dict:
            final = close(state, last) if close else state
            return {**{k: last[k] for k in group}, "_end": json.dumps(final)}

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                chunk_id = tuple(row[k] for k in group)
                if chunk_id != current:
                    if ends and last is not None:
                        out.append(end_row())
                    current = chunk_id
                    state = json.loads(row["_start"]) if row["_start"] else None
                kept, state = step(state, row)
                last = row
                if not ends:
                    out.append({**{n: row[n] for n in names}, "kept": kept})
            yield pa.RecordBatch.from_pylist(out, out_schema)
        if ends and last is not None:
            yield pa.RecordBatch.from_pylist([end_row()], out_schema)

    spread = rows.repartition(*group).sortWithinPartitions(*group, order)
    return spread.mapInArrow(run, schema)


def _end_states(rows: DataFrame, key: list[str], order: str, step: Step, close=None) -> DataFrame:
    fields = [rows.schema[k] for k in key] + [rows.schema["_chunk"], T.StructField("_end", T.StringType())]
    return _folded(rows, key, order, step, T.StructType(fields), ends=True, close=close)


def _start_states(rows: DataFrame, key: list[str], order: str, step: Step, close=None) -> DataFrame:
    """(key, chunk, start state) of the chunks that do not begin their key."""
    in_key = Window.partitionBy(*key).orderBy("_chunk")
    starts = None
    while True:
        if starts is None:
            entered = rows.withColumn("_start", F.lit(None).cast("string"))
        else:
            entered = rows.join(by_merge(starts.select(*key, "_chunk", "_start")), [*key, "_chunk"], "left")
        ends = _end_states(entered, key, order, step, close)
        following = ends.select(*key, "_chunk", F.lag("_end").over(in_key).alias("_start"))
        if starts is not None:
            following = following.join(by_merge(starts.select(*key, "_chunk", F.col("_start").alias("_guess"))), [*key, "_chunk"], "left")
            following = reliable_checkpoint(following.withColumn("_wrong", ~F.col("_start").eqNullSafe(F.col("_guess"))).drop("_guess"))
            if following.where("_wrong").limit(1).count() == 0:
                return following.select(*key, "_chunk", "_start")
            starts = following.drop("_wrong")
        else:
            starts = reliable_checkpoint(following)


def _chunked(rows: DataFrame, key: list[str], order: str, step: Step, chunk: int, close=None) -> DataFrame:
    """Rows with _chunk and _start. The rows are stored once, for each round and the last pass read them again."""
    cut = with_chunk(parsed_once(rows), order, chunk)
    long = cut.groupBy(*key).agg(F.min("_chunk").alias("_a"), F.max("_chunk").alias("_b")).where("_a < _b").select(*key)
    if long.limit(1).count() == 0:
        return cut.withColumn("_start", F.lit(None).cast("string"))
    starts = _start_states(cut.join(by_merge(long), key, "left_semi"), key, order, step, close)
    return cut.join(by_merge(starts), [*key, "_chunk"], "left")


def fold_rows(rows: DataFrame, key: list[str], order: str, step: Step, chunk: int = CHUNK, close=None) -> DataFrame:
    """All rows, with ``kept`` as decided by the step."""
    cut = _chunked(rows, key, order, step, chunk, close)
    schema = T.StructType([*rows.schema.fields, T.StructField("kept", T.BooleanType())])
    return _folded(cut, key, order, step, schema, ends=False)


def fold_states(rows: DataFrame, key: list[str], order: str, step: Step, chunk: int = CHUNK) -> DataFrame:
    """One row per key: the state after its last row, as JSON text."""
    cut = _chunked(rows, key, order, step, chunk)
    ends = _end_states(cut, key, order, step)
    return ends.groupBy(*key).agg(F.max_by("_end", "_chunk").alias("state"))


# ---------------------------------------------------------------- steps

SNAPSHOT = ["input", "cached", "write", "write_30m", "write_12h", "output", "reasoning", "total"]


def stale_snapshot_step(state: list | None, row: dict) -> tuple[bool, list | None]:
    """Drop a record whose cumulative snapshot repeats, or falls back from, the last kept one."""
    if row["snap_total"] is None:
        return True, state
    snapshot = [row[f"snap_{n}"] for n in SNAPSHOT]
    if state is not None:
        if snapshot == state:
            return False, state
        fell = any(snapshot[i] < state[i] for i in (0, 1, 2, 5, 6))
        if fell:
            previous, current = (s[0] + s[1] + s[5] + s[6] for s in (state, snapshot))
            last = row["input_tokens"] + row["cached_input_tokens"] + row["output_tokens"] + row["reasoning_tokens"]
            if previous > 0 and current > 0 and last > 0:
                near = current * 100 >= previous * 98
                small_step = current * 4 >= previous * 3 and current + last * 2 >= previous
                if near or small_step:
                    return False, state
    return True, snapshot


NEAR_MS = 5_000


def near_duplicate_step(state: dict | None, row: dict) -> tuple[bool, dict]:
    """Keep a message unless an equal one was kept within five seconds, or either has no time.

    The state holds kept times by five-second slot.
    """
    state = state or {"untimed": False, "slots": {}}
    at, slots = row["at_ms"], state["slots"]
    if state["untimed"] or (at is None and slots):
        return False, state
    if at is None:
        return True, {"untimed": True, "slots": {}}
    slot = at // NEAR_MS
    if any(abs(slots[s] - at) <= NEAR_MS for s in map(str, (slot - 1, slot, slot + 1)) if s in slots):
        return False, state
    slots[str(slot)] = at
    return True, state


def near_duplicate_close(state: dict, row: dict) -> dict:
    """Forget kept times that no message of a later chunk (from ``later_min`` on) can be near to."""
    if row["later_min"] is None:
        return state
    slots = {s: at for s, at in state["slots"].items() if at >= row["later_min"] - NEAR_MS}
    # An empty set would let an untimed message in; one kept time must remain known.
    return {**state, "slots": slots or dict(list(state["slots"].items())[-1:])}
