"""Roles of transcript lines by a hidden Markov model, and canonical turns.

A line is in one of six states: it begins or continues a turn of the system, the user or the
assistant. It shows three things, independent given the state: which speaker marker it starts
with, what stands before it (nothing, a blank line, a line), and its kind (blank, question,
short, other). Probabilities are counted on lines whose states are known. The most likely
states of a transcript are found by Viterbi's algorithm. Long transcripts are cut into chunks
of lines: a chunk is summed up by the best score between each state before it and each state
at its end, those small tables are chained for each transcript, and every chunk is then
decoded between the states that are known at its borders, so no task holds a whole transcript.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentally.llm.common import _arrow_schema, as_batch, stored

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)
# Names that transcripts give to the roles.
NAMES = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "question", "q", "instruction", "prompt", "me"),
    "assistant": ("assistant", "ai", "answer", "a", "response", "bot", "model"),
}
OTHER = len(ROLES) + 1
SHOWN = (OTHER + 1, 3, 4)
SHORT = 24
_ROLE_OF = {name: i + 1 for i, role in enumerate(ROLES) for name in NAMES[role]}
_MARK = re.compile(r"\s*(?:#{1,6}\s*|\*\*|<\|?|\[)?([A-Za-z]{1,14})(?:\*\*)?(?::\**|\|?>|\]:?)(?:\s+|$)")


def marker(line: str) -> tuple[int, int]:
    """Kind of speaker marker (0 none, 1 to 3 a role, 4 another name) and where the text begins."""
    found = _MARK.match(line)
    if not found:
        return 0, 0
    return _ROLE_OF.get(found[1].lower(), OTHER), found.end()


def shown(lines: list[str], before: str | None) -> np.ndarray:
    """What each line shows; ``before`` is the line in front of the first (None: none)."""
    result = np.zeros((len(lines), 3), np.int64)
    for i, line in enumerate(lines):
        text = line.strip()
        last = lines[i - 1] if i else before
        kind = 0 if not text else 1 if text.endswith("?") else 2 if len(text) < SHORT else 3
        result[i] = marker(line)[0], 0 if last is None else 1 if not last.strip() else 2, kind
    return result


class Markov:
    """Log probabilities of first states, of steps, and of what a line shows."""

    def __init__(self, first: np.ndarray, steps: np.ndarray, shows: list[np.ndarray]):
        """From counts; every possible event counts once more than it was seen."""
        # A transcript begins a turn, and a turn goes on with the role that began it.
        may_start = np.arange(STATES) % 2 == 0
        may_step = (np.arange(STATES)[None, :] % 2 == 0) | (np.arange(STATES)[None, :] // 2 == np.arange(STATES)[:, None] // 2)
        log = lambda n: np.where(n > 0, np.log(np.maximum(n, 1e-300)), -1e9)
        share = lambda n: n / n.sum(axis=-1, keepdims=True)
        self.first = log(share((first + 1) * may_start))
        self.steps = log(share((steps + 1) * may_step))
        self.shows = [log(share(s + 1.0)) for s in shows]

    def emission(self, seen: np.ndarray) -> np.ndarray:
        return sum(table[:, seen[:, i]].T for i, table in enumerate(self.shows))

    def summary(self, seen: np.ndarray) -> np.ndarray:
        """Best score from each state before these lines to each state of their last line."""
        score = np.where(np.eye(STATES, dtype=bool), 0.0, -1e18)
        for e in self.emission(seen):
            score = (score[:, :, None] + self.steps[None]).max(axis=1) + e
        return score

    def decode(self, seen: np.ndarray, before: np.ndarray | None, last: int | None) -> np.ndarray:
        """Most likely states from the scores in front of the lines (None: the transcript begins) to a known last state."""
        emission = self.emission(seen)
        back = np.zeros((len(seen), STATES), np.int64)
        score = self.first if before is None else None
        for i, e in enumerate(emission):
            if score is not None and i == 0:
                score = score + e
                continue
            options = (before if i == 0 else score)[:, None] + self.steps
            back[i] = options.argmax(axis=0)
            score = options.max(axis=0) + e
        path = np.zeros(len(seen), np.int64)
        path[-1] = int(score.argmax()) if last is None else last
        for i in range(len(seen) - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path


def _sequences(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that agree in the first columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def chunked(lines: DataFrame, span: int) -> DataFrame:
    """Lines with their chunk and the line before; rows of a null conv_id or line_no are left out."""
    known = lines.where("conv_id is not null and line_no is not null").withColumn("line", F.coalesce("line", F.lit("")))
    return known.withColumn("chunk", F.floor(F.col("line_no") / F.lit(span)).cast("long"))


def _by_chunk(lines: DataFrame) -> DataFrame:
    return lines.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "line_no", "line")


def with_borders(lines: DataFrame) -> DataFrame:
    """Add ``before``: the last line of the chunk in front, on the rows of each chunk (null in the first)."""
    ends = lines.groupBy("conv_id", "chunk").agg(F.max(F.struct("line_no", "line")).alias("e"))
    earlier = F.lag("e").over(Window.partitionBy("conv_id").orderBy("chunk"))
    borders = ends.select("conv_id", "chunk", earlier.getField("line").alias("before"), earlier.isNull().alias("opens"))
    return lines.join(borders, ["conv_id", "chunk"])


def fit(lines: DataFrame, span: int) -> Markov:
    """Count over all lines with a known state: columns conv_id, line_no, line, state (0 to 5, null: unknown).

    The counts (a few dozen numbers) come to the driver. The step into a chunk's first line
    is not counted.
    """
    ddl = "what int, a int, b int, n long"
    schema = _arrow_schema(lines.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, steps = np.zeros(STATES), np.zeros((STATES, STATES))
        shows = [np.zeros((STATES, n)) for n in SHOWN]
        for _, rows in _sequences(batches, 2):
            states = np.array([-1 if r[2] is None else r[2] for r in rows])
            seen = shown([r[0] for r in rows], None if rows[0][3] else rows[0][1])
            known = states >= 0
            if known[0]:
                first[states[0]] += rows[0][3]
            both = known[:-1] & known[1:]
            np.add.at(steps, (states[:-1][both], states[1:][both]), 1)
            for i, table in enumerate(shows):
                np.add.at(table, (states[known], seen[known, i]), 1)
        found = [(what, a, b, int(table[a, b])) for what, table in enumerate([first[None], steps, *shows]) for a, b in zip(*np.nonzero(table))]
        if found:
            yield as_batch(dict(zip(("what", "a", "b", "n"), zip(*found))), schema)

    rows = _by_chunk(with_borders(chunked(lines, span))).select("conv_id", "chunk", "line", "before", "state", "opens")
    tables = [np.zeros((1, STATES)), np.zeros((STATES, STATES)), *(np.zeros((STATES, n)) for n in SHOWN)]
    for r in rows.mapInArrow(run, ddl).groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect():
        tables[r["what"]][r["a"], r["b"]] = r["n"]
    return Markov(tables[0][0], tables[1], tables[2:])


def states(lines: DataFrame, model: Markov, span: int) -> DataFrame:
    """Lines with chunk and the most likely state."""
    spark = lines.sparkSession
    rows = stored(with_borders(chunked(lines.select("conv_id", "line_no", "line"), span)))
    narrow = _by_chunk(rows).select("conv_id", "chunk", "line", "before", "opens")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, chunk), part in _sequences(batches, 2):
            seen = shown([r[0] for r in part], None if part[0][2] else part[0][1])
            if part[0][2]:
                score = model.first + model.emission(seen[:1])[0]
                table = score[None] if len(seen) == 1 else (score[:, None] + model.summary(seen[1:])).max(axis=0)[None]
            else:
                table = model.summary(seen)
            yield as_batch({"conv_id": [conv], "chunk": [chunk], "score": [table.reshape(-1).tolist()]}, sum_schema)

    sum_schema = _arrow_schema(spark, "conv_id long, chunk long, score array<double>")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A transcript has one row here for each chunk of its lines.
        for (conv,), part in _sequences(batches, 1):
            tables = [np.array(r[1]).reshape(-1, STATES) for r in part]
            scores = [tables[0][0]]
            for t in tables[1:]:
                scores.append((scores[-1][:, None] + t).max(axis=0))
            last = [int(scores[-1].argmax())]
            for before, t in zip(scores[-2::-1], tables[:0:-1]):
                last.insert(0, int((before + t[:, last[0]]).argmax()))
            yield as_batch({"conv_id": [conv] * len(part), "chunk": [r[0] for r in part], "score": [None, *(s.tolist() for s in scores[:-1])], "last": last}, chain_schema)

    chain_schema = _arrow_schema(spark, "conv_id long, chunk long, score array<double>, last int")
    summed = narrow.mapInArrow(sums, "conv_id long, chunk long, score array<double>")
    borders = summed.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(chain, "conv_id long, chunk long, score array<double>, last int")
    told = _by_chunk(rows.join(stored(borders), ["conv_id", "chunk"])).select("conv_id", "chunk", "line", "before", "opens", "score", "last", "line_no")
    out_schema = _arrow_schema(spark, "conv_id long, chunk long, line_no long, line string, state int")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, chunk), part in _sequences(batches, 2):
            seen = shown([r[0] for r in part], None if part[0][2] else part[0][1])
            path = model.decode(seen, None if part[0][3] is None else np.array(part[0][3]), part[0][4])
            yield as_batch({"conv_id": [conv] * len(part), "chunk": [chunk] * len(part), "line_no": [r[5] for r in part], "line": [r[0] for r in part], "state": path}, out_schema)

    return told.mapInArrow(decode, "conv_id long, chunk long, line_no long, line string, state int")


def _role(state: Column) -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in ROLES]), (state / 2).cast("int") + 1)


def turns(lines: DataFrame, model: Markov, span: int = 512) -> DataFrame:
    """conv_id, turn, role, text and rendered for each turn that the model finds in (conv_id, line_no, line).

    Turns count from 0 in each transcript. The marker of a turn's first line and blank lines
    at its ends are left out; ``rendered`` is the canonical form. Null lines are blank, lines
    of a null conv_id or line_no are left out, lines with equal numbers stand in the order of
    their texts, and an empty table has no turns. Other columns are ignored.
    """
    found = stored(states(lines, model, span))
    begins = found.groupBy("conv_id", "chunk").agg(F.sum(F.when(F.col("state") % 2 == 0, 1).otherwise(0)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = begins.select("conv_id", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("line_no", "line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.sum(F.when(F.col("state") % 2 == 0, 1).otherwise(0)).over(inside)
    placed = found.withColumn("number", number).join(base, ["conv_id", "chunk"]).withColumn("turn", F.col("base") + F.col("number") - 1)
    strip = F.when(F.col("state") % 2 == 0, F.regexp_replace("line", "^" + _MARK.pattern, "")).otherwise(F.col("line"))
    grouped = placed.groupBy("conv_id", "turn").agg(F.max(_role(F.col("state"))).alias("role"), F.sort_array(F.collect_list(F.struct("line_no", strip.alias("line")))).alias("lines"))
    text = F.regexp_replace(F.array_join(F.col("lines.line"), "\n"), r"^(?:[ \t\r]*\n)+|\s+$", "")
    return grouped.select("conv_id", "turn", "role", text.alias("text")).withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n")))


# Ways in which transcripts mark the three roles.
STYLES = (("System: ", "User: ", "Assistant: "), ("System: ", "Human: ", "AI: "), ("Context: ", "Q: ", "A: "), ("### Instructions: ", "### Prompt: ", "### Response: "), ("[system] ", "[user] ", "[assistant] "))
# Lines of a chunk, and turns whose lines are numbered together.
SPAN, TURNS = 512, 64


def transcript_lines(conversations: DataFrame) -> DataFrame:
    """Lines with known states of transcripts written from (conv_id, turn, role, text).

    Each conversation has one of the styles. One later turn in eight has no marker and stands
    after a blank line. A turn of any other role is written with that role's name in front, one without a role with nothing; the
    states of their lines are unknown (null). Null texts are empty; a null turn counts as 0. Turns with one number stand one
    after another, by role and text, and repeated rows are repeated turns. Lines are numbered from 0 without gaps. Rows without a conv_id belong to no transcript.
    """
    role = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.lower("role")).cast("int") - 1
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.coalesce(F.trim("role"), F.lit("")).alias("role"),
        F.when(role >= 0, role).alias("r"), F.coalesce("text", F.lit("")).alias("text"),
    ).where("conv_id is not null")
    style = F.get(F.array(*[F.array(*[F.lit(m) for m in s]) for s in STYLES]), F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int"))
    bare = (F.col("turn") > 0) & (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0) & F.col("r").isNotNull()
    name = F.when(F.col("r").isNotNull(), F.get(style, F.col("r"))).when(F.col("role") != "", F.concat(F.initcap("role"), F.lit(": "))).otherwise("")
    body = F.split(F.concat(F.when(bare, F.lit("")).otherwise(name), "text"), "\n", -1)
    sized = rows.withColumns({"bare": bare, "body": body}).withColumn("n", F.size("body") + F.col("bare").cast("int")).withColumn("block", F.floor(F.col("turn") / TURNS).cast("long"))
    # Lines before a turn: those of earlier blocks of turns, and of earlier turns of its own block.
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    totals = sized.groupBy("conv_id", "block").agg(F.sum("n").alias("total"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.select("conv_id", "block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    marked = sized.withColumns({"own": F.coalesce(F.sum("n").over(upto), F.lit(0)), "last": F.lag("r").over(inside)}).join(blocks, ["conv_id", "block"]).withColumn("line_no", F.col("base") + F.col("own"))
    own = marked.select("conv_id", "r", (F.col("line_no") + F.col("bare").cast("int")).alias("line_no"), F.posexplode("body").alias("pos", "line")).select(
        "conv_id", (F.col("line_no") + F.col("pos")).alias("line_no"), "line", (F.col("r") * 2 + F.when(F.col("pos") > 0, 1).otherwise(0)).alias("state")
    )
    # A blank line in front belongs to the turn before it.
    gaps = marked.where("bare").select("conv_id", "line_no", F.lit("").alias("line"), (F.coalesce("last", F.col("r")) * 2 + 1).alias("state"))
    return own.union(gaps)
