"""Packed matrices of token ids with cumulative segment lengths and position resets.

Tasks tokenize their rows and pack them by best fit decreasing, a bounded number of tokens at
a time; overlong documents are first cut into full windows without loss. Windows that stay
almost full are finished in the task, so their ids never move. The pieces of the others wait
for the next buffer, and what a task has left at its end is packed once more over all tasks
from the counts by length. Ids are written as 16-bit numbers where the vocabulary allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.llm.common import _arrow_schema, as_batch, blocks, grouped_arange, stored
from tokentally.llm.packing import END_ID, WINDOW, assign, cut, encoder, place, placements
from tokentally.llm.tokens import with_end

# Tokens that a task packs at once.
BUFFER = 4 << 20
# Windows with more padding than one part in this many are packed once more.
LOOSE = 64
COLUMNS = "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, starts array<long>"


def _lists(first: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))


def rows_of(sequence: np.ndarray, offset: np.ndarray, doc: pa.Array, start: np.ndarray, length: np.ndarray, begin: np.ndarray, ids: np.ndarray, window: int, pad: int) -> dict:
    """Columns without sequence_id for pieces (ids from ``begin`` on); rows in the order of the sequence numbers."""
    order = np.lexsort((offset, sequence))
    sequence, offset, start, length, begin = (x[order] for x in (sequence, offset, start, length, begin))
    used, row = np.unique(sequence, return_inverse=True)
    matrix = np.full((len(used), window), pad, ids.dtype)
    inner = grouped_arange(length)
    matrix.reshape(-1)[np.repeat(row * window + offset, length) + inner] = ids[np.repeat(begin, length) + inner]
    first = np.searchsorted(row, np.arange(len(used) + 1))
    filled = np.bincount(row, length, len(used)).astype(np.int64)
    # Segment borders: the offsets of a row and its end.
    at_end = np.insert(offset, first[1:], filled)
    raw = matrix.astype(matrix.dtype.newbyteorder("<")).tobytes()
    width = window * matrix.itemsize
    return {
        "n_tokens": filled, "ids": [raw[i * width : (i + 1) * width] for i in range(len(used))],
        "cu_seqlens": _lists(first + np.arange(len(first)), at_end, pa.int32()), "position_resets": _lists(first, offset, pa.int32()),
        "doc_ids": _lists(first, doc.take(pa.array(order)), pa.int64()), "starts": _lists(first, start, pa.int64()),
    }


def ranks_by_length(length: np.ndarray) -> np.ndarray:
    order = np.argsort(length, kind="stable")
    _, n = np.unique(length, return_counts=True)
    rank = np.empty(len(length), np.int64)
    rank[order] = grouped_arange(n)
    return rank


def packed_sequences(documents: DataFrame, tokenizer: str, vocabulary: int, window: int = WINDOW, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each window: sequence_id, n_tokens, ids, cu_seqlens, position_resets, doc_ids and starts.

    ``ids`` is a row of the id matrix, little-endian numbers of 16 bits (32 above a vocabulary
    of 65,536), padded with ``end_id``. Segment i takes the ids from cu_seqlens[i] to
    cu_seqlens[i + 1], belongs to doc_ids[i] and starts at token starts[i] of it; positions
    count from 0 at each reset. Sequence ids are distinct, not dense. Null and empty texts are
    the end id alone, rows that repeat are packed each, other columns are ignored.
    """
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    ddl = COLUMNS + ", piece_doc long, piece_start long, piece_length long"
    schema = _arrow_schema(documents.sparkSession, ddl)
    names = [f.name for f in schema]

    def batch_of(columns: dict, n: int) -> pa.RecordBatch:
        return as_batch({f.name: columns.get(f.name, pa.nulls(n, f.type)) for f in schema}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        held: list[tuple] = []

        def packed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            sizes = [len(h[4]) for h in held]
            ids = np.concatenate([h[4] for h in held])
            doc = pa.concat_arrays([h[0] for h in held])
            start, length = (np.concatenate([h[i] for h in held]) for i in (1, 2))
            begin = np.concatenate([h[3] + b for h, b in zip(held, np.cumsum([0, *sizes[:-1]]))])
            values, n = np.unique(length, return_counts=True)
            table, windows = placements(dict(zip(values.tolist(), n.tolist())), window)
            sequence, offset = place(table, length, ranks_by_length(length))
            loose = window - np.bincount(sequence, length, windows) > window // LOOSE
            closed = np.flatnonzero(~loose[sequence])
            for lo in range(0, windows, 512):
                part = closed[(sequence[closed] >= lo) & (sequence[closed] < lo + 512)]
                if len(part):
                    rows = rows_of(sequence[part], offset[part], doc.take(pa.array(part)), start[part], length[part], begin[part], ids, window, end_id)
                    count = len(rows["ids"])
                    rows["sequence_id"] = (np.int64(TaskContext.get().partitionId()) << 36) + made + np.arange(count)
                    made += count
                    yield batch_of(rows, count)
            rest = np.flatnonzero(loose[sequence])
            held = []
            if len(rest):
                own = ids[np.repeat(begin[rest], length[rest]) + grouped_arange(length[rest])]
                at = np.cumsum(length[rest]) - length[rest]
                if not last:
                    held = [(doc.take(pa.array(rest)), start[rest], length[rest], at, own)]
                    return
                raw, width = own.astype(own.dtype.newbyteorder("<")).tobytes(), own.itemsize
                yield batch_of({"ids": [raw[a * width : (a + n) * width] for a, n in zip(at.tolist(), length[rest].tolist())], "piece_doc": doc.take(pa.array(rest)), "piece_start": start[rest], "piece_length": length[rest]}, len(rest))

        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)) if batch.num_rows else ():
                found, at = with_end(*encoder(tokenizer)(data, offsets), end_id)
                row, start, length = cut(at, window)
                held.append((batch.column(0).slice(lo, hi - lo).take(pa.array(row)), start, length, at[row] + start, found.astype(kind)))
                if sum(len(h[4]) for h in held) >= BUFFER:
                    yield from packed(False)
        if held:
            yield from packed(True)

    source = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    first = stored(source.mapInArrow(run, ddl))
    finished = first.where("sequence_id is not null").select(*names[:-3])
    pieces = first.where("sequence_id is null").select(F.col("piece_doc").alias("doc_id"), F.col("piece_start").alias("start"), F.col("piece_length").alias("length"), "ids")
    together = assign(pieces, window).repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    final = _arrow_schema(documents.sparkSession, COLUMNS)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def rows(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            sequence, offset, start, length = (table.column(c).to_numpy() for c in ("sequence_id", "offset", "start", "length"))
            ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.dtype(kind).newbyteorder("<")).astype(kind)
            columns = rows_of(sequence, offset, table.column("doc_id").combine_chunks(), start, length, np.cumsum(length) - length, ids, window, end_id)
            # Above all numbers that tasks give.
            return as_batch(columns | {"sequence_id": np.unique(sequence) + (1 << 62)}, final)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                table = pa.Table.from_batches(held)
                sequence = table.column("sequence_id").to_numpy()
                whole = int(np.searchsorted(sequence, sequence[-1]))
                if whole:
                    yield rows(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield rows(pa.Table.from_batches(held))

    return finished.union(together.mapInArrow(join, COLUMNS))


def position_ids(cu_seqlens: list[int]) -> np.ndarray:
    """Positions of the tokens of one sequence, from 0 in each segment."""
    return grouped_arange(np.diff(cu_seqlens))
