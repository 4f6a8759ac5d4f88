"""Best-fit-decreasing packing of token pieces into fixed windows.

Overlong documents are first cut into full windows, so every piece has between 1 and
``window`` tokens and a corpus of any size is described by at most ``window`` counts. Best
fit decreasing runs on those counts: a segment tree indexed by remaining capacity finds the
tightest open window for the next length, and a whole run of equal pieces is placed at once.
The result is the same packing that the piece-by-piece algorithm makes, and it is a short
list of placements (length, ranks, first window, offset). Pieces find their place from the
rank they have among the pieces of their length, which Spark counts in salted groups.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokentally.llm.common import blocks, grouped_arange, map_arrow, stored
from tokentally.llm.tokens import WordEncoder, with_end

WINDOW = 4096
END_ID = 2
# Pieces of a numbered group on average, and the most groups that one length is dealt to.
RANKED_ROWS, MOST_SALTS = 1000, 4096


class CapacityTree:
    """Which remaining capacities have an open window; ``tightest(n)`` is the smallest that holds n."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.full = [False] * (2 * self.size)

    def put(self, capacity: int, present: bool) -> None:
        node = capacity + self.size
        self.full[node] = present
        while node > 1:
            node >>= 1
            self.full[node] = self.full[2 * node] or self.full[2 * node + 1]

    def tightest(self, need: int) -> int | None:
        node = need + self.size
        if self.full[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.full[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.size:
            node = 2 * node if self.full[2 * node] else 2 * node + 1
        return node - self.size


def placements(counts: dict[int, int], window: int = WINDOW) -> tuple[np.ndarray, int]:
    """Best fit decreasing on counts by length.

    Rows (length, first rank, end rank, first window, pieces in each window, offset), by
    length and rank; and the number of windows.
    """
    tree = CapacityTree(window)
    open_windows: dict[int, list[tuple[int, int]]] = {}
    rows, used = [], 0

    def add(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_windows.setdefault(capacity, []).append((first, n))
            tree.put(capacity, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 1 <= length <= window:
            raise ValueError(f"a piece of {length} tokens does not fit a window of {window}")
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity = window
                first, n = used, -(-left // (window // length))
                used += n
            else:
                first, n = open_windows[capacity].pop()
                if not open_windows[capacity]:
                    tree.put(capacity, False)
            each = capacity // length
            whole = min(n, left // each)
            if whole:
                rows.append((length, rank, rank + whole * each, first, each, window - capacity))
                rank += whole * each
                left -= whole * each
                add(capacity - whole // whole * each * length, first, whole)
            if whole < n and left:
                rows.append((length, rank, rank + left, first + whole, left, window - capacity))
                add(capacity - left * length, first + whole, 1)
                whole, left = whole + 1, 0
            if whole < n:
                add(capacity, first + whole, n - whole)
    table = np.array(rows, np.int64).reshape(-1, 6)
    return table[np.lexsort((table[:, 1], table[:, 0]))], used


def place(table: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of pieces from their length and their rank among pieces of that length."""
    key = (table[:, 0] << 44) | table[:, 1]
    row = table[np.searchsorted(key, (lengths << 44) | ranks, "right") - 1]
    k = ranks - row[:, 1]
    return row[:, 3] + k // row[:, 4], row[:, 5] + k % row[:, 4] * lengths


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cut(offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of the pieces of rows of ids: full windows, then the rest."""
    sizes = np.diff(offsets)
    n = -(-sizes // window)
    row = np.repeat(np.arange(len(sizes)), n)
    start = grouped_arange(n) * window
    return row, start, np.minimum(sizes[row] - start, window)


def token_pieces(documents: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of at most ``window`` ids: doc_id, start, length, ids (little-endian uint32), doc_tokens.

    A null text is an empty one. Every row of the input is a document of its own.
    """

    def run(batch):
        keys = batch.column(0)
        for lo, hi, data, offsets in blocks(batch.column(1)):
            ids, at = with_end(*encoder(tokenizer)(data, offsets), end_id)
            row, start, length = cut(at, window)
            raw = ids.astype("<u4").tobytes()
            begin = (at[row] + start) * 4
            yield {
                "doc_id": keys.slice(lo, hi - lo).take(_array(row)), "start": start, "length": length,
                "ids": [raw[b:e] for b, e in zip(begin.tolist(), (begin + length * 4).tolist())], "doc_tokens": np.diff(at)[row],
            }

    source = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return map_arrow(source, run, "doc_id long, start long, length long, ids binary, doc_tokens long")


def _array(values):
    import pyarrow as pa

    return pa.array(values)


def assign(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, start and length (1 to ``window``).

    The counts by length (at most ``window`` rows) come to the driver and the placements,
    whose number depends on the window alone, go out with the tasks. Rows are numbered within
    (length, salt); the salts grow with the rows, so a length that a third of all pieces have
    is spread evenly. Rows that are equal in all columns keep places of their own.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table, _ = placements(counts, window)
    salts = min(MOST_SALTS, max(1, -(-sum(counts.values()) // RANKED_ROWS)))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start")) - 1
    ranked = salted.withColumn("rank", rank.cast("long")).join(base, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base")).drop("salt", "base")
    names = pieces.columns

    def run(batch):
        sequence, offset = place(table, batch.column("length").to_numpy().astype(np.int64), batch.column("rank").to_numpy().astype(np.int64))
        yield {n: batch.column(n) for n in names} | {"sequence_id": sequence, "offset": offset}

    kinds = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return map_arrow(ranked.select(*names, "rank"), run, f"{kinds}, sequence_id long, offset long")


def pack(documents: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pack whole documents: (places, pieces).

    ``places`` has doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each
    piece; ``pieces`` has the ids themselves under the same doc_id and start. Empty and null
    texts are the end id alone; an empty table gives empty tables. Columns of the input other
    than the two named are not looked at, whatever their names.
    """
    pieces = stored(token_pieces(documents, tokenizer, window, end_id, id_column, text_column))
    narrow = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return assign(narrow, window), pieces
