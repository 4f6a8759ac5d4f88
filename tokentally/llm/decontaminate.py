"""Documents that hold benchmark items: SimHash of item-sized windows, Hamming lookup, exact check.

An item of n words is compared with windows of n words; a text of fewer words is one window
as a whole. Words are compared without ASCII case, shingles have five words (an item of fewer
words is one shingle) and weigh as often as they occur. A window can reach the similarity only if enough of its positions begin a
shingle of some item, which a prefix sum over each text tells exactly. Such windows get a
64-bit SimHash: the weighted majority of their shingle hashes bit by bit, also from prefix
sums. Fingerprints are cut into eight blocks of eight bits; if two differ in at most 23 bits,
some block differs in at most two, so a table by block value finds every item within that
radius (pairs at similarity 0.8 differ in about ten bits). Each pair found is verified by the
weighted Jaccard similarity of its shingles.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.llm.common import U64, annotate, grouped_arange, span_hashes, stored, text_buffers, window_hashes, windows, word_spans

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS = 8
# Bytes of item texts that are sent to the executors for one pass over the documents.
PASS_BYTES = 16 << 20
# Shingles whose bit sums are held at once.
SPAN = 1 << 16
# Pairs of a window and an item that are looked at at once.
CANDIDATES = 1 << 20
_BITS = np.array([bin(x).count("1") for x in range(256)], np.uint8)
# The values of a block that differ from each value in at most RADIUS // BLOCKS bits.
NEAR_VALUES = np.array([np.flatnonzero(_BITS[np.arange(256) ^ v] <= RADIUS // BLOCKS) for v in range(256)])


def simhash(ones: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Eight bytes of each row: the bits that at least half of the votes set."""
    return np.packbits(2 * ones >= count[:, None], axis=1)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _BITS[a ^ b].sum(axis=-1, dtype=np.int64)


@dataclass
class Sized:
    """Items of one word count."""

    words: int
    items: np.ndarray
    prints: np.ndarray

    def __post_init__(self):
        # For each block, the items in the order of its value, and where each value begins.
        self.order = [np.argsort(self.prints[:, j], kind="stable") for j in range(BLOCKS)]
        self.first = [np.searchsorted(self.prints[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within_radius(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) whose fingerprints differ in at most RADIUS bits.

        Fingerprints that near differ in at most RADIUS // BLOCKS bits of some block, so each block is looked up under all
        values that near; a bounded number of candidates is held at once.
        """
        step = max(1, CANDIDATES // max(len(self.items), 1))
        out = [self._pairs(prints[lo : lo + step], lo) for lo in range(0, len(prints), step)] or [(np.zeros(0, np.int64),) * 2]
        return np.concatenate([w for w, _ in out]), np.concatenate([m for _, m in out])

    def _pairs(self, prints: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        seen = np.zeros(0, np.int64)
        for j in range(BLOCKS):
            values = NEAR_VALUES[prints[:, j]]
            begin, size = self.first[j][values].ravel(), (self.first[j][values + 1] - self.first[j][values]).ravel()
            window = np.repeat(np.repeat(np.arange(len(prints)), NEAR_VALUES.shape[1]), size)
            pair = window * len(self.items) + self.order[j][np.repeat(begin, size) + grouped_arange(size)]
            new = pair[distance(prints[window], self.prints[pair % len(self.items)]) <= RADIUS]
            seen = np.union1d(seen, new)
        return seen // len(self.items) + at, seen % len(self.items)


class Index:
    """Items whose shingles have ``shingle`` words."""

    def __init__(self, shingle: int, items: list[tuple[int, np.ndarray]]):
        """Items as (number, word hashes)."""
        self.shingle = shingle
        self.weights: dict[int, Counter] = {}
        owners, hashes = [], []
        by_size: dict[int, list] = {}
        for number, words in items:
            own = window_hashes(words, shingle)
            self.weights[number] = Counter(own.tolist())
            hashes.append(own)
            owners.append(np.full(len(own), len(words)))
            by_size.setdefault(len(words), []).append((number, simhash(_bits(own).sum(axis=0, keepdims=True, dtype=np.int64), np.array([len(own)]))[0]))
        hashes, sizes = np.concatenate(hashes), np.concatenate(owners)
        self.hashes = np.unique(hashes)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.hashes >> U64(44)).astype(np.int64)] = True
        # The word counts of the items that hold each shingle.
        pairs = np.unique(np.stack([np.searchsorted(self.hashes, hashes), sizes]), axis=1)
        self.size_first = np.searchsorted(pairs[0], np.arange(len(self.hashes) + 1))
        self.size_list = pairs[1]
        self.sized = {n: Sized(n, np.array([i for i, _ in group]), np.array([f for _, f in group])) for n, group in by_size.items()}

    def find(self, words: np.ndarray, first_word: np.ndarray, similarity: float) -> list[tuple[int, int, int, int, float]]:
        """(row, item, first word, words, similarity) of the best window for each row and item."""
        starts = windows(first_word, self.shingle)
        if not len(starts):
            return []
        all_hashes = window_hashes(words, self.shingle)
        hashes = all_hashes[starts]
        hit = np.flatnonzero(self.filter[(hashes >> U64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[hit]), len(self.hashes) - 1)
        exact = self.hashes[at] == hashes[hit]
        hit, at = hit[exact], at[exact]
        if not len(hit):
            return []
        row = np.searchsorted(first_word, starts[hit], "right") - 1
        # Windows over each hit, of every word count among the items that hold its shingle.
        n_sizes = self.size_first[at + 1] - self.size_first[at]
        size = self.size_list[np.repeat(self.size_first[at], n_sizes) + grouped_arange(n_sizes)]
        place, of = np.repeat(starts[hit], n_sizes), np.repeat(row, n_sizes)
        count = size - self.shingle + 1
        low = np.maximum(place - count + 1, first_word[of])
        high = np.minimum(place, first_word[of + 1] - size)
        flags = np.zeros(len(words) + 1, np.int32)
        flags[starts[hit] + 1] = 1
        hits_before = np.cumsum(flags)
        # Shared weight of at least s / (1 + s) of the weight of both sides.
        share = similarity / (1 + similarity)
        length = np.diff(first_word)
        chosen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(size).tolist():
            mine = size == n
            width = np.maximum(high[mine] - low[mine] + 1, 0)
            begin = np.unique(np.repeat(low[mine], width) + grouped_arange(width))
            total = n - self.shingle + 1
            # Texts of fewer words than the item are one window each.
            whole = np.unique(of[mine])
            whole = whole[length[whole] < n]
            begin = np.concatenate([begin, first_word[whole]])
            totals = np.concatenate([np.full(len(begin) - len(whole), total), length[whole] - self.shingle + 1])
            enough = hits_before[begin + totals] - hits_before[begin] >= share * (totals + total) - 1e-9
            if enough.any():
                chosen[n] = begin[enough], totals[enough]
        best: dict[tuple[int, int], tuple] = {}
        for n, (begin, totals) in chosen.items():
            step = max(1, SPAN // (n - self.shingle + 1))
            for lo in range(0, len(begin), step):
                part, total = begin[lo : lo + step], totals[lo : lo + step]
                needed = np.unique(np.repeat(part, total) + grouped_arange(total))
                sums = np.zeros((len(needed) + 1, 64), np.int64)
                np.cumsum(_bits(all_hashes[needed]), axis=0, out=sums[1:])
                place = np.searchsorted(needed, part)
                prints = simhash(sums[place + total] - sums[place], total)
                rows = np.searchsorted(first_word, part, "right") - 1
                for w, m in zip(*(x.tolist() for x in self.sized[n].within_radius(prints))):
                    number = int(self.sized[n].items[m])
                    value = self.similarity(all_hashes[part[w] : part[w] + total[w]], number)
                    key, start = (int(rows[w]), number), int(part[w] - first_word[rows[w]])
                    if value >= similarity - 1e-12 and (key not in best or (-value, start) < (-best[key][4], best[key][2])):
                        best[key] = (*key, start, int(total[w]) + self.shingle - 1, value)
        return list(best.values())

    def similarity(self, hashes: np.ndarray, item: int) -> float:
        mine, other = Counter(hashes.tolist()), self.weights[item]
        shared = sum(min(n, other[h]) for h, n in mine.items() if h in other)
        return shared / (len(hashes) + sum(other.values()) - shared)


def indexes(items: list[tuple[int, str]], shingle: int = SHINGLE) -> list[Index]:
    """Indexes by shingle length over (number, text)."""
    import pyarrow as pa

    data, offsets = text_buffers(pa.array([t or "" for _, t in items], pa.string()))
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(data, starts, ends, fold=True)
    by: dict[int, list] = {}
    for (number, _), a, b in zip(items, first[:-1], first[1:]):
        if b > a:
            by.setdefault(int(min(shingle, b - a)), []).append((number, words[a:b]))
    return [Index(k, group) for k, group in sorted(by.items())]


def mark_contaminated(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, text_column: str = "text", item_column: str = "item_id", item_text: str = "text", into: str = "benchmark_hits") -> DataFrame:
    """All rows and columns of ``documents`` with an array of the items each text holds.

    An entry has item_id, start_word, n_words and similarity of the best window; entries are
    sorted by item_id. A text of fewer words than an item is compared with it as a whole. Null and empty texts hold nothing, null and empty items are held by
    none, items that repeat are reported by each item_id. A column named ``into`` is replaced.
    Items go to the executors in blocks of bounded bytes, one pass over the documents each. With several passes, what
    one has found is stored before the next begins, so the driver and the executors hold the items of one pass alone.
    """
    items = benchmark.select(F.col(item_column).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // PASS_BYTES))
    kind = "array<struct<item_id: bigint, start_word: bigint, n_words: bigint, similarity: double>>"
    result = documents
    parts = []
    for p in range(passes):
        rows = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).collect()]
        names = [r[0] for r in rows]
        found_by = indexes([(i, t) for i, (_, t) in enumerate(rows)], shingle)

        def run(data, offsets, found_by=found_by, names=names, column=f"{into}{p}" if passes > 1 else into):
            starts, ends, first_word = word_spans(data, offsets)
            words = span_hashes(data, starts, ends, fold=True)
            out: list[list] = [[] for _ in range(len(offsets) - 1)]
            for index in found_by:
                for row, item, start, n, value in index.find(words, first_word, similarity):
                    out[row].append({"item_id": names[item], "start_word": start, "n_words": n, "similarity": value})
            return {column: out}

        parts.append(f"{into}{p}" if passes > 1 else into)
        result = annotate(result, text_column, run, f"`{parts[-1]}` {kind}")
        if passes > 1:
            result = stored(result)
    if passes > 1:
        result = result.withColumn(into, F.concat(*parts)).drop(*parts)
    return result.withColumn(into, F.array_sort(into))
