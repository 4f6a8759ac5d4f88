"""Stretches of words that repeat with one period, by online dyadic square catching.

Words are appended to a text one after another. Whenever a block of 2^k words is complete, a
catcher is made for it. It waits for its words to come again at a distance of 2^k to 2^(k+1) - 1,
the periods of its level. Blocks of a level follow each other without a gap, so each appended word,
as the end of the last 2^k words, meets exactly one live catcher of each level. One comparison of
dyadic hashes tells whether that catcher has caught a square with this period. Catches of neighbouring
blocks at one period merge into a stretch of equal words that far apart; its two ends, each shorter than a block,
grow by suffix comparisons of half the length each time, down to single words.

A run at four times its period or more holds at least two neighbouring blocks of its period's
level, so none is missed. A run found again at a multiple of its period has the same ends; the
smallest period stays. All texts of a block of rows are appended in step, level by level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.llm.common import U64, blocks, grouped_arange, map_arrow, mix, span_hashes, word_spans
from tokentally.llm.substring_dedup import joined_words, string_array

MIN_EXPONENT, MIN_LENGTH = 4, 6
_JOIN = U64(0x9E3779B97F4A7C15)


class _Level:
    """Hashes of 2^k words from each place on, for the texts that are long enough."""

    def __init__(self, size: int, rows: np.ndarray, counts: np.ndarray, hashes: np.ndarray, texts: int):
        self.size, self.rows, self.counts, self.hashes = size, rows, counts, hashes
        self.first = np.cumsum(counts) - counts
        self.at = np.zeros(texts, np.int64)
        self.at[rows] = self.first

    def doubled(self, exponent: int, texts: int) -> _Level:
        """The next level; texts that hold no run of its periods are left out."""
        size = 2 * self.size
        long = self.counts >= exponent * size
        keep = np.repeat(self.first[long], self.counts[long]) + grouped_arange(self.counts[long])
        ahead = np.minimum(keep + self.size, len(self.hashes) - 1)
        # Hashes that reach beyond their text are never compared.
        hashes = mix(self.hashes[keep] * _JOIN + self.hashes[ahead])
        return _Level(size, self.rows[long], self.counts[long], hashes, texts)

    def caught(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, period and block of every catch, blocks of a text and period in order."""
        place = grouped_arange(self.counts)
        block = place // self.size - 1
        first = np.repeat(self.first, self.counts)
        live = np.flatnonzero((block >= 0) & (place + self.size <= np.repeat(self.counts, self.counts)))
        hit = live[self.hashes[first[live] + place[live]] == self.hashes[first[live] + block[live] * self.size]]
        row = np.repeat(self.rows, self.counts)[hit]
        period = place[hit] - block[hit] * self.size
        order = np.lexsort((block[hit], period, row))
        return row[order], period[order], block[hit][order]


def _grown(levels: list[_Level], row: np.ndarray, low: np.ndarray, high: np.ndarray, period: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the stretch low..high of words equal to those a period later, moved outwards as far as they go."""
    low, high = low.copy(), high.copy()
    for level in reversed(levels):
        base, size = level.at[row], level.size
        # A level holds a text only up to its last period, but longer steps are not needed there.
        at = np.minimum(base + high, len(level.hashes) - 1)
        other = np.minimum(base + high + period, len(level.hashes) - 1)
        high += size * ((high + period + size <= count) & (level.hashes[at] == level.hashes[other]))
        start = np.maximum(low - size, 0)
        low -= size * ((low >= size) & (level.hashes[base + start] == level.hashes[base + start + period]))
    return low, high


def runs_of(words: np.ndarray, first_word: np.ndarray, exponent: int = MIN_EXPONENT, least: int = MIN_LENGTH) -> tuple[np.ndarray, ...]:
    """Text, start, length and period of all runs of texts given as hashed words, by text, start and period."""
    texts = len(first_word) - 1
    counts = np.diff(first_word).astype(np.int64)
    long = np.flatnonzero(counts >= max(exponent, least))
    keep = np.repeat(first_word[long], counts[long]) + grouped_arange(counts[long])
    level = _Level(1, long, counts[long], words[keep], texts)
    levels, found = [], [np.zeros((0, 4), np.int64)]
    while len(level.rows):
        row, period, block = level.caught()
        # Neighbouring blocks caught at one period are one stretch.
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (period[1:] != period[:-1]) | (block[1:] != block[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(row))[: len(begin)] - 1
        many = end > begin
        begin, end = begin[many], end[many]
        row, period, count = row[begin], period[begin], counts[row[begin]]
        low, high = _grown(levels, row, block[begin] * level.size, (block[end] + 1) * level.size, period, count)
        length = high - low + period
        kept = length >= np.maximum(least, exponent * period)
        found.append(np.stack([row, low, length, period], 1)[kept])
        levels.append(level)
        level = level.doubled(exponent, texts)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    again = np.zeros(len(runs), bool)
    again[1:] = (runs[1:, :3] == runs[:-1, :3]).all(1)
    runs = runs[~again]
    runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2], runs[:, 3]


def repeated_words(first_word: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words lie in a run after its first period."""
    edge = np.zeros(int(first_word[-1]) + 1, np.int64)
    np.add.at(edge, first_word[row] + start + period, 1)
    np.add.at(edge, first_word[row] + start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def find_runs(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", exponent: int = MIN_EXPONENT, least: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start, then period) and collapsed, for every row.

    Words are runs without ASCII white space, compared as they are. A run has at least ``least``
    words and ``exponent`` (4 or more) times its smallest period, and ends where the next word differs from the
    one a period away. ``collapsed`` has the words that lie in no run after its first period, joined by one
    space. A null or empty text has no words and no runs, and collapses to an empty string. A row with a null id, and each of several
    rows with one id or one text, has a result of its own. Other columns are ignored. A text is
    held whole in the task that reads its row, at 8 bytes for each word and level.
    """
    if exponent < MIN_EXPONENT:
        raise ValueError("a run below four times its period may hold a single block")
    source = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    of_run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batch):
        for lo, hi, data, offsets in blocks(batch.column(1)):
            starts, ends, first_word = word_spans(data, offsets)
            row, start, length, period = runs_of(span_hashes(data, starts, ends), first_word, exponent, least)
            gone = repeated_words(first_word, row, start, length, period)
            of = np.repeat(np.arange(hi - lo), np.diff(first_word))
            fields = [pa.array(np.ascontiguousarray(v), pa.int64()) for v in (start, length, period)]
            at = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
            yield {
                "doc_id": batch.column(0).slice(lo, hi - lo), "n_words": np.diff(first_word),
                "runs": pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(fields, fields=list(of_run))),
                "collapsed": string_array(*joined_words(data, starts[~gone], ends[~gone], of[~gone], hi - lo)),
            }

    kind = source.schema["doc_id"].dataType.simpleString()
    return map_arrow(source, run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_periods(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and text, with a period written into the texts whose hashed id is a multiple of ten.

    With h the CRC-32 of the decimal id, g = h div 10 and n words, the words from a = g mod n on
    repeat the first 1 + (n - a) div (3 + g mod 8) of them. Such texts come back with single spaces; all
    others, and rows with a null id or no words, as they are.
    """
    digest = F.crc32(F.col(id_column).cast("long").cast("string").cast("binary"))
    source = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.coalesce(digest, F.lit(1)).alias("h"))

    def run(batch):
        hashed = batch.column(2).to_numpy(zero_copy_only=False)
        chosen = pa.array(hashed % 10 == 0)
        texts = batch.column(1).filter(chosen)
        parts = [string_array(np.zeros(0, np.uint8), np.zeros(1, np.int64))]
        g = hashed[hashed % 10 == 0] // 10
        for lo, hi, data, offsets in blocks(texts):
            starts, ends, first_word = word_spans(data, offsets)
            n = np.diff(first_word)
            a = g[lo:hi] % np.maximum(n, 1)
            period = 1 + (n - a) // (3 + g[lo:hi] % 8)
            place = grouped_arange(n)
            of = np.repeat(np.arange(hi - lo), n)
            from_word = first_word[:-1][of] + np.where(place < a[of], place, a[of] + (place - a[of]) % period[of])
            parts.append(string_array(*joined_words(data, starts[from_word], ends[from_word], of, hi - lo)))
        made = pa.compute.if_else(texts.is_null(), None, pa.concat_arrays(parts))
        yield {"doc_id": batch.column(0), "text": pa.compute.replace_with_mask(batch.column(1), chosen, made)}

    return map_arrow(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")
