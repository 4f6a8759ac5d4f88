"""Token ids of whole texts by a given tokenizer file."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

from tokentally.llm.common import grouped_arange, span_hashes, word_spans


MARK = "\x01"
SPECIAL = b"<|"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True


class WordEncoder:
    """Ids of texts by a tokenizer that lowers case, drops white space and never joins letters to what follows them.

    Such a tokenizer treats each run between white space alone, and a run is also cut where
    ASCII punctuation follows an ASCII letter. Each distinct piece, whatever its ASCII case,
    is given to the library once and its ids are kept (at most ``keep`` pieces; then the store
    starts anew). Texts that may hold the string of a special token go to the library whole.
    """

    def __init__(self, path: str, keep: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        (self.mark,) = self.library.encode(MARK, add_special_tokens=False).ids
        self.keep = keep
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        # Pieces go in groups with a mark after each, which is a token of its own.
        groups = [f" {MARK} ".join([*texts[i : i + 256], ""]) for i in range(0, len(texts), 256)]
        found = [e.ids for e in self.library.encode_batch_fast(groups, add_special_tokens=False)]
        ids = np.fromiter((i for part in found for i in part), np.uint32, sum(map(len, found)))
        marks = np.flatnonzero(ids == self.mark)
        counts = np.diff(marks, prepend=-1) - 1
        total = len(ids) - len(marks)
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(total, len(self.pool)), np.uint32)])
        self.pool[self.used : self.used + total] = np.delete(ids, marks)
        first = self.used + np.cumsum(counts) - counts
        self.used += total
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.first = np.insert(self.first, at, first[order])
        self.count = np.insert(self.count, at, counts[order])

    def _whole(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])]
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = [len(ids) for ids in found]
        return np.fromiter((i for ids in found for i in ids), np.uint32, sum(sizes)), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and the offset of each row's first id."""
        raw = data.tobytes()
        if SPECIAL in raw or MARK.encode() in raw:
            return self._by_row(raw, data, offsets)
        starts, ends, first_word = word_spans(data, offsets, _LETTER, _PUNCTUATION)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        codes, unique = pd.factorize(span_hashes(data, starts, ends, fold=True))
        if len(self.keys) > self.keep:
            self.clear()
        at = np.searchsorted(self.keys, unique)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == unique[known]
        if not known.all():
            example = np.zeros(len(unique), np.int64)
            example[codes[::-1]] = np.arange(len(codes))[::-1]
            new = np.flatnonzero(~known)
            self._learn(unique[new], [raw[starts[i] : ends[i]].decode() for i in example[new]])
            at = np.searchsorted(self.keys, unique)
        counts = self.count[at][codes]
        ids = self.pool[np.repeat(self.first[at][codes], counts) + grouped_arange(counts)]
        before = np.concatenate([[0], np.cumsum(counts)])
        return ids, before[first_word]

    def _by_row(self, raw: bytes, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of ordinary rows by piece, rows with a special string or the mark by the library."""
        odd = [SPECIAL in raw[a:b] or MARK.encode() in raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        ids, sizes, lo = [], [], 0
        for hi in range(1, len(odd) + 1):
            if hi == len(odd) or odd[hi] != odd[lo]:
                part = offsets[lo : hi + 1]
                span, own = data[part[0] : part[-1]], part - part[0]
                found, at = self._whole(span.tobytes(), own) if odd[lo] else self(span, own)
                ids.append(found)
                sizes.append(np.diff(at))
                lo = hi
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each row, empty rows included."""
    rows = np.arange(len(offsets) - 1)
    result = np.full(len(ids) + len(rows), end_id, np.uint32)
    keep = np.ones(len(result), bool)
    keep[offsets[1:] + rows] = False
    result[keep] = ids
    return result, offsets + np.arange(len(offsets))
