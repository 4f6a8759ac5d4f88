"""Token counts by a byte-level BPE tokenizer that is compiled to finite-state transducers.

Two deterministic machines read a text. The first finds the pieces that merges never cross
(runs of letters, digits, other signs and white space, English contractions); it works on
character classes that are probed from the tokenizer library itself. The second reads the
bytes of a piece. Byte-pair encoding of a prefix ends with exactly one token that agrees
with the token before it, so the encoding of every longer prefix follows from the starts
that can still grow into a token, the token in front of each and the number of tokens there.
That is the state; each transition carries the number of tokens by which the encoding grows
(it may shrink). States are made when they are first met and forgotten when they are too many.

Texts are read in chunks of equal size, all chunks of a block in lockstep. A chunk's state
map is constant from its first piece border on. What stands before the border is run from
the state in which the chunk before ends; a chunk without a border first assumes that it
starts a piece, and is run anew until the states at all chunk ends agree.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.llm.common import blocks, map_arrow

LETTER, NUMBER, OTHER, WHITE, NONE = 0, 1, 2, 3, 255
CHUNK = 512
BLOCK = 2 << 20
STATES = 1 << 18
_SHIFT, _ZERO = 6, 32
_NEVER = (1 << 60, 0)


def byte_characters() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Deterministic transducer from the bytes of a piece to changes of its token count."""

    def __init__(self, vocabulary: dict[str, int], merges: list, limit: int = STATES):
        byte = byte_characters()
        spelled = {token: bytes(byte[c] for c in token) for token in vocabulary if all(c in byte for c in token)}
        self.single = [0] * 256
        self.spelling: dict[int, bytes] = {}
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.grows: list[bool] = [False]
        for token, word in spelled.items():
            number = vocabulary[token]
            self.spelling[number] = word
            if len(word) == 1:
                self.single[word[0]] = number
            node = 0
            for b in word:
                self.grows[node] = True
                after = self.child.get(node << 8 | b)
                if after is None:
                    after = self.child[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                    self.grows.append(False)
                node = after
            self.token_at[node] = number
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            pair, joined = (vocabulary[left], vocabulary[right]), vocabulary[left + right]
            self.merge.setdefault(pair, (rank, joined))
            if self.made.setdefault(joined, (rank, *pair)) != (rank, *pair):
                raise ValueError(f"two merges make {left + right!r}")
        self.agrees: dict[int, bool] = {}
        self.limit = limit
        self.column = np.full(256, -1, np.int32)
        self.clear()

    def clear(self) -> None:
        start = ((0, -1, 0),)
        self.number = {start: 0}
        self.states = [start]
        self.table = np.full((1 << 11, 64), -1, np.int32)
        self.agrees.clear()

    def encode(self, word: bytes) -> list[int]:
        """The merges in order of rank, leftmost first."""
        ids = [self.single[b] for b in word]
        while len(ids) > 1:
            rank = min(self.merge.get(pair, _NEVER)[0] for pair in zip(ids, ids[1:]))
            if rank == _NEVER[0]:
                break
            out, i = [], 0
            while i < len(ids):
                found = self.merge.get((ids[i], ids[i + 1])) if i + 1 < len(ids) else None
                if found and found[0] == rank:
                    out.append(found[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def follows(self, before: int, token: int) -> bool:
        """Whether a piece may have these two tokens in a row (before -1: begin with the token)."""
        key = before + 1 << 32 | token
        known = self.agrees.get(key)
        if known is None:
            if before < 0:
                known = self.encode(self.spelling[token]) == [token]
            else:
                known = self.follows(-1, token) and not self.merges_across(before, token)
            self.agrees[key] = known
        return known

    def merges_across(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens would join something over their border.

        Merges are undone from the last one on. While two tokens meet at the border, their
        own merge comes first if its rank is below that of the merge which used one of them;
        of equal ranks the leftmost comes first.
        """
        next_use = (1 << 60, 0)
        while True:
            joined = self.merge.get((left, right))
            if joined and (joined[0], 1) < next_use:
                return True
            made_left, made_right = self.made.get(left), self.made.get(right)
            if made_left and (not made_right or made_left[0] > made_right[0]):
                next_use, left = (made_left[0], 0), made_left[2]
            elif made_right:
                next_use, right = (made_right[0], 2), made_right[1]
            else:
                return False

    def columns(self, data: np.ndarray) -> np.ndarray:
        """Table columns of bytes; a byte gets one when it is first seen."""
        new = [b for b in np.flatnonzero(np.bincount(data, minlength=256)).tolist() if self.column[b] < 0]
        for b in new:
            self.column[b] = self.column.max() + 1
        if self.column.max() >= self.table.shape[1]:
            self.table = np.concatenate([self.table, np.full((len(self.table), 64), -1, np.int32)], axis=1)
            return self.columns(data)
        return self.column[data]

    def compile(self, state: int, b: int) -> None:
        items, last, grown = [], -1, 0
        for node, before, count in self.states[state]:
            after = self.child.get(node << 8 | b)
            if after is None:
                continue
            token = self.token_at[after]
            if last < 0 and token >= 0 and self.follows(before, token):
                last, grown = token, count + 1
            if self.grows[after]:
                items.append((after, before, count))
        if last < 0 or not -_ZERO <= grown < _ZERO:
            raise ValueError("the vocabulary is not a byte-level BPE vocabulary")
        after = tuple((node, before, count - grown) for node, before, count in items) + ((0, last, 0),)
        number = self.number.get(after)
        if number is None:
            number = self.number[after] = len(self.states)
            self.states.append(after)
            if len(self.states) > len(self.table):
                self.table = np.concatenate([self.table, np.full((len(self.table) // 2, self.table.shape[1]), -1, np.int32)])
        self.table[state, self.column[b]] = number << _SHIFT | grown + _ZERO

    def run(self, data: np.ndarray, border: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray, change: np.ndarray) -> np.ndarray:
        """Read the spans begin..end from the given states in lockstep; fills ``change``, returns the last states."""
        order = np.argsort(begin - end, kind="stable")
        columns, width = self.columns(data), self.table.shape[1]
        flat = self.table.reshape(-1)
        at, length, now = begin[order], (end - begin)[order], state[order].astype(np.int32)
        lanes = len(order)
        for step in range(int(length[0]) if lanes else 0):
            lanes = int(np.searchsorted(-length, -step, "left")) if length[lanes - 1] <= step else lanes
            here = at[:lanes] + step
            key = now[:lanes] * ~border[here]
            key *= width
            key += columns[here]
            packed = flat[key]
            missing = np.flatnonzero(packed < 0)
            if len(missing):
                _, example = np.unique(key[missing], return_index=True)
                for k in missing[example].tolist():
                    self.compile(int(key[k]) // width, int(data[here[k]]))
                flat = self.table.reshape(-1)
                packed = flat[key]
            change[here] = (packed & (1 << _SHIFT) - 1) - _ZERO
            now[:lanes] = packed >> _SHIFT
        result = np.empty_like(now)
        result[order] = now
        return result

    def changes(self, data: np.ndarray, border: np.ndarray) -> np.ndarray:
        """By how much the count of tokens grows at each byte; ``border`` marks first bytes of pieces, the first byte too."""
        if len(self.states) > self.limit:
            self.clear()
        change = np.zeros(len(data), np.int8)
        begin = np.arange(0, len(data), CHUNK)
        end = np.minimum(begin + CHUNK, len(data))
        borders = np.flatnonzero(border)
        place = np.searchsorted(borders, begin)
        first = np.append(borders, len(data))[place]
        head = np.minimum(first, end)
        whole = first >= end
        last = self.run(data, border, np.where(whole, begin, head), end, np.zeros(len(begin), np.int32), change)
        entry = np.full(len(begin), -1, np.int32)
        while True:
            want = np.concatenate([[0], last[:-1]])
            todo = np.flatnonzero((want != entry) & (head > begin))
            if not len(todo):
                return change
            entry[todo] = want[todo]
            ends = self.run(data, border, begin[todo], head[todo], want[todo], change)
            last[todo[whole[todo]]] = ends[whole[todo]]


def piece_starts(points: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """First characters of pieces, for code points, their classes and the first characters of texts."""
    n = len(points)
    white = kinds == WHITE
    before = np.concatenate([[NONE], kinds[:-1]]).astype(np.uint8)
    before[first] = NONE
    after = np.concatenate([kinds[1:], [NONE]]).astype(np.uint8)
    after[first[first > 0] - 1] = NONE
    starts = kinds != before
    # A single space goes with what follows; of longer white space only the last character does.
    spaced = np.concatenate([[False], points[:-1] == 32])
    spaced[first] = False
    starts[spaced & ~white] = False
    starts[white & (after != WHITE) & (after != NONE)] = True
    marks = np.flatnonzero((points == 39) & starts)
    if len(marks):
        text = np.searchsorted(first, marks, "right")
        stop = np.append(first, n)[text]
        one = np.where(marks + 1 < stop, points[np.minimum(marks + 1, n - 1)], 0)
        two = np.where(marks + 2 < stop, points[np.minimum(marks + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.isin(one.astype(np.int64) << 21 | two, [ord(a) << 21 | ord(b) for a, b in ("re", "ve", "ll")])
        starts[marks[short | long] + 1] = False
        starts[marks[long] + 2] = False
        after_it = np.concatenate([marks[short] + 2, marks[long] + 3])
        starts[after_it[after_it < n]] = True
    return starts


@lru_cache(maxsize=2)
def class_runs(path: str) -> tuple[np.ndarray, np.ndarray]:
    """First code points and classes of runs of equal class, as the library's own splitter sees them."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    kinds = np.full(0x110000, OTHER, np.uint8)
    assigned = [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)]
    for lo in range(0, len(assigned), 1 << 14):
        part = assigned[lo : lo + (1 << 14)]
        seen = {}
        for kind, lead in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            # A character joins a lead of its own class and starts a piece after any other.
            starts = np.zeros(3 * len(part) + 1, bool)
            starts[[a for _, (a, _) in split("".join(f"{lead}{chr(c)}\n" for c in part))]] = True
            seen[kind] = ~starts[1::3][: len(part)]
        kinds[part] = np.select([seen[k] for k in (LETTER, NUMBER, OTHER)], [LETTER, NUMBER, OTHER], WHITE)
    at = np.flatnonzero(np.diff(kinds, prepend=NONE))
    return at, kinds[at]


class Counter:
    """Counts of whole texts; one for each Python worker and tokenizer."""

    def __init__(self, path: str, runs: tuple[np.ndarray, np.ndarray], states: int = STATES):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kind = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"]:
            raise ValueError("a byte-level BPE tokenizer with the usual splitter is needed")
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take white space along are not supported")
        self.machine = Transducer(spec["model"]["vocab"], spec["model"]["merges"], states)
        at, kinds = runs
        self.kinds = np.repeat(kinds, np.diff(np.append(at, 0x110000)))

    def without_special(self, raw: bytes, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """Texts cut at special strings: bytes and offsets of the parts, their rows, and the number of special tokens by row."""
        rows = np.arange(len(offsets) - 1)
        extra = np.zeros(len(rows), np.int64)
        if not any(s in raw for s in self.special):
            return raw, offsets, rows, extra
        import re

        pattern = re.compile(b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        parts, owners = [], []
        for row in rows.tolist():
            pieces = pattern.split(raw[offsets[row] : offsets[row + 1]])
            extra[row] = len(pieces) - 1
            parts += pieces
            owners += [row] * len(pieces)
        return b"".join(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.array(owners), extra

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raw, at, rows, counts = self.without_special(data.tobytes(), offsets)
        if raw:
            points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
            width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000).astype(np.int64)
            place = np.cumsum(width) - width
            texts = np.unique(at[:-1][at[:-1] < len(raw)])
            starts = piece_starts(points, self.kinds[points], np.searchsorted(place, texts))
            border = np.zeros(len(raw), bool)
            border[place[starts]] = True
            total = np.concatenate([[0], np.cumsum(self.machine.changes(np.frombuffer(raw, np.uint8), border), dtype=np.int64)])
            np.add.at(counts, rows, total[at[1:]] - total[at[:-1]])
        return counts


@lru_cache(maxsize=2)
def _counter(path: str, at: bytes, kinds: bytes) -> Counter:
    return Counter(path, (np.frombuffer(at, np.int64), np.frombuffer(kinds, np.uint8)))


def token_counts(documents: DataFrame, tokenizer: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    A null text is an empty one and has no tokens. Texts are read whole, whatever their
    length; rows that repeat are counted each; columns other than the two named are ignored.
    """
    at, kinds = class_runs(tokenizer)
    at, kinds = at.astype(np.int64).tobytes(), kinds.tobytes()

    def run(batch: pa.RecordBatch):
        for lo, hi, data, offsets in blocks(batch.column(1), BLOCK):
            yield {"doc_id": batch.column(0).slice(lo, hi - lo), "n_bytes": np.diff(offsets), "n_tokens": _counter(tokenizer, at, kinds)(data, offsets)}

    source = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return map_arrow(source, run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
