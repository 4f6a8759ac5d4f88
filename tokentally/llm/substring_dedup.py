"""Removal of word sequences that an earlier document already has, by level-wise doubling.

A window of 13 words can repeat only if its windows of 7 words do (13 is twice 7 with one
word shared), so the first level looks at 7 words and the second extends those alone that
repeat. On the first level the smallest of the seven 7-word hashes in each 13-word window
stands for it: equal windows choose the same one at the same place, so no repeat is lost
while about a quarter of all positions are sent. A row carries the hash, the document, the
position, and 32 bits for each of the windows that chose it. On the second level the rows of
a hash that more than one document has are extended to the windows of 13 words, told apart
by the 64-bit hash of seven words, their place in the window and the 32 bits of all thirteen.
No longer window can change which words are covered, so the levels end there.

Before rows are sent, equal segments of one block of texts are resolved on the spot: only the
rows of the smallest document stay, so that a passage which many documents share reaches the
shuffle once a block. Removed positions come back to the texts in one pass sorted by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentally.llm.common import _PLACE, U64, _arrow_schema, _quoted, as_batch, blocks, grouped_arange, map_arrow, mix, signed, span_hashes, window_hashes, windows, word_spans

MIN_WORDS = 13
# Bits of a spot after the word index: which of the windows at an anchor are meant.
_MASK_BITS = 8
# Rows of one doc_id from which on its texts are dealt to several tasks, and to how many.
HOT_ROWS, HOT_PARTS = 4096, 32


def segment_hashes(key: np.ndarray, low: np.ndarray, high: np.ndarray, window: np.ndarray) -> np.ndarray:
    """64 bits for what a segment says: its anchor and all its windows, given one after another.

    Whether a window goes depends on its words and its doc_id alone, so a verdict on a segment holds
    for any text of that doc_id with the same segment at the same place.
    """
    if not len(key):
        return np.zeros(0, U64)
    count = high - low + 1
    content = mix(window.astype(U64) + _PLACE[grouped_arange(count)])
    return mix(key + (low << 4 | high).astype(U64)) + np.add.reduceat(content, np.cumsum(count) - count)


def anchors(words: np.ndarray, first_word: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Segments of windows of ``size`` words that choose the same half-length window.

    row, at (word index of the anchor), low and high (windows start low..high words before
    it), key (hash of the half), window (hashes of the windows, the farthest first, all
    segments one after another).
    """
    half = (size + 1) // 2
    reach = size - half
    starts = windows(first_word, size)
    keys = window_hashes(words, half)
    best, at = keys[starts], starts.copy()
    for j in range(1, reach + 1):
        other = keys[starts + j]
        less = other < best
        best[less] = other[less]
        at[less] = starts[less] + j
    row = np.searchsorted(first_word, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(starts))[: len(begin)] - 1
    at, row = at[begin], row[begin]
    window = (window_hashes(words, size)[starts] >> U64(32)).astype(np.uint32)
    return {"row": row, "at": at - first_word[row], "low": at - starts[end], "high": at - starts[begin], "key": keys[at], "window": window}


def _segments(documents: DataFrame, size: int) -> DataFrame:
    """Rows to compare, and spots that a block resolves alone (hashes null; their key is the segment's hash)."""

    def run(batch):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in blocks(batch.column(1)):
            starts, ends, first_word = word_spans(data, offsets)
            found = anchors(span_hashes(data, starts, ends), first_word, size)
            doc = ids[lo:hi].astype(np.int64)[found["row"]]
            spot = found["at"] << _MASK_BITS
            low, high = found["low"], found["high"]
            count = high - low + 1
            begin = np.cumsum(count) - count
            whole = segment_hashes(found["key"], low, high, found["window"])
            order = np.lexsort((doc, whole))
            first = np.ones(len(order), bool)
            first[1:] = whole[order][1:] != whole[order][:-1]
            least = doc[order][np.flatnonzero(first)][np.cumsum(first) - 1]
            later = doc[order] > least
            done, sent = order[later], order[~later]
            masks = (np.int64(2) << high) - (np.int64(1) << low)
            if len(done):
                yield {"key": signed(whole[done]), "doc": doc[done], "spot": spot[done] | masks[done], "hashes": pa.nulls(len(done), pa.binary())}
            if len(sent):
                at = np.append(begin, len(found["window"])).astype(np.int32) * 4
                hashes = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(at), pa.py_buffer(found["window"])])
                yield {"key": signed(found["key"][sent]), "doc": doc[sent], "spot": spot[sent] | (low << 4 | high)[sent], "hashes": hashes.take(pa.array(sent))}

    return map_arrow(documents.where("doc is not null and text is not null"), run, "key long, doc long, spot long, hashes binary")


class _Group:
    """Second level over rows sorted by (key, doc): which windows an earlier document has."""

    def __init__(self, size: int):
        self.half = (size + 1) // 2
        self.reach = size - self.half
        # Of the last key seen: windows met so far, the smallest document of each, and of all.
        self.open_key, self.seen, self.docs, self.least = None, np.zeros(0, U64), np.zeros(0, np.int64), 0

    def window_keys(self, rows: dict, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that have a window which starts r words before the anchor, and its hash."""
        low, high = rows["spot"] >> 4 & 15, rows["spot"] & 15
        has = np.flatnonzero((low <= r) & (high >= r))
        return has, mix(rows["key"].view(U64)[has] + U64(r)) + rows["window"][rows["begin"][has] + high[has] - r]

    def __call__(self, key: np.ndarray, doc: np.ndarray, spot: np.ndarray, begin_at: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents, spots with removed windows, and segment hashes of these rows.

        All documents before a row come before it, so its windows can be judged when it is read.
        """
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(key)))
        least = doc[begin]
        if self.open_key is not None and len(key) and key[0] == self.open_key:
            least[0] = self.least
        # First level: a key counts only where a second document has it.
        repeats = np.repeat(least, size) < doc
        alive = np.zeros(len(begin), bool)
        np.logical_or.at(alive, np.repeat(np.arange(len(begin)), size)[repeats], True)
        open_again = self.open_key is not None and len(key) and key[0] == self.open_key
        last_key = key[-1]
        keep = np.repeat(alive | (np.arange(len(begin)) == len(begin) - 1), size)
        rows = {"key": key[keep], "doc": doc[keep], "spot": spot[keep], "begin": begin_at[keep], "window": window}
        removed = np.zeros(len(rows["key"]), np.int64)
        seen, docs = [], []
        for r in range(self.reach + 1):
            has, keys = self.window_keys(rows, r)
            own = rows["doc"][has]
            if open_again:
                keys = np.concatenate([self.seen, keys])
                own = np.concatenate([self.docs, own])
            unique, first, code = np.unique(keys, return_index=True, return_inverse=True)
            smallest = own[first]
            gone = smallest[code] < own
            if open_again:
                gone = gone[len(self.seen) :]
            removed[has] |= gone.astype(np.int64) << r
            tail = rows["key"][has] == last_key
            at = np.flatnonzero(tail)
            if len(at):
                mine = np.unique(code[at + (len(self.seen) if open_again else 0)])
                seen.append(unique[mine])
                docs.append(smallest[mine])
        if open_again and last_key == self.open_key:
            seen.append(self.seen)
            docs.append(self.docs)
        self.open_key, self.least = last_key, int(least[-1])
        joined, of = np.concatenate(seen or [np.zeros(0, U64)]), np.concatenate(docs or [np.zeros(0, np.int64)])
        order = np.lexsort((of, joined))
        joined, of = joined[order], of[order]
        first = np.ones(len(joined), bool)
        first[1:] = joined[1:] != joined[:-1]
        self.seen, self.docs = joined[first], of[first]
        told = np.flatnonzero(removed)
        low, high = rows["spot"][told] >> 4 & 15, rows["spot"][told] & 15
        count = high - low + 1
        own = window[np.repeat(rows["begin"][told], count) + grouped_arange(count)]
        whole = segment_hashes(rows["key"].view(U64)[told], low, high, own)
        return rows["doc"][told], rows["spot"][told] >> _MASK_BITS << _MASK_BITS | removed[told], whole


def repeated_spots(documents: DataFrame, size: int = MIN_WORDS) -> DataFrame:
    """(doc, spot, whole) for columns doc and text: anchors with windows that a smaller doc has, and their segment's hash."""
    segments = _segments(documents, size)
    ddl = "doc long, spot long, whole long"
    schema = _arrow_schema(documents.sparkSession, ddl)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = _Group(size)
        for batch in batches:
            if not batch.num_rows:
                continue
            alone = pa.compute.is_null(batch.column(3))
            own = batch.filter(alone)
            if own.num_rows:
                yield as_batch({"doc": own.column(1), "spot": own.column(2), "whole": own.column(0)}, schema)
            rest = batch.filter(pa.compute.invert(alone))
            if rest.num_rows:
                _, at, window = rest.column(3).buffers()
                at = np.frombuffer(at, np.int32)[rest.column(3).offset :][: rest.num_rows] // 4
                doc, spot, whole = group(*(rest.column(i).to_numpy() for i in range(3)), at, np.frombuffer(window, np.uint32))
                if len(doc):
                    yield as_batch({"doc": doc, "spot": spot, "whole": signed(whole)}, schema)

    # Spots that are settled already are spread by document; the others meet by hash.
    dealt = segments.repartition(F.when(F.col("hashes").isNull(), F.xxhash64("doc", "spot")).otherwise(F.col("key"))).sortWithinPartitions("key", "doc")
    return dealt.mapInArrow(extend, ddl)


def _removed(first_word: np.ndarray, row: np.ndarray, spots: np.ndarray, size: int) -> np.ndarray:
    """Which words are covered by removed windows; spots belong to the given rows."""
    half = (size + 1) // 2
    n = int(first_word[-1])
    edge = np.zeros(n + 1, np.int32)
    at = first_word[row] + (spots >> _MASK_BITS)
    for r in range(size - half + 1):
        begin = at[(spots >> r) & 1 == 1] - r
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _own_spots(words: np.ndarray, first_word: np.ndarray, row: np.ndarray, spots: np.ndarray, whole: np.ndarray, size: int) -> np.ndarray:
    """Which spots of a doc_id belong to the text of their row: it has the same segment at that place."""
    if not len(spots):
        return np.zeros(0, bool)
    # Only texts with spots are looked at again.
    some = np.unique(row)
    counts = np.diff(first_word)[some]
    own = words[np.repeat(first_word[some], counts) + grouped_arange(counts)]
    found = anchors(own, np.concatenate([[0], np.cumsum(counts)]), size)
    said = segment_hashes(found["key"], found["low"], found["high"], found["window"])
    # A text has at most one segment at a place for each range of windows; places repeat only across rows.
    place = mix((some[found["row"]].astype(U64) << U64(40)) + found["at"].astype(U64)) ^ said
    return np.isin(mix((row.astype(U64) << U64(40)) + (spots >> _MASK_BITS).astype(U64)) ^ whole.view(U64), place)


def _hot_ids(source: DataFrame) -> list[int]:
    """Ids of so many rows that one task should not hold all their texts; fewer than a thousandth of the rows each stay together."""
    counts = source.where("doc is not null").groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_ROWS)
    found = counts.orderBy(F.desc("n"), "doc").limit(1000).collect()
    return [r.doc for r in found]


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of each row's words joined by one space."""
    lengths = ends - starts + 1
    out = np.full(int(lengths.sum()), 0x20, np.uint8)
    place = np.cumsum(lengths) - lengths
    inner = grouped_arange(lengths - 1)
    out[np.repeat(place, lengths - 1) + inner] = data[np.repeat(starts, lengths - 1) + inner]
    sizes = np.bincount(row, lengths, rows).astype(np.int64)
    has = sizes > 0
    keep = np.ones(len(out), bool)
    keep[np.cumsum(sizes)[has] - 1] = False
    return out[keep], np.concatenate([[0], np.cumsum(sizes - has)])


def string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def _compressed(source: DataFrame) -> DataFrame:
    """The column text as compressed bytes with their size, for the way through a shuffle; other columns stay."""
    names = [c for c in source.columns if c != "text"]
    kinds = T.StructType([*(source.schema[n] for n in names), T.StructField("packed", T.BinaryType()), T.StructField("bytes", T.IntegerType())])
    schema = _arrow_schema(source.sparkSession, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            if batch.num_rows:
                texts = [None if t is None else t.encode() for t in batch.column("text").to_pylist()]
                columns = {n: batch.column(n) for n in names}
                columns["packed"] = [None if t is None else codec.compress(t, asbytes=True) for t in texts]
                columns["bytes"] = [None if t is None else len(t) for t in texts]
                yield as_batch(columns, schema)

    return source.mapInArrow(run, kinds)


def _texts(packed: pa.Array, sizes: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd")
    parts = [None if p is None else codec.decompress(p, n, asbytes=True) for p, n in zip(packed.to_pylist(), sizes.to_pylist())]
    return pa.array(parts, pa.binary()).cast(pa.string())


def dedup_substrings(documents: DataFrame, size: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) and text of every row.

    A word goes if a window of ``size`` words over it also starts in a row with a smaller
    doc_id. A null text has no words. A null doc_id is neither smaller nor larger than any, so
    such rows stay whole. Rows with the same doc_id and different texts are judged each, by 64 bits of
    the windows at each place, and a doc_id of very many rows is dealt to several tasks by text; rows
    that repeat wholly are each returned. Other columns are ignored, but for those named in
    ``carry``, which come along in a struct ``rest``.
    """
    if not 3 <= size <= 15:
        raise ValueError("windows have 3 to 15 words")
    rest = F.struct(*[F.col(_quoted(c)) for c in carry]) if carry else F.lit(0)
    source = documents.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).cast("string").alias("text"))
    spots = repeated_spots(source, size)
    # An id with very many texts is dealt to several tasks by text, and its spots go to each of them.
    hot = _hot_ids(source)
    part = F.when(F.col("doc").isin(hot), F.pmod(F.xxhash64("text"), F.lit(HOT_PARTS))).otherwise(0).cast("int") if hot else F.lit(0)
    parts = F.when(F.col("doc").isin(hot), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))
    texts = documents.select(F.col(id_column).cast("long").alias("doc"), rest.alias("rest"), F.col(text_column).cast("string").alias("text")).select(
        F.coalesce("doc", F.xxhash64("text")).alias("by"), F.coalesce(part, F.lit(0)).alias("part"), "doc", F.lit(None).cast("long").alias("spot"), F.lit(None).cast("long").alias("whole"), "rest", "text"
    )
    packed = _compressed(texts)
    of_spots = [F.lit(None).cast(packed.schema[c].dataType).alias(c) for c in ("rest", "packed", "bytes")]
    spread = spots.withColumn("part", F.explode(parts)) if hot else spots.withColumn("part", F.lit(0))
    # Spots come before the texts of their document.
    both = spread.select(F.col("doc").alias("by"), "part", "doc", "spot", "whole", *of_spots).union(packed)
    dealt = both.repartition("by", "part").sortWithinPartitions("by", "part", F.col("spot").asc_nulls_last())
    kinds = T._parse_datatype_string("doc_id long, n_words long, n_removed long, kept string, text string").add("rest", packed.schema["rest"].dataType)
    schema = _arrow_schema(documents.sparkSession, kinds)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, spot, whole = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            # A task may hold several parts of one id; their spots are the same.
            key = batch.column(0).to_numpy()
            is_spot = pa.compute.is_valid(batch.column(3)).to_numpy(zero_copy_only=False)
            by = np.concatenate([by, key[is_spot]])
            # Without the nulls of other rows, which would turn 64 bits into floating point.
            spot = np.concatenate([spot, batch.column(3).filter(pa.array(is_spot)).to_numpy()])
            whole = np.concatenate([whole, batch.column(4).filter(pa.array(is_spot)).to_numpy()])
            rows = batch.filter(pa.array(~is_spot))
            # Spots of an id with one text are its own; others are looked up. Neighbours of a batch's ends are not known.
            many = np.ones(rows.num_rows, bool)
            next_is_new = np.diff(rows.column(0).to_numpy()) != 0
            many[1:-1] = ~(next_is_new[:-1] & next_is_new[1:]) if rows.num_rows > 2 else True
            many |= np.isin(rows.column(0).to_numpy(), hot)
            # A bounded number of compressed texts is opened at once.
            for at in range(0, rows.num_rows, 1024):
                part = rows.slice(at, 1024)
                column = _texts(part.column(6), part.column(7))
                for lo, hi, data, offsets in blocks(column):
                    keys = part.column(0).to_numpy()[lo:hi]
                    known = pa.compute.is_valid(part.column(2)).to_numpy(zero_copy_only=False)[lo:hi]
                    starts, ends, first_word = word_spans(data, offsets)
                    begin, end = np.searchsorted(by, keys, "left"), np.searchsorted(by, keys, "right")
                    count = np.where(known, end - begin, 0)
                    row = np.repeat(np.arange(hi - lo), count)
                    mine = np.repeat(begin, count) + grouped_arange(count)
                    check = many[at : at + 1024][lo:hi][row]
                    fits = ~check
                    if check.any():
                        fits[check] = _own_spots(span_hashes(data, starts, ends), first_word, row[check], spot[mine][check], whole[mine][check], size)
                    gone = _removed(first_word, row[fits], spot[mine][fits], size)
                    of = np.repeat(np.arange(hi - lo), np.diff(first_word))
                    kept = joined_words(data, starts[~gone], ends[~gone], of[~gone], hi - lo)
                    yield as_batch({
                        "doc_id": part.column(2).slice(lo, hi - lo), "n_words": np.diff(first_word), "n_removed": np.bincount(of[gone], minlength=hi - lo),
                        "kept": string_array(*kept), "text": column.slice(lo, hi - lo), "rest": part.column(5).slice(lo, hi - lo),
                    }, schema)
            last = by == key[-1]
            by, spot, whole = by[last], spot[last], whole[last]

    found = dealt.mapInArrow(apply, kinds)
    return found if carry else found.drop("rest")
