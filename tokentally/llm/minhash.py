"""Near-duplicate documents by DartMinHash signatures and banded joining.

Each shingle owns a strip of the plane as wide as its weight; hashed darts fall on it as a
Poisson process along the rank axis, so shingles that two documents share get the same
darts. A document throws darts up to a rank at which about k ln k + 2k of them lie in its
strips, whatever its length, and keeps the earliest dart of each of the k coordinates; a
document that misses a coordinate throws on to twice that rank. Two documents agree in a
coordinate with the probability of their weighted Jaccard similarity.

Documents that agree in a band meet at the member of the bucket with the smallest hash. All
that meet at one such centre are compared there on whole shingle sets: first with the
centre, then every one that is not yet connected with it is compared with the rest. The
triangle inequality of the Jaccard distance leaves out pairs that cannot be similar. Groups
above a size are dealt to several tasks, each with the centre. What stays unconnected to the
centre there is open: in a second pass open and other members are cut into blocks of bounded
shingles, and every pair of open blocks, and of an open block and another one, is compared in
a task of its own. Links are merged to classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.llm.common import _PLACE, U64, _arrow_schema, as_batch, blocks, components, grouped_arange, map_arrow, mix, signed, span_hashes, stored, window_hashes, windows, word_spans

SHINGLE = 5
SIMILARITY = 0.8
# 24 bands of 4 coordinates: of pairs at similarity 0.8, one in 300,000 shares no band.
BANDS, ROWS = 24, 4
# Shingles that one comparing task is dealt; a block of the second pass has half of them.
TASK_SHINGLES = 1 << 21
_EMPTY = U64((1 << 64) - 1)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles and the index of each row's first one; fewer words than ``size`` are one shingle."""
    starts, ends, first_word = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    at = windows(first_word, size)
    hashes = window_hashes(words, size)[at]
    counts = np.maximum(np.diff(first_word) - size + 1, 0)
    n = np.diff(first_word)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        single = np.array([mix(np.sum(words[first_word[i] : first_word[i + 1]] * _PLACE[: n[i]], keepdims=True) + U64(n[i]))[0] for i in short], U64)
        place = (np.cumsum(counts) - counts)[short]
        hashes = np.insert(hashes, place, single)
        counts[short] = 1
    return hashes, np.concatenate([[0], np.cumsum(counts)])


def dart_signatures(elements: np.ndarray, first: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """k earliest darts of each row of weighted elements, as unsigned 64-bit numbers.

    ``weights`` are positive (none: 1 each). A strip of weight w is cut into layers of width 1
    with darts of their own; a dart of the last layer counts if it falls within the weight.
    Rows without elements stay empty (all bits set).
    """
    rows = len(first) - 1
    result = np.full((rows, k), _EMPTY, U64)
    sizes = np.diff(first)
    row = np.repeat(np.arange(rows), sizes)
    total = sizes.astype(float) if weights is None else np.bincount(row, weights, rows)
    if weights is not None:
        layers = np.ceil(weights).astype(np.int64)
        layer = grouped_arange(layers)
        row, width = np.repeat(row, layers), np.repeat(weights, layers) - layer
        elements = mix(np.repeat(elements, layers) + layer.astype(U64) * U64(0x9E3779B97F4A7C15))
    else:
        width = None
    reach = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    todo = np.flatnonzero(sizes > 0)
    while len(todo):
        chosen = np.zeros(rows, bool)
        chosen[todo] = True
        live = np.flatnonzero(chosen[row]) if len(todo) < rows else np.arange(len(row))
        rank = np.zeros(len(live))
        flat = result.reshape(-1)
        draw = 0
        while len(live):
            draw += 1
            dart = mix(elements[live] + U64(draw * 0xD1342543DE82EF95 & (1 << 64) - 1))
            gap = mix(dart)
            rank = rank - np.log(((gap >> U64(12)).astype(np.float64) + 0.5) * 2.0**-52)
            kept = rank <= reach[row[live]]
            live, rank, dart = live[kept], rank[kept], dart[kept]
            hit = slice(None) if width is None else (mix(dart ^ U64(0x2545F4914F6CDD1D)) >> U64(12)).astype(np.float64) * 2.0**-52 <= width[live]
            place = row[live][hit] * k + ((dart[hit] >> U64(32)) % U64(k)).astype(np.int64)
            early = rank[hit].astype(np.float32).view(np.uint32).astype(U64) << U64(32) | dart[hit] & U64(0xFFFFFFFF)
            np.minimum.at(flat, place, early)
        reach[todo] *= 2
        todo = todo[(result[todo] == _EMPTY).any(axis=1)]
    return result


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cut = signatures.reshape(len(signatures), bands, rows)
    total = np.zeros(cut.shape[:2], U64)
    for i in range(rows):
        total += mix(cut[:, :, i]) * _PLACE[i]
    return mix(total + np.arange(bands, dtype=U64) * _PLACE[-1])


def _signed_documents(documents: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """id, print (hash of the text), key (hash of the shingles with their counts), size and bands; words needed."""

    def run(batch):
        for lo, hi, data, offsets in blocks(batch.column(2)):
            hashes, first = shingle_hashes(data, offsets, shingle)
            sizes = np.diff(first)
            has = np.flatnonzero(sizes)
            if not len(has):
                continue
            signatures = dart_signatures(hashes, first, bands * rows)[has]
            key = mix(np.add.reduceat(mix(hashes), first[:-1][has]) + sizes[has].astype(U64))
            values = signed(band_hashes(signatures, bands, rows).reshape(-1))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * bands), pa.array(values))
            take = pa.array(has + lo)
            yield {"id": batch.column(0).take(take), "print": batch.column(1).take(take), "key": signed(key), "size": sizes[has], "bands": listed}

    return map_arrow(documents, run, "id long, print long, key long, size long, bands array<long>")


def _sets(with_text: DataFrame, shingle: int) -> DataFrame:
    """(id, shingles) for columns id and text: sorted distinct 32-bit shingle hashes; other columns stay."""
    names = [c for c in with_text.columns if c != "text"]

    def run(batch):
        for lo, hi, data, offsets in blocks(batch.column("text")):
            hashes, first = shingle_hashes(data, offsets, shingle)
            row = np.repeat(np.arange(hi - lo), np.diff(first))
            both = np.unique(row.astype(U64) << U64(32) | hashes >> U64(32))
            sizes = np.bincount((both >> U64(32)).astype(np.int64), minlength=hi - lo)
            at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * 4
            flat = (both & U64(0xFFFFFFFF)).astype(np.uint32)
            packed = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(at), pa.py_buffer(flat)])
            yield {n: batch.column(n).slice(lo, hi - lo) for n in names} | {"shingles": packed}

    kinds = ", ".join(f"`{n}` {t}" for n, t in with_text.dtypes if n != "text")
    return map_arrow(with_text, run, f"{kinds}, shingles binary")


class Group:
    """Shingle sets that met at one centre (the first set)."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.sizes = np.array([len(s) for s in sets])
        self.flat = np.concatenate(sets)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.sets, self.similarity = sets, similarity

    def to_all(self, i: int, others: np.ndarray) -> np.ndarray:
        """Similarity of set i with other sets."""
        flat = self.flat if len(others) == len(self.sizes) else np.concatenate([self.sets[j] for j in others])
        own = self.sets[i]
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        sizes = self.sizes[others]
        shared = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
        return shared / (len(own) + sizes - shared)

    def labels(self) -> np.ndarray:
        """Connected components of similar sets, each named by its first set."""
        n = len(self.sizes)
        everyone = np.arange(n)
        label = everyone.copy()
        self.near = near = self.to_all(0, everyone)
        label[near >= self.similarity - 1e-12] = 0
        slack = 1 - self.similarity + 1e-9
        for i in range(1, n):
            if label[i] == 0:
                continue
            others = np.flatnonzero((np.abs(near - near[i]) <= slack) & (label != label[i]) & (np.minimum(self.sizes, self.sizes[i]) >= self.similarity * np.maximum(self.sizes, self.sizes[i]) - 1e-9))
            if len(others):
                linked = others[self.to_all(i, others) >= self.similarity - 1e-12]
                joined = np.unique(np.append(label[linked], label[i]))
                label[np.isin(label, joined)] = joined[0]
        return label

    def joined(self, label: np.ndarray, near: np.ndarray, side: np.ndarray | None) -> np.ndarray:
        """Labels after every pair of the two sides (none: every pair) is compared; ``near`` is the similarity with the centre."""
        label = label.copy()
        slack = 1 - self.similarity + 1e-9
        for i in range(len(label)) if side is None else np.flatnonzero(side == 0):
            facing = np.arange(len(label)) > i if side is None else side == 1
            others = np.flatnonzero(facing & (np.abs(near - near[i]) <= slack) & (label != label[i]) & (np.minimum(self.sizes, self.sizes[i]) >= self.similarity * np.maximum(self.sizes, self.sizes[i]) - 1e-9))
            if len(others):
                linked = others[self.to_all(i, others) >= self.similarity - 1e-12]
                both = np.unique(np.append(label[linked], label[i]))
                label[np.isin(label, both)] = both[0]
        return label


def _gathered(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, list[tuple]]]:
    """(centre, chunk) and its rows (id, set, then columns ``names``), each id once."""
    group, rows = None, []
    for batch in batches:
        for centre, chunk, i, raw, *more in zip(*(batch.column(n).to_pylist() for n in ("centre", "chunk", "id", "shingles", *names))):
            if (centre, chunk) != group:
                if len(rows) > 1:
                    yield group, rows
                group, rows = (centre, chunk), []
            if not rows or i != rows[-1][0]:
                rows.append((i, np.frombuffer(raw, np.uint32), *more))
    if len(rows) > 1:
        yield group, rows


def _compare(members: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) among rows (centre, chunk, is_centre, id, shingles); v is the first of its component, once for each member.

    ``near`` is the similarity of u with the centre.
    """
    ddl = "centre long, u long, v long, near double"
    schema = _arrow_schema(members.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (centre, _), rows in _gathered(batches):
            ids, sets = zip(*rows)
            group = Group(list(sets), similarity)
            label = group.labels()
            yield as_batch({"centre": np.full(len(ids), centre), "u": list(ids), "v": np.array(ids)[label], "near": group.near}, schema)

    dealt = members.repartition("centre", "chunk").sortWithinPartitions("centre", "chunk", F.col("is_centre").desc(), "id")
    return dealt.mapInArrow(run, ddl)


def _compare_blocks(members: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) between labels of rows (centre, chunk, block, label, near, id, shingles); chunk tells the two blocks."""
    ddl = "u long, v long"
    schema = _arrow_schema(members.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, chunk), rows in _gathered(batches, "block", "label", "near"):
            _, sets, block, label, near = zip(*rows)
            side = None if chunk["one"] == chunk["other"] else (np.array(block) == chunk["other"]).astype(int)
            names, label = np.unique(np.array(label), return_inverse=True)
            new = Group(list(sets), similarity).joined(label, np.array(near), side)
            changed = np.unique(np.stack([label, new]), axis=1)
            changed = changed[:, changed[0] != changed[1]]
            if changed.size:
                yield as_batch({"u": names[changed[0]], "v": names[changed[1]]}, schema)

    dealt = members.repartition("centre", "chunk").sortWithinPartitions("centre", "chunk", "id")
    return dealt.mapInArrow(run, ddl)


def _block_pairs(told: DataFrame) -> DataFrame:
    """Block, and pairs of blocks in ``chunk``, of rows (key, centre, label, near, size) whose label is the centre unless they are open."""
    is_open = F.col("label") != F.col("centre")
    blocks = lambda which: F.ceil(F.coalesce(F.sum(F.when(which, F.col("size"))), F.lit(0)) / F.lit(max(1, TASK_SHINGLES // 2))).cast("int")
    counts = told.groupBy("centre").agg(blocks(is_open).alias("opens"), blocks(~is_open).alias("others")).where("opens > 0")
    spread = lambda n: F.pmod(F.xxhash64("key", "centre"), F.greatest(F.col(n), F.lit(1))).cast("int")
    placed = told.join(F.broadcast(counts), "centre").withColumn("block", F.when(is_open, spread("opens")).otherwise(F.col("opens") + spread("others")))
    end = F.when(is_open, F.col("opens") + F.col("others")).otherwise(F.col("opens")) - 1
    pairs = F.transform(F.sequence(F.lit(0), end), lambda j: F.struct(F.least("block", j).alias("one"), F.greatest("block", j).alias("other")))
    return placed.select("key", "centre", "block", "label", "near", pairs.alias("chunk"))


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, class_id, kept and text_print (xxhash64 of the text) for every distinct (doc_id, text).

    Documents are in one class if a chain of pairs with a Jaccard similarity of ``similarity``
    or more on shingles of ``shingle`` words connects them; class_id is the smallest doc_id of
    the class, and its document alone is kept. Texts of fewer words are one shingle. Null and empty texts and texts of white
    space alone are classes of their own; a row with a null doc_id has a null class. Other
    columns are ignored.
    """
    source = documents.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text_column).alias("print"), F.col(text_column).alias("text"))
    known = source.where("id is not null")
    base = stored(_signed_documents(known, shingle, bands, rows))
    # Equal texts count once, by their smallest id.
    chosen = base.groupBy("key").agg(F.min(F.struct("id", "print")).alias("r"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    unique = stored(chosen.select(F.col("r.id").alias("id"), F.col("r.print").alias("print"), "key", "size", "bands"))
    banded = unique.select("key", "size", F.explode("bands").alias("bucket"))
    centres = banded.groupBy("bucket").agg(F.min("key").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = stored(banded.join(centres, "bucket").groupBy("centre", "key").agg(F.first("size").alias("size")))
    chunks = stored(pairs.groupBy("centre").agg(F.ceil(F.sum("size") / F.lit(TASK_SHINGLES)).cast("int").alias("chunks")))
    member = pairs.join(chunks, "centre")
    own = F.array(F.pmod(F.xxhash64("key", "centre"), F.col("chunks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    first = member.select("key", "centre", F.when(F.col("key") == F.col("centre"), every).otherwise(own).alias("chunk"))
    sets = _sets(known.join(unique.select("id", "print", "key").join(pairs.select("key").distinct(), "key"), ["id", "print"]).select("key", "text"), shingle)
    large = not chunks.where("chunks > 1").isEmpty()
    if large:
        sets = stored(sets)
    links = stored(_compare(_placed(first, sets), similarity))
    edges = links.where("u <> v").select("u", "v")
    if large:
        # Members that a task of a large group could not connect with the centre meet all other members, two blocks at a time.
        told = links.where("u <> centre").select("centre", F.col("u").alias("key"), F.col("v").alias("label"), "near").join(member.where("chunks > 1").select("centre", "key", "size"), ["centre", "key"])
        second = _placed(_block_pairs(stored(told)), sets)
        edges = edges.union(stored(_compare_blocks(second, similarity)))
    return _classes(source, base, unique, edges)


def _placed(member: DataFrame, sets: DataFrame) -> DataFrame:
    """Shingle sets at their centres and chunks; a text has at most one centre for each band."""
    names = [c for c in member.columns if c != "key"]
    places = member.groupBy("key").agg(F.collect_list(F.struct(*names)).alias("places"))
    at = sets.join(places, "key").select(F.col("key").alias("id"), "shingles", F.explode("places").alias("p"))
    at = at.select("id", "shingles", (F.col("id") == F.col("p.centre")).alias("is_centre"), *[F.col(f"p.{n}") for n in names])
    return at.withColumn("chunk", F.explode("chunk"))


def _classes(source: DataFrame, base: DataFrame, unique: DataFrame, edges: DataFrame) -> DataFrame:
    of_key = components(edges).withColumnRenamed("node", "key")
    named = unique.select("key", "id", "print").join(of_key, "key", "left").withColumn("component", F.coalesce("component", "key"))
    classes = named.groupBy("component").agg(F.min(F.struct("id", "print")).alias("first"))
    by_key = named.join(classes, "component").select("key", "first")
    told = base.join(by_key, "key").select(F.col("id").alias("doc_id"), F.col("print").alias("text_print"), "first").distinct()
    everyone = source.select(F.col("id").alias("doc_id"), F.col("print").alias("text_print")).distinct()
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.text_print") == F.col("b.text_print"))
    own = F.struct("a.doc_id", "a.text_print")
    return everyone.alias("a").join(told.alias("b"), same, "left").select(
        "a.doc_id", F.coalesce("b.first.id", "a.doc_id").alias("class_id"), F.coalesce(own == F.col("b.first"), F.lit(True)).alias("kept"), "a.text_print",
    )


def without_near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """The rows of ``documents`` that are kept: one of each class, with all columns.

    Of rows that agree in doc_id and text one stays; rows with a null doc_id all stay.
    """
    found = stored(near_duplicates(documents.select(id_column, text_column), id_column=id_column, text_column=text_column, **settings))
    gone = found.where("not kept").select(F.col("doc_id").alias("gone id"), F.col("text_print").alias("gone print"))
    same = (F.col(id_column).cast("long") == F.col("gone id")) & (F.xxhash64(text_column) == F.col("gone print"))
    left = documents.join(gone, same, "left_anti")
    repeated = documents.groupBy(F.col(id_column).alias("gone id"), F.xxhash64(text_column).alias("gone print")).count().where("count > 1 and `gone id` is not null")
    if repeated.isEmpty():
        return left
    again = left.join(repeated, same, "left_semi")
    return left.join(repeated, same, "left_anti").union(again.dropDuplicates([id_column, text_column]))
