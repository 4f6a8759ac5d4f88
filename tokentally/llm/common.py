"""Shared folder, Arrow text access and vectorised words, hashes and windows."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that a Python worker holds in arrays at once (one longer text is a block of its own).
BLOCK_BYTES = 4 << 20
# Words longer than this are hashed one by one.
LONG_WORD = 1 << 12

U64 = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=U64) | U64(1)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTE_FOLDED = _BYTE[_FOLD]
_POWER = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(LONG_WORD, 0x9E3779B97F4A7C15, U64)]))
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=U64) | U64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def shared_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``; a folder of our own only in a local session without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/tokentally-{uuid.uuid4().hex}"


_OWN: list[str] = []


def _own_folder() -> str:
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tokentally-"))
    return _OWN[0]


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that ``stored`` wrote and nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` for a function from a RecordBatch to an iterable of column dicts."""
    arrow_schema = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for columns in function(batch):
                    yield as_batch(columns, arrow_schema)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema) -> pa.Schema:
    """The Arrow schema of a DDL string or a Spark schema."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)


def as_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema]
    return pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    spans = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[spans[0] : spans[-1]], spans - spans[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi with their bytes and offsets, about ``limit`` bytes at a time; texts stay whole."""
    raw, offsets = text_buffers(column)
    lo, rows = 0, len(column)
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on unsigned 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def grouped_arange(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every count, one after another."""
    counts = np.asarray(counts, np.int64)
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def word_spans(data: np.ndarray, offsets: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) and the index of each row's first word.

    With two tables of bytes, a word is also cut where a byte of ``after`` follows one of ``before``.
    """
    inside = ~SPACE[data]
    borders = offsets[offsets < len(data)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[borders] = inside[borders]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_at = offsets[offsets > 0] - 1
    last[ends_at] = inside[ends_at]
    if before is not None:
        cuts = np.flatnonzero(before[data[:-1]] & after[data[1:]])
        last[cuts] = True
        first[cuts + 1] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans that do not overlap; ``fold`` ignores ASCII case."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    long = np.flatnonzero(lengths > LONG_WORD)
    used = np.minimum(lengths, LONG_WORD)
    place = grouped_arange(used)
    values = (_BYTE_FOLDED if fold else _BYTE)[data[np.repeat(starts, used) + place]]
    values *= _POWER[place]
    result = np.add.reduceat(values, np.cumsum(used) - used)
    for i in long:
        span = data[starts[i] : ends[i]].tobytes()
        result[i] = int.from_bytes(hashlib.blake2b(span.lower() if fold else span, digest_size=8).digest(), "little")
    return mix(result ^ lengths.astype(U64))


def windows(first_word: np.ndarray, size: int) -> np.ndarray:
    """Indexes of the words at which a window of ``size`` words of one row starts."""
    counts = np.maximum(np.diff(first_word) - size + 1, 0)
    return np.repeat(first_word[:-1], counts) + grouped_arange(counts)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each index on (rows are not looked at)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = words[:n] * _PLACE[0]
    for j in range(1, size):
        total += words[j : n + j] * _PLACE[j]
    return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """Connected components of an undirected graph: rows (node, component = smallest node).

    Alternating star contraction: every node hands its smallest neighbour to its larger
    neighbours, then to its smaller ones, until nothing changes. Minima are aggregated
    before they are joined back, so a hub is never gathered in one task; each round is
    written to the shared folder.
    """
    edges = stored(edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v")).where("u <> v").distinct())
    while True:
        # Large star: larger neighbours of u point to the smallest of u and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours point to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        new = stored(small)
        mark = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark(new) == mark(edges):
            break
        edges = new
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def annotate(df: DataFrame, text_column: str, function, added: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns with new columns computed from a text column.

    ``function(bytes, offsets)`` returns the new columns of a block of rows. A column of the
    input that has the name of a new one is replaced. Rows are neither moved nor reordered.
    """
    from pyspark.sql import types as T

    new = T._parse_datatype_string(added)
    kept = [f for f in df.schema.fields if f.name not in new.names]
    schema = T.StructType([*kept, *new.fields])
    source = df.select(*[_quoted(f.name) for f in kept], F.col(_quoted(text_column)).cast("string").alias("text to read"))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for lo, hi, data, offsets in blocks(batch.column(batch.num_columns - 1), limit):
                found = function(data, offsets)
                arrays = [batch.column(i).slice(lo, hi - lo) for i in range(len(kept))]
                for f in list(arrow_schema)[len(kept) :]:
                    values = found[f.name]
                    arrays.append(values if isinstance(values, pa.Array) and values.type == f.type else pa.array(values, f.type))
                yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, arrow_schema)], schema=arrow_schema)

    return source.mapInArrow(run, schema)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
