"""Near-duplicate embeddings by cross-polytope hashing.

Vectors are rotated by three rounds of random signs and a fast Hadamard transform; a hash is
the coordinate of largest size with its sign, and a table's bucket is a pair of hashes of two
rotations. A vector lives in one bucket of each table and also visits the buckets it would
have got next (the smallest loss of squared size). Pairs of which at least one lives in the
bucket are compared by cosine in double precision. Equal vectors are one vector with a
weight. A pair that meets more than once is counted in the first bucket where it meets, which
both vectors' buckets tell, so links are counted where they are found and never listed; for
the components each bucket passes on a star for each of its connected parts. Buckets above a
size are cut into blocks, and pairs of blocks go to separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.llm.common import U64, _arrow_schema, as_batch, components, mix, signed, stored

COSINE = 0.93
# Of pairs at cosine 0.93, about one in 4,000 is missed (64 dimensions); of closer ones, fewer.
TABLES, PROBES = 8, 3
ROUNDS, HASHES, CHOICES = 3, 2, 4
BLOCK_ROWS = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; the width is a power of two."""
    width = x.shape[1]
    half = 1
    while half < width:
        pairs = x.reshape(len(x), width // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), width)
        half *= 2
    return x / np.sqrt(width)


def buckets(vectors: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """Bucket numbers (rows, tables, 1 + probes); the first of each table is the home."""
    rows, dim = vectors.shape
    width = max(2, 1 << (dim - 1).bit_length())
    unit = np.zeros((rows, width))
    unit[:, :dim] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    signs = np.random.default_rng([7, width]).choice([-1.0, 1.0], (tables, HASHES, ROUNDS, width))
    choices = min(CHOICES, width)
    result = np.empty((rows, tables, 1 + probes), np.int64)
    for t in range(tables):
        code, loss = np.zeros((rows, 1), np.int64), np.zeros((rows, 1))
        for h in range(HASHES):
            x = unit
            for r in range(ROUNDS):
                x = hadamard(x * signs[t, h, r])
            size = np.abs(x)
            order = np.argsort(-size, axis=1, kind="stable")[:, :choices]
            top = np.take_along_axis(size, order, 1)
            own = order * 2 + (np.take_along_axis(x, order, 1) < 0)
            code = (code[:, :, None] * (2 * width) + own[:, None, :]).reshape(rows, -1)
            loss = (loss[:, :, None] + (top[:, :1] ** 2 - top**2)[:, None, :]).reshape(rows, -1)
        best = np.argsort(loss, axis=1, kind="stable")[:, : 1 + probes]
        result[:, t, : best.shape[1]] = np.take_along_axis(code, best, 1)
        result[:, t, best.shape[1] :] = -1
    return result


def first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Table and bucket, as one number, where pairs of rows of ``buckets`` meet first (table * 2**40 + bucket)."""
    home_a, home_b = a[:, :, :1], b[:, :, :1]
    never = np.int64(1) << 62
    at_a = np.where((home_a == b).any(axis=2), home_a[:, :, 0], never)
    at_b = np.where((home_b == a).any(axis=2), home_b[:, :, 0], never)
    bucket = np.minimum(at_a, at_b)
    table = np.argmax(bucket < never, axis=1)
    return (table.astype(np.int64) << 40) + np.take_along_axis(bucket, table[:, None], 1)[:, 0]


def _placed(unique: DataFrame, double: bool, tables: int, probes: int, with_vector: bool) -> DataFrame:
    """A row for each bucket a vector lives in or visits: key, meeting, home, uid, weight, vector."""
    ddl = "key long, meeting long, home boolean, uid long, weight long" + (", vector binary" if with_vector else "")
    schema = _arrow_schema(unique.sparkSession, ddl)
    kind = np.float64 if double else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            uid, weight, label = (batch.column(i).to_numpy() for i in range(3))
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype(kind)
            dims = np.diff(offsets)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                vectors = flat[offsets[rows][:, None] + np.arange(dim)]
                for lo in range(0, len(rows), 1024):
                    part = rows[lo : lo + 1024]
                    code = buckets(vectors[lo : lo + 1024].astype(np.float64), tables, probes)
                    i, t, p = np.nonzero(code >= 0)
                    meeting = (t.astype(np.int64) << 40) + code[i, t, p]
                    salt = mix(mix(label[part].astype(np.int64).view(U64)) + U64(dim))
                    columns = {"key": signed(mix(salt[i] ^ mix(meeting.view(U64)))), "meeting": meeting, "home": p == 0, "uid": uid[part][i], "weight": weight[part][i]}
                    if with_vector:
                        raw = pa.array([v.tobytes() for v in vectors[lo : lo + 1024]], pa.binary())
                        columns["vector"] = raw.take(pa.array(i))
                    yield as_batch(columns, schema)

    return unique.select("uid", "weight", "label", "embedding").mapInArrow(run, ddl)


def _linked(placed: DataFrame, cosine: float, double: bool, tables: int, probes: int) -> DataFrame:
    """(uid, links, near): links first met in a bucket and a representative of the bucket's connected part."""
    ddl = "uid long, links long, near long"
    schema = _arrow_schema(placed.sparkSession, ddl)
    kind = np.float64 if double else np.float32

    def compare(rows: dict) -> dict | None:
        n = len(rows["uid"])
        home, block, other = rows["home"], rows["block"], rows["other"][0]
        vectors = np.frombuffer(b"".join(rows["vector"]), kind).reshape(n, -1).astype(np.float64)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        left, right, links = [], [], np.zeros(n, np.int64)
        for lo in range(0, n, 1024):
            near = unit[lo : lo + 1024] @ unit.T >= cosine
            near &= home[lo : lo + 1024, None] | home[None, :]
            near &= np.arange(n)[None, :] > np.arange(lo, min(n, lo + 1024))[:, None]
            # A task of a large bucket takes the pairs between two blocks, or within one.
            if other >= 0:
                near &= (block[lo : lo + 1024, None] != block[None, :]) if rows["one"][0] != other else True
            a, b = np.nonzero(near)
            left.append(a + lo)
            right.append(b)
        left, right = np.concatenate(left), np.concatenate(right)
        if not len(left):
            return None
        used, place = np.unique(np.concatenate([left, right]), return_inverse=True)
        code = buckets(vectors[used], tables, probes)
        a, b = place[: len(left)], place[len(left) :]
        for lo in range(0, len(left), 1 << 16):
            cut = slice(lo, lo + (1 << 16))
            here = first_meeting(code[a[cut]], code[b[cut]]) == rows["meeting"][0]
            np.add.at(links, left[cut][here], rows["weight"][right[cut][here]])
            np.add.at(links, right[cut][here], rows["weight"][left[cut][here]])
        label = np.arange(n)
        while True:
            before = label.copy()
            np.minimum.at(label, right, label[left])
            np.minimum.at(label, left, label[right])
            label = label[label]
            if (label == before).all():
                break
        return {"uid": rows["uid"][used], "links": links[used], "near": rows["uid"][label[used]]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "meeting", "home", "uid", "weight", "block", "one", "other")
        held: list[pa.RecordBatch] = []

        def finished(table: pa.Table, drop_last: bool):
            rows = {c: table.column(c).to_numpy() for c in names}
            same = (rows["key"][1:] == rows["key"][:-1]) & (rows["one"][1:] == rows["one"][:-1]) & (rows["other"][1:] == rows["other"][:-1])
            edge = np.concatenate([[0], np.flatnonzero(~same) + 1, [table.num_rows]])
            if drop_last:
                edge = edge[:-1]
            vectors = table.column("vector").to_pylist()
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if hi - lo > 1 and rows["home"][lo:hi].any():
                    found = compare({c: rows[c][lo:hi] for c in names} | {"vector": vectors[lo:hi]})
                    if found:
                        yield as_batch(found, schema)
            held[:] = table.slice(edge[-1]).combine_chunks().to_batches() if drop_last else []

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield from finished(pa.Table.from_batches(held), True)
        if held:
            yield from finished(pa.Table.from_batches(held), False)

    dealt = placed.repartition("key", "one", "other").sortWithinPartitions("key", "one", "other")
    return dealt.mapInArrow(run, ddl)


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Rows are linked when their labels and numbers of dimensions are equal and their cosine is
    at least ``cosine``. Rows with a null label, and vectors that are null, empty, zero or hold
    null or non-finite components, have no links and are components of their own. Rows that
    repeat are rows of their own, linked with each other. Other columns are ignored.
    """
    double = dict(embeddings.dtypes)[vector_column] == "array<double>"
    vector = F.col(vector_column).cast("array<double>" if double else "array<float>")
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), vector.alias("embedding"))
    sound = F.col("label").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("uid", F.when(sound, F.xxhash64("label", "embedding")))
    unique = stored(rows.where("uid is not null").groupBy("uid").agg(F.count("*").alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("least")))
    placed = _placed(unique, double, tables, probes, True).withColumns({"block": F.lit(0), "one": F.lit(-1), "other": F.lit(-1)})
    crowded = stored(_placed(unique, double, tables, probes, False).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS))
    if not crowded.isEmpty():
        blocks = F.ceil(F.col("n") / F.lit(BLOCK_ROWS)).cast("int")
        cut = placed.drop("block", "one", "other").join(crowded.withColumn("blocks", blocks).drop("n"), "key", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"), F.lit(0)))
        with_all = cut.withColumn("j", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))).drop("blocks")
        placed = with_all.withColumns({"one": F.when(F.col("j") < 0, -1).otherwise(F.least("block", "j")), "other": F.when(F.col("j") < 0, -1).otherwise(F.greatest("block", "j"))}).drop("j")
    found = stored(_linked(placed, cosine, double, tables, probes))
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    parts = components(found, "uid", "near").withColumnsRenamed({"node": "uid", "component": "part"})
    named = unique.select("uid", "weight", "least").join(links, "uid", "left").join(parts, "uid", "left").withColumn("part", F.coalesce("part", "uid"))
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    known = named.join(least, "part").select("uid", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    return rows.select("vec_id", "uid").join(known, "uid", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
