"""The trie of conversation prefixes, with subtree sums by the Euler-tour technique.

A prefix is told apart by 128 bits: the exclusive-or of hashes of (position, turn), so a running
exclusive-or over a conversation, taken in chunks, names all its prefixes. A node is known by its
smallest member and its depth; the nodes of one smallest member form a path, straight down.

Each node has an enter and an exit arc. The tour enters a path, goes down to its end and exits upwards; before the
exit of a node at which other paths branch off, it visits these, smallest member first. Between such places the arcs of a path
follow each other, so they are ranked along the path, by sums in chunks of the depth; what is left
of the tour is a linked list of stretches: one for each path (down, and up to the first branch) and one for each node
with branches (from its exit on). That list is ranked by pointer jumping: each round every stretch
adds the sum of the stretch it points to and points to that one's successor. Leaves and savings
weigh on enter arcs, so a subtree's sum is the prefix sum at its top's exit less that before its enter arc.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentally.llm.common import _arrow_schema, as_batch, discard, stored

# Positions of one conversation, or nodes of one path, that a window holds at once.
CHUNK = 1 << 12
# Branching nodes whose paths are looked up by broadcast; all others have fewer than 1 / HOT of the paths.
HOT = 2000
# Ids that one piece of a list of ids holds.
PIECE = 1 << 12


def _chunk(place: str) -> Column:
    return F.call_function("div", F.col(place), F.lit(CHUNK))


def ordered_turns(conversations: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """conv, i (number of the turn, from 0), h1, h2 (hashes of role and text) and size (code points of the text).

    Turns are ordered by turn, null first, then role and text; a null role or text is an empty one. Rows
    without a conversation id belong to none. Rows that repeat are turns of their own. A conversation
    of any length is spread over tasks by ranges of its turns.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = conversations.select(F.col(conv_column).cast("long").alias("conv"), F.col(turn_column).alias("turn"), text(role_column).alias("role"), text(text_column).alias("text"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranged = source.where("conv is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranged.select(
        "conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), F.xxhash64("role", "text").alias("h1"),
        F.xxhash64(F.length("text"), "text", "role").alias("h2"), F.length("text").cast("long").alias("size"),
    ))
    # Only a conversation that runs on from one task's range into the next has turns before its part.
    parts = placed.groupBy("conv", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("conv", "part", F.sum("n").over(earlier).alias("before")).where("before is not null")
    inside = F.col("at") - F.min("at").over(Window.partitionBy("conv", "part"))
    return placed.withColumn("i", inside).join(before, ["conv", "part"], "left").select(
        "conv", (F.col("i") + F.coalesce("before", F.lit(0))).alias("i"), "h1", "h2", "size"
    )


def conversation_lengths(turns: DataFrame) -> DataFrame:
    """conv and its number of turns."""
    return turns.groupBy("conv").agg((F.max("i") + 1).alias("length"))


def grafted(turns: DataFrame, family: int = 100, kinds: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations that begin with turns of the first of their family.

    Conversation c takes the first h turns of c - c % family (fewer where that one is shorter, none where it
    is absent), h = CRC-32 of its decimal id modulo ``kinds``, then its own turns after its first h.
    """
    lengths = conversation_lengths(turns)
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % kinds
    heads = lengths.where(F.col("conv") % family == 0).select(F.col("conv").alias("head"), F.least("length", F.lit(kinds - 1)).alias("given"))
    made = lengths.select("conv", "length", h.alias("h"), (F.col("conv") - F.col("conv") % family).alias("head")).join(heads, "head", "left")
    plan = stored(made.select("conv", "head", "h", "length", F.least("h", F.coalesce("given", F.lit(0))).alias("taken")))
    new = (F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length")
    # One row for each chunk of a conversation, so that a long one meets its plan in many tasks.
    spread = plan.select("conv", "h", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("length") - 1, F.lit(CHUNK)))).alias("chunk"))
    own = turns.withColumn("chunk", _chunk("i")).join(spread, ["conv", "chunk"]).where("i >= h")
    first = turns.where((F.col("conv") % family == 0) & (F.col("i") < kinds - 1)).withColumnRenamed("conv", "head")
    lent = plan.where("taken > 0").select("conv", "head", "taken").join(first, "head").where("i < taken")
    columns = ["h1", "h2", "size"]
    return own.select("conv", (F.col("i") - F.col("h") + F.col("taken")).alias("i"), *columns).unionByName(lent.select("conv", "i", *columns)), plan.select("conv", new)


def _prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv, depth, p1, p2 (the prefix up to the turn), q1, q2 (the one before it), size, and whether the conversation ends there."""
    spread = lengths.where("length > 0").select("conv", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("length") - 1, F.lit(CHUNK)))).alias("chunk"))
    rows = turns.withColumn("chunk", _chunk("i")).join(spread, ["conv", "chunk"]).withColumns({"e1": F.xxhash64("i", "h1", "h2"), "e2": F.xxhash64("h2", "i", "h1", F.lit(1))})
    upto = Window.partitionBy("conv", "chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.bit_xor(f"e{k}").over(upto).alias(f"x{k}") for k in (1, 2)])
    # Chunks before a row's own, for conversations of several chunks.
    totals = rows.where(F.col("length") > CHUNK).groupBy("conv", "chunk").agg(*[F.bit_xor(f"e{k}").alias(f"e{k}") for k in (1, 2)])
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv", "chunk", *[F.bit_xor(f"e{k}").over(earlier).alias(f"c{k}") for k in (1, 2)])
    p = {k: F.coalesce(F.col(f"c{k}"), F.lit(0)).bitwiseXOR(F.col(f"x{k}")) for k in (1, 2)}
    return local.join(carried, ["conv", "chunk"], "left").select(
        "conv", (F.col("i") + 1).alias("depth"), p[1].alias("p1"), p[2].alias("p2"), p[1].bitwiseXOR(F.col("e1")).alias("q1"), p[2].bitwiseXOR(F.col("e2")).alias("q2"),
        "size", (F.col("i") + 1 == F.col("length")).alias("ends"),
    )


def _nodes(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """depth, p1, p2, conv (smallest member), n_convs, q1, q2 (parent), size and n_children of every node."""
    columns = [F.min("conv").alias("conv"), F.count("*").alias("n_convs")]
    below = rows.groupBy("depth", "p1", "p2").agg(*columns, F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("size").alias("size"))
    zero = F.lit(0).cast("long")
    top = lengths.agg(*columns).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv", "n_convs", F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"), zero.alias("size")
    )
    nodes = stored(below.unionByName(top))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    return stored(nodes.join(children, ["depth", "p1", "p2"], "left").fillna(0, ["n_children"]))


def _paths(nodes: DataFrame) -> DataFrame:
    """conv, top (depth of its first node), last (that of its last), parent (smallest member of the node above) and the sums of its nodes."""
    leaf, saved = weights()
    found = nodes.groupBy("conv").agg(
        F.min(F.struct("depth", "q1", "q2")).alias("first"), F.max("depth").alias("last"), F.sum(leaf).alias("leaves"), F.sum(saved).alias("saved")
    )
    paths = stored(found.select("conv", "last", "leaves", "saved", F.col("first.depth").alias("top"), (F.col("first.depth") - 1).alias("depth"), F.col("first.q1").alias("p1"), F.col("first.q2").alias("p2")))
    key = ["depth", "p1", "p2"]
    least = max(1, -(-paths.count() // HOT))
    above = nodes.select(*key, F.col("conv").alias("parent"))
    # At most HOT nodes have that many paths below them, so their rows may be broadcast.
    hot = paths.where("top > 0").groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= least).join(above, key).select(*key, F.col("parent").alias("hot parent"))
    met = stored(paths.join(F.broadcast(hot), key, "left"))
    rest = met.where("`hot parent` is null").join(above, key, "left")
    return stored(met.where("`hot parent` is not null").withColumn("parent", F.col("hot parent")).unionByName(rest).drop("hot parent", "p1", "p2"))


def weights() -> tuple[Column, Column]:
    return (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("size")


def _with_next_sibling(paths: DataFrame) -> DataFrame:
    """Paths with ``sibling``: the next path, by smallest member, below the same node."""
    key = ["parent", "top"]
    ranged = stored(paths.repartitionByRange(*key, "conv").withColumn("part", F.spark_partition_id()))
    inside = F.lead("conv").over(Window.partitionBy(*key, "part").orderBy("conv"))
    heads = ranged.groupBy(*key, "part").agg(F.min("conv").alias("first"))
    later = heads.select(*key, "part", F.lead("first").over(Window.partitionBy(*key).orderBy("part")).alias("later")).where("later is not null")
    return ranged.withColumn("sibling", inside).join(later, [*key, "part"], "left").withColumn("sibling", F.coalesce("sibling", "later")).drop("part", "later")


def _stretches(paths: DataFrame) -> DataFrame:
    """The tour as a linked list: conv, cut (depth of the node whose exit begins the stretch; -1 for the path's
    start), next_conv, next_cut, leaves, saved."""
    ordered = stored(_with_next_sibling(paths))
    branches = ordered.where("top > 0").groupBy(F.col("parent").alias("conv"), F.col("depth").alias("cut")).agg(F.min("conv").alias("branch"))
    starts = ordered.select("conv", F.lit(-1).cast("long").alias("cut"), F.col("last").alias("place"), F.lit(None).cast("long").alias("branch"), "leaves", "saved")
    stops = branches.select("conv", "cut", F.col("cut").alias("place"), "branch", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    # Up the path: a stretch ends at the next branching node above; a start comes before the stops, also that at its own depth.
    rows = starts.unionByName(stops).withColumn("chunk", _chunk("place"))
    up = Window.partitionBy("conv", "chunk").orderBy("place", F.col("cut").isin(-1).cast("int"))
    inside = rows.withColumn("stop", F.lag("branch").over(up))
    heads = rows.groupBy("conv", "chunk").agg(F.max_by("branch", F.when(F.col("branch").isNotNull(), F.col("place"))).alias("b"))
    above = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select("conv", "chunk", F.last("b", ignorenulls=True).over(above).alias("carried")).where("carried is not null")
    linked = inside.join(carried, ["conv", "chunk"], "left").withColumn("stop", F.coalesce("stop", "carried")).drop("carried")
    # Where the path has no more stops: to the next path below the same node, or to that node's exit.
    home = F.when(F.col("sibling").isNotNull(), F.struct(F.col("sibling").alias("conv"), F.lit(-1).cast("long").alias("cut"))).when(
        F.col("top") > 0, F.struct(F.col("parent").alias("conv"), F.col("depth").alias("cut"))
    )
    ends = ordered.select("conv", home.alias("home"))
    return linked.where("stop is null").join(ends, "conv").select("conv", "cut", "leaves", "saved", F.col("home.conv").alias("next_conv"), F.col("home.cut").alias("next_cut")).unionByName(
        linked.where("stop is not null").select("conv", "cut", "leaves", "saved", F.col("stop").alias("next_conv"), F.lit(-1).cast("long").alias("next_cut"))
    )


def list_ranks(links: DataFrame) -> DataFrame:
    """conv, cut, and the sums of leaves and saved from each stretch to the end of the list, by pointer jumping."""
    rows = stored(links)
    for _ in range(math.ceil(math.log2(max(rows.count(), 1)))):
        ahead = rows.select(F.col("conv").alias("next_conv"), F.col("cut").alias("next_cut"), F.struct("next_conv", "next_cut", "leaves", "saved").alias("a"))
        jumped = rows.join(ahead, ["next_conv", "next_cut"], "left").select(
            "conv", "cut", *[(F.col(c) + F.coalesce(F.col(f"a.{c}"), F.lit(0))).alias(c) for c in ("leaves", "saved")], F.col("a.next_conv").alias("next_conv"), F.col("a.next_cut").alias("next_cut")
        )
        new = stored(jumped)
        discard(rows)
        rows = new
    return rows.drop("next_conv", "next_cut")


def _subtrees(nodes: DataFrame, paths: DataFrame, ranks: DataFrame) -> DataFrame:
    """Nodes with n_leaves and saved_tokens: the tour's sum at the exit less that before the enter arc."""
    # Sums to the end of the list fall along the tour, so they count with a minus.
    starts = ranks.where("cut < 0").join(paths.select("conv", "top"), "conv").select("conv", F.col("top").alias("depth"), (-F.col("leaves")).alias("s_leaves"), (-F.col("saved")).alias("s_saved"))
    cuts = ranks.where("cut >= 0").select("conv", F.col("cut").alias("depth"), F.struct((-F.col("leaves")).alias("leaves"), (-F.col("saved")).alias("saved")).alias("stop"))
    leaf, saved = weights()
    rows = nodes.join(starts, ["conv", "depth"], "left").join(cuts, ["conv", "depth"], "left").withColumns({"chunk": _chunk("depth"), "w_leaves": leaf, "w_saved": saved})
    rows = rows.withColumns({f"v_{c}": F.col(f"w_{c}") + F.coalesce(f"s_{c}", F.lit(0)) for c in ("leaves", "saved")})
    path = Window.partitionBy("conv", "chunk").orderBy("depth")
    down, rest = path.rowsBetween(Window.unboundedPreceding, 0), path.rowsBetween(0, Window.unboundedFollowing)
    local = rows.select("*", *[F.sum(f"v_{c}").over(down).alias(f"in_{c}") for c in ("leaves", "saved")], F.first("stop", ignorenulls=True).over(rest).alias("exit"))
    totals = rows.groupBy("conv", "chunk").agg(*[F.sum(f"v_{c}").alias(f"t_{c}") for c in ("leaves", "saved")], F.min_by("stop", F.when(F.col("stop").isNotNull(), F.col("depth"))).alias("t_stop"))
    chunks = Window.partitionBy("conv").orderBy("chunk")
    earlier, later = chunks.rowsBetween(Window.unboundedPreceding, -1), chunks.rowsBetween(1, Window.unboundedFollowing)
    carried = totals.select(
        "conv", "chunk", *[F.coalesce(F.sum(f"t_{c}").over(earlier), F.lit(0)).alias(f"b_{c}") for c in ("leaves", "saved")],
        *[F.sum(f"t_{c}").over(Window.partitionBy("conv")).alias(f"all_{c}") for c in ("leaves", "saved")], F.first("t_stop", ignorenulls=True).over(later).alias("c_exit"),
    )
    joined = local.join(carried, ["conv", "chunk"]).withColumn("exit", F.coalesce("exit", "c_exit"))
    # Without a stop at or below the node, its exit comes in the path's first stretch, after all of the path's enter arcs.
    at_exit = {c: F.coalesce(F.col(f"exit.{c}"), F.col(f"all_{c}")) for c in ("leaves", "saved")}
    sums = {c: (at_exit[c] - F.col(f"b_{c}") - F.col(f"in_{c}") + F.col(f"w_{c}")) for c in ("leaves", "saved")}
    return joined.select("depth", "p1", "p2", "conv", "n_convs", "n_children", sums["leaves"].alias("n_leaves"), sums["saved"].alias("saved_tokens"))


def _with_parents(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """A node's parent is on its own path, but for the path's top."""
    tops = paths.select("conv", F.col("top").alias("depth"), "parent", F.lit(True).alias("is_top"))
    parent = F.when(F.col("is_top"), F.col("parent")).otherwise(F.col("conv"))
    return nodes.join(tops, ["conv", "depth"], "left").withColumn("parent_conv_id", parent).drop("parent", "is_top")


def id_digests(members: DataFrame, key: list[str], id_column: str = "conv") -> DataFrame:
    """key and ends_sha256: SHA-256 of each key's ids in decimal, ascending, joined by commas.

    Ids are sorted by ranges and joined in pieces by many tasks; a key's pieces, each of up to
    PIECE ids, then run through one digest in order, one after another.
    """
    spark = members.sparkSession
    ranged = stored(members.select(*key, id_column)).repartitionByRange(*key, id_column).sortWithinPartitions(*key, id_column)
    kinds = ", ".join(f"{k} long" for k in key)
    pieces_schema = _arrow_schema(spark, f"{kinds}, first long, ids string")
    digest_schema = _arrow_schema(spark, f"{kinds}, ends_sha256 string")
    width = len(key)

    def groups(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        return columns, np.flatnonzero(new)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns, starts = groups(batch)
            ends = np.append(starts[1:], batch.num_rows)
            starts = np.concatenate([np.arange(a, b, PIECE) for a, b in zip(starts, ends)])
            ends = np.append(starts[1:], batch.num_rows)
            ids = batch.column(width)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, batch.num_rows).astype(np.int32)), ids.cast(pa.string()))
            yield as_batch({**{k: c[starts] for k, c in zip(key, columns)}, "first": ids.take(pa.array(starts)), "ids": pc.binary_join(lists, ",")}, pieces_schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for *own, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if own != last:
                    if last is not None:
                        done.append((*last, state.hexdigest()))
                    last, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield as_batch(dict(zip(digest_schema.names, map(list, zip(*done)))), digest_schema)
        if last is not None:
            yield as_batch(dict(zip(digest_schema.names, [[v] for v in (*last, state.hexdigest())])), digest_schema)

    pieces = ranged.mapInArrow(join, f"{kinds}, first long, ids string")
    return pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digest, f"{kinds}, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for every distinct sequence of first turns of a conversation, the empty one included.

    ``turns`` has conv, i, h1, h2 and size (see ``ordered_turns``), ``lengths`` every conversation, also one without
    turns, with its number of turns. Columns: conv_id (smallest member), depth, parent_conv_id (the parent's
    conv_id; null at the root), n_convs (members), n_children, n_leaves and saved_tokens (sums over the node and all
    below it: nodes without children, and (n_convs - 1) times the code points of the last text), ends_sha256 (digest of the ids of
    members that end at the node). No conversations give no rows. Equal conversations share all their
    nodes. No conversation, path, node or list of children is gathered in one task; of a node's member ids one
    task reads pieces in order, since the digest runs over all of them.
    """
    rows = stored(_prefixes(turns, lengths))
    nodes = _nodes(rows, lengths)
    paths = _paths(nodes)
    ranks = list_ranks(_stretches(paths))
    zero = F.lit(0).cast("long")
    key = ["depth", "p1", "p2"]
    ends = rows.where("ends").select(*key, "conv").unionByName(lengths.where("length = 0").select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv"))
    whole = _with_parents(_subtrees(nodes, paths, ranks), paths).join(id_digests(ends, key), key, "left")
    return whole.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
