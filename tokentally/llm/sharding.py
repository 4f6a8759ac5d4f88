"""Shards of nearly equal bytes that keep linked documents together: balanced label propagation.

Documents with equal texts are linked. Linked documents start at random shards; in each round
the members of a group that are elsewhere want to move to the open shard that holds most of
the group's bytes (or to one of the several that it needs, if one cannot hold it). Moves are admitted in a random order of groups as long as the room lasts
that a shard's staying members leave (a histogram of the wanted bytes over 1024 ranks of that
order gives the last rank that fits); members of groups too large for that are ranked one by
one, so such a group fills shard after shard, and a full shard takes part no longer. Documents without links then take the room that is left. Last, all documents
stand in the order of their shards and are cut into ranges of equal bytes, which moves only
what stands at the borders and makes the sizes even whatever the rounds left over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentally.llm.common import stored

SHARDS = 24
ROUNDS = 8
RANKS = 1024
# Bytes of each row besides its text.
ROW_BYTES = 8


def _at(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def _loads(state: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["b"] for r in state.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def propagate(state: DataFrame, capacity: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Move rows (group, size, group_bytes, shard and others) to their group's shard under the capacity."""
    shut = [False] * shards
    for turn in range(rounds):
        full = _at(shut, F.col("shard"))
        cells = state.groupBy("group", "shard").agg(F.sum("size").alias("b"), F.first("group_bytes").alias("group_bytes"))
        # At most one entry for each shard; largest first.
        listed = lambda where: F.sort_array(F.collect_list(F.when(where, F.struct("b", F.xxhash64("group", "shard").alias("tie"), "shard"))), asc=False)
        held = F.coalesce(F.sum(F.when(full, F.col("b"))), F.lit(0))
        # A group that no shard can hold takes as many as it needs.
        needed = F.greatest(F.lit(1), F.ceil((F.first("group_bytes") - held) / F.lit(max(1, capacity)))).cast("int")
        wanted = stored(cells.groupBy("group").agg(F.slice(listed(~full), 1, needed).alias("targets"), listed(full).alias("kept")))
        # Ranks of whole groups, or of single rows where a group would not fit anywhere.
        whole = F.col("group_bytes") <= F.lit(capacity // 16)
        rank = F.pmod(F.when(whole, F.xxhash64("group", F.lit(turn))).otherwise(F.xxhash64("doc_id", F.lit(turn))), F.lit(RANKS)).cast("int")
        goal = F.get("targets", F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.size("targets")).cast("int"))
        # Members in a full shard stay if no open shard holds more of the group.
        own = F.filter("kept", lambda x: x["shard"] == F.col("shard"))
        stays = F.array_contains(F.transform("targets", lambda x: x["shard"]), F.col("shard")) | F.coalesce(F.get(own, F.lit(0))["b"] >= F.get("targets", F.lit(0))["b"], F.lit(False))
        ready = state.join(wanted, "group", "left").withColumns({"rank": rank, "target": F.when((F.size("targets") > 0) & ~stays, goal["shard"])})
        ready = ready.withColumn("moving", F.col("target").isNotNull()).drop("targets", "kept")
        # A shard's room is what those leave that stay; without room it takes part no longer.
        room = [max(0, capacity - b) for b in _loads(ready.where("not moving"), shards)]
        tally = ready.where("moving").groupBy("target", "rank").agg(F.sum("size").alias("b"))
        running = F.sum("b").over(Window.partitionBy("target").orderBy("rank"))
        admitted = tally.withColumn("all", running).where(F.col("all") <= _at(room, F.col("target"))).groupBy("target").agg(F.max("rank").alias("last"), F.max("all").alias("b")).collect()
        now_shut = [r <= capacity // 200 for r in room]
        if sum(r["b"] for r in admitted) * 1000 <= capacity and now_shut == shut:
            break
        shut = now_shut
        last = {r["target"]: r["last"] for r in admitted}
        goes = F.col("moving") & (F.col("rank") <= _at([last.get(s, -1) for s in range(shards)], F.col("target")))
        state = stored(ready.withColumn("shard", F.when(goes, F.col("target")).otherwise(F.col("shard"))).drop("target", "rank", "moving"))
    return state


def _cut(placed: DataFrame, total: int, shards: int) -> DataFrame:
    """Ranges of equal bytes of the rows in the order (shard, linked first, group, doc_id), and places in them."""
    order = ["shard", F.col("linked").desc(), "group", "doc_id"]
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(placed.repartitionByRange(tasks, *order).withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    # One row for each task of the range partitioning.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("base_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_n"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = dealt.withColumns({"sum_b": F.sum("size").over(inside), "sum_n": F.row_number().over(inside)})
    middle = F.col("base_b") + F.col("sum_b") - F.expr("size div 2") - 1
    ranged = running.join(F.broadcast(stored(base)), "part").select(
        "doc_id", "size", "text_crc32", F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / F.lit(total))).cast("int").alias("shard"),
        (F.col("base_n") + F.col("sum_n") - 1).alias("at"),
    )
    ranged = stored(ranged)
    first = {r["shard"]: r["at"] for r in ranged.groupBy("shard").agg(F.min("at").alias("at")).collect()}
    return ranged.withColumn("slot", F.col("at") - _at([first.get(s, 0) for s in range(shards)], F.col("shard"))).drop("at")


def shard(documents: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    The size is the number of UTF-8 bytes plus 8; a null text has none and counts as equal to
    an empty one. Rows that repeat are rows of their own in one group; a null doc_id is
    sharded like any other. Slots count from 0 without gaps in each shard. An empty table
    gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = stored(documents.select(
        F.col(id_column).cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"),
    ))
    # 64 + 32 bits and the length tell texts apart; the group's number is made of them.
    rows = rows.withColumn("group", F.xxhash64("hash", "text_crc32", "size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = stored(rows.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("group_bytes")).where("n > 1").drop("n"))
    grouped = stored(rows.drop("hash").join(groups, "group", "left").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("start")), F.lit(shards)).cast("int")))
    # Some slack lets groups gather; the cut makes up for it.
    linked = propagate(grouped.where("group_bytes is not null"), total * 11 // (10 * shards), shards, rounds)
    room = [max(0, total // shards - b) for b in _loads(linked, shards)]
    share, bounds = 0, []
    for r in room[:-1]:
        share += r
        bounds.append(share * (1 << 20) // max(1, sum(room)))
    draw = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(1 << 20))
    free = grouped.where("group_bytes is null").withColumn("shard", sum(((draw >= F.lit(b)).cast("int") for b in bounds), F.lit(0)))
    both = linked.withColumn("linked", F.lit(True)).unionByName(free.withColumn("linked", F.lit(False))).drop("group_bytes")
    return _cut(both, max(1, total), shards)
