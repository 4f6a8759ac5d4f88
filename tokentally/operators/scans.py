"""Ordered scans over one log file, in two levels.

A file is cut into chunks of the record ordinal. Each chunk is scanned on its
own; one summary row per chunk carries what the chunks before it left. A file
that holds a third of all records is thus worked on by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentally.runtime import by_merge

CHUNK = 1 << 20  # ordinals per chunk


def with_chunk(df: DataFrame, order: str, size: int = CHUNK) -> DataFrame:
    return df.withColumn("_chunk", F.call_function("div", F.col(order), F.lit(size)))


def _upto(key: list[str], order: str, end: int) -> Window:
    return Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, end)


def forward_fill(df: DataFrame, key: list[str], order: str, columns: dict[str, Column], chunk: int = CHUNK) -> DataFrame:
    """Add, per new name, the last non-NULL value at or before each row of its key."""
    rows = with_chunk(df, order, chunk).withColumns({f"_v_{name}": value for name, value in columns.items()})
    tails = rows.groupBy(*key, "_chunk").agg(*[
        F.max_by(f"_v_{name}", F.when(F.col(f"_v_{name}").isNotNull(), F.col(order))).alias(f"_t_{name}") for name in columns
    ])
    carried = tails.select(*key, "_chunk", *[
        F.last(f"_t_{name}", ignorenulls=True).over(_upto(key, "_chunk", -1)).alias(f"_c_{name}") for name in columns
    ])
    local = _upto([*key, "_chunk"], order, 0)
    filled = rows.withColumns({f"_v_{name}": F.last(f"_v_{name}", ignorenulls=True).over(local) for name in columns})
    return filled.join(by_merge(carried), [*key, "_chunk"], "left").select(
        *df.columns, *[F.coalesce(f"_v_{name}", f"_c_{name}").alias(name) for name in columns]
    )


def running_sum(df: DataFrame, key: list[str], order: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """Add the sum of a value over the rows of the key up to and including each row."""
    rows = with_chunk(df, order, chunk).withColumn("_v", value)
    totals = rows.groupBy(*key, "_chunk").agg(F.sum("_v").alias("_t"))
    before = totals.select(*key, "_chunk", F.coalesce(F.sum("_t").over(_upto(key, "_chunk", -1)), F.lit(0)).alias("_before"))
    local = F.sum("_v").over(_upto([*key, "_chunk"], order, 0))
    return rows.withColumn("_local", local).join(by_merge(before), [*key, "_chunk"], "left").select(
        *df.columns, (F.col("_before") + F.coalesce("_local", F.lit(0))).alias(name)
    )


def row_places(df: DataFrame, key: list[str], order: str, name: str, ties: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """Add the number of each row in its key, from 1; ``ties`` orders rows of one ordinal."""
    rows = with_chunk(df, order, chunk)
    sizes = rows.groupBy(*key, "_chunk").agg(F.count("*").alias("_n"))
    before = sizes.select(*key, "_chunk", F.coalesce(F.sum("_n").over(_upto(key, "_chunk", -1)), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*key, "_chunk").orderBy(order, *ties))
    return rows.withColumn("_local", local).join(by_merge(before), [*key, "_chunk"]).select(*df.columns, (F.col("_before") + F.col("_local")).alias(name))


def lead_values(df: DataFrame, key: list[str], order: str, k: int) -> DataFrame:
    """The first k rows of each key; at most k rows per key and task reach the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where(F.col("_n") <= k)


def keep_where(df: DataFrame, condition: str) -> DataFrame:
    """Rows that meet a condition on columns which are long to compute.

    A plain filter is pushed below the projection and repeats the whole
    computation there; a generator keeps each column computed once.
    """
    row = F.when(F.expr(condition), F.struct("*"))
    return df.select(F.explode(F.array_compact(F.array(row))).alias("_row")).select("_row.*")
