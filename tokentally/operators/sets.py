"""Distinct unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.functions import warnings as W


def distinct_warnings(sessions: DataFrame, group: str) -> DataFrame:
    """Sorted distinct warning codes per group.

    Codes are made distinct before they are collected, so a group brings its
    vocabulary to the last step and not its sessions.
    """
    codes = sessions.select(group, F.explode("warnings").alias("_w")).distinct()
    return codes.groupBy(group).agg(F.array_sort(F.collect_list("_w")).alias("warnings"))


def warning_details(sessions: DataFrame) -> DataFrame:
    """One row per warning code in use, most urgent first."""
    used = sessions.select(F.explode("warnings").alias("warning")).groupBy("warning").agg(F.count("*").alias("sessions"))
    rows = used.withColumn("_d", W.detail(F.col("warning"))).select("warning", W.readable(F.col("warning")).alias("text"), "_d.*", "sessions")

    def place(column: str, order: list[str]):
        return F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))

    return rows.orderBy(place("category", W.CATEGORY_ORDER), place("tone", W.TONE_ORDER), "title", "warning")
