"""Repository names of working folders, by prefix joins with small tables.

A folder is exploded into its ancestors, which meet the table in an equi-join;
no pair of a folder and an unrelated path is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """The path and every folder above it, without trailing slashes."""
    clean = F.regexp_replace(path, "/+$", "")
    parts = F.split(clean, "/")
    return F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), lambda p: p != "")


def matched(paths: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """(column, table columns) for every table row whose path is the folder or above it."""
    steps = paths.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_above", F.explode(ancestors(F.col(column))))
    rows = table.withColumn("_above", F.regexp_replace("path", "/+$", "")).drop("path")
    return steps.join(rows, "_above")


def alias_names(paths: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """(column, alias): the first alias (path, name, place) that covers each path."""
    return matched(paths, column, aliases).groupBy(column).agg(F.min_by("name", "place").alias("alias"))


def repo_identity(sessions: DataFrame, column: str, roots: DataFrame, aliases: DataFrame, home: str = "") -> DataFrame:
    """Sessions with repo_root, repo_name and verified.

    ``roots`` (path, kind) knows git roots and workspace markers: the deepest
    git root wins, else the outermost marker, else the folder itself.
    """
    found = matched(sessions, column, roots).groupBy(column).agg(
        F.max_by("_above", F.when(F.col("kind") == "git", F.length("_above"))).alias("_git"),
        F.min_by("_above", F.when(F.col("kind") == "marker", F.length("_above"))).alias("_marker"),
    )
    rooted = sessions.join(found, column, "left").withColumn("repo_root", F.coalesce("_git", "_marker", F.regexp_replace(column, "/+$", "")))
    named = rooted.join(alias_names(rooted, "repo_root", aliases), "repo_root", "left")
    base = F.coalesce(F.nullif(F.regexp_extract("repo_root", r"([^/]+)$", 1), F.lit("")), F.lit("unknown-workspace"))
    below_home = F.when(F.col("repo_root").startswith(home + "/"), F.substring(F.col("repo_root"), len(home) + 2, 10_000)) if home else F.lit(None).cast("string")
    name = F.coalesce("alias", F.when(F.col("_git").isNotNull(), base), below_home, base)
    return named.select(*sessions.columns, "repo_root", name.alias("repo_name"), F.col("_git").isNotNull().alias("verified"))
