"""Session settings and the few helpers that touch the cluster."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Rows a table may have before it is sent to every executor (a rate card row
# is about 300 bytes, so the largest broadcast stays near 30 MB).
BROADCAST_ROW_LIMIT = 100_000


def build_session(app: str = "tokentally", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SESSION_SETTINGS.items():
        builder = builder.config(key, value)
    if master:
        # Inside one process the driver's heap is all the memory there is.
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


# Day and hour keys are UTC. Call-site capture costs a few round trips to the
# JVM for every column expression and is of use in notebooks only. A few fields
# of a parsed record are estimated at their share of its wide struct, a fiftieth
# of their size or less, so tables are broadcast by a hint or by the size they
# are measured at after a shuffle, never by an estimate.
SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC", "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "1MB",
}


# Whether the shuffle files of a job are deleted when it ends. A table once written is read from its files alone.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Give an existing session the settings the queries rely on."""
    for key, value in SESSION_SETTINGS.items():
        if spark.conf.get(key, None) != value and spark.conf.isModifiable(key):
            spark.conf.set(key, value)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; one of our own only where none is set and Spark runs inside this process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tokentally-checkpoint-"))
    return _own[0]


_own: list[str] = []


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the folder the cluster names."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def parsed_once(records: DataFrame) -> DataFrame:
    """A table that many parts of a query read, written as columns to the folder the cluster names.

    Records are parsed once; each part then reads the fields it needs, and no plan holds the parser. What was shuffled
    to make the table leaves the disk once it is written.
    """
    spark = records.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/tokentally-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        records.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREED, before) if before is not None else spark.conf.unset(FREED)
    return spark.read.schema(records.schema).parquet(path)


def by_merge(df: DataFrame) -> DataFrame:
    """A table that grows with the input, to be joined by sort and merge.

    The plan itself says so: a caller may run it under other broadcast settings than those it was built under.
    """
    return df.hint("merge")


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small literal table the optimizer knows the size of."""
    table = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)


def small_table(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> pa.Table | None:
    """The rows of a small table, or None when it has more than ``limit``."""
    table = df.limit(limit + 1).toArrow()
    return table if table.num_rows <= limit else None
