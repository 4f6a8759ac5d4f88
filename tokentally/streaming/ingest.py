"""Incremental ingest of growing log files.

A file source sees a path once, but logs grow. A ledger keeps what was read of
each file; a file whose size or time is not in it is read again, whatever its
time, and its newest reading replaces the older one for every reader. A reading
counts only once the ledger names its batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.sources.files import list_files, read_lines

FILE_STATE = ["host", "file", "mtime_ms", "size"]
PARSER_VERSION = 1


def changed_files(listing: DataFrame, ledger: DataFrame, version: int = PARSER_VERSION) -> DataFrame:
    """Files whose path, time or size the ledger does not hold for this parser."""
    done = ledger.where(F.col("version") == version).select(*FILE_STATE)
    return listing.join(done, FILE_STATE, "left_anti")


def current_lines(lines: DataFrame, ledger: DataFrame) -> DataFrame:
    """The lines of each file's newest reading that the ledger holds."""
    newest = ledger.groupBy("host", "file").agg(F.max_by("batch", "attempt").alias("batch"))
    return lines.join(newest, ["host", "file", "batch"], "left_semi")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


LINES_SCHEMA = "host string, file string, ord bigint, line string, mtime_ms bigint, size bigint, batch string"
LEDGER_SCHEMA = "host string, file string, mtime_ms bigint, size bigint, version int, attempt bigint, batch string"


def ingest(spark: SparkSession, source: str, lines_path: str, ledger_path: str, **reader) -> DataFrame:
    """Read what changed below ``source`` since the last call; returns the current lines.

    Files are listed without their text and compared with the ledger by path,
    time and size, so files that arrive late with an older time are read too.
    Each attempt has a batch name of its own, lines are written before the
    ledger, and only lines of batches in the ledger are current: what a run
    left that died half-way is never read.
    """
    ledger = _table(spark, ledger_path, LEDGER_SCHEMA)
    attempt = (ledger.agg(F.max("attempt")).first()[0] or 0) + 1
    batch = uuid.uuid4().hex
    changed = changed_files(list_files(spark, source, **reader), ledger)
    # Paths alone come to the driver, which lists them for any read anyway.
    found = changed.select(*FILE_STATE, "uri").toArrow()
    if found.num_rows:
        state = spark.createDataFrame(found).drop("uri")
        fresh = read_lines(spark, found.column("uri").to_pylist(), **reader).withColumn("batch", F.lit(batch))
        # A file that grew since it was listed has another state, and is read next time.
        same = fresh.join(state, FILE_STATE, "left_semi")
        same.select("host", "file", "ord", "line", "mtime_ms", "size", "batch").write.mode("append").parquet(lines_path)
        done = state.withColumns({"version": F.lit(PARSER_VERSION), "attempt": F.lit(attempt).cast("bigint"), "batch": F.lit(batch)})
        done.select("host", "file", "mtime_ms", "size", "version", "attempt", "batch").write.mode("append").parquet(ledger_path)
    return current_lines(_table(spark, lines_path, LINES_SCHEMA), _table(spark, ledger_path, LEDGER_SCHEMA))
