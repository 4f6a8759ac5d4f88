"""Continuous forms of the request queries, over a folder of request rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tokentally.operators import transcripts
from tokentally.sources import schemas
from tokentally.sources.files import parse_records


def stream_requests(spark: SparkSession, path: str, schema: StructType, lateness: str = "1 hour") -> DataFrame:
    """Requests as they arrive, each request and message id once within the lateness.

    The first row of an id is kept; the batch query keeps the largest counts.
    """
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["session_id", "request_id", "message_id"])


def usage_by_hour(requests: DataFrame) -> DataFrame:
    """Tokens and requests per hour and model."""
    hour = F.window("ts", "1 hour")
    rows = requests.groupBy(hour, F.coalesce("model", F.lit("unknown-model")).alias("model")).agg(F.count("*").alias("requests"), F.sum("total_tokens").alias("total_tokens"))
    return rows.select(F.col("window.start").alias("hour"), "model", "requests", "total_tokens")


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what has arrived, append closed hours to ``out``, and stop."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


# ---------------------------------------------------------------- usage of streamed messages

LINES = "host string, file string, ord bigint, line string, mtime_ms bigint"


def stream_transcript_usage(spark: SparkSession, path: str) -> DataFrame:
    """Usage rows of transcript lines as they arrive in a folder of Parquet files."""
    return transcripts.usage_rows(parse_records(spark.readStream.schema(LINES).parquet(path), schemas.TRANSCRIPT))


def keep_usage(stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> None:
    """Write the merged parts of each micro-batch to a folder of its own below ``out``, and stop when all that arrived is read.

    Counts of a request are largest values over its copies, so parts of different batches merge
    however late a copy comes, and no state is kept between batches. A batch that runs again writes the
    same folder again, so a restart neither loses nor doubles a copy.
    """

    def keep(batch: DataFrame, number: int) -> None:
        transcripts.merge_usage(transcripts.usage_parts(batch)).write.mode("overwrite").parquet(f"{out}/batch={number:012d}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start().awaitTermination()


def usage_so_far(spark: SparkSession, out: str) -> DataFrame:
    """Each request once, from all parts that are kept: what ``distinct_usage`` gives for all rows at once."""
    return transcripts.merged_usage(transcripts.merge_usage(spark.read.option("basePath", out).parquet(out).select(*transcripts.PART)))
