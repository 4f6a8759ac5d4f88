"""Log files as rows: one row per line, with a stable place in its file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokentally.functions.records import file_stem

ROW_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in its low 33 bits


def _host(pattern: str) -> Column:
    return F.regexp_extract("file", pattern, 1)


def file_name(uri: Column) -> Column:
    """The plain path of a file's URI."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(uri, r"\+", "%2B"), "^file:/+", "/"))


def list_files(spark: SparkSession, path: str | list[str], glob: str = "*.{jsonl,log}", host_pattern: str = r"/host=([^/]+)/") -> DataFrame:
    """Matching files without their text: uri, host, file, mtime_ms, size."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    named = listed.select(F.col("path").alias("uri"), file_name(F.col("path")).alias("file"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"))
    return named.withColumn("host", _host(host_pattern))


def read_lines(
    spark: SparkSession, path: str | list[str], glob: str = "*.{jsonl,log}", host_pattern: str = r"/host=([^/]+)/",
    max_bytes: int | None = None,
) -> DataFrame:
    """Lines of every matching file below a path: host, file, ord, line, mtime_ms, size.

    A line's ordinal is its number in the file, from 0, blank lines counted, however the file is split.
    Files are split between tasks, so one huge file is read by many. A first pass counts the lines of each block, sums of
    earlier blocks give where each block begins, and the second pass adds the row number in the block.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    rows = reader.text(path).select(
        F.col("_metadata.file_path").alias("_uri"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"),
        F.unix_millis("_metadata.file_modification_time").alias("mtime_ms"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("line"),
    )
    # Both passes split the files alike, so a row has the same id in both; ids of a block follow each other.
    blocks = rows.groupBy("_uri", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_uri").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begins = blocks.select("_uri", "_block", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    lines = rows.where(F.col("size") <= max_bytes) if max_bytes is not None else rows
    named = lines.join(begins, ["_uri", "_block"]).withColumn("file", file_name(F.col("_uri")))
    return named.select(
        _host(host_pattern).alias("host"), "file", (F.col("_id") + F.col("_shift")).alias("ord"),
        F.regexp_replace("line", r"^\s+|\s+$", "").alias("line"), "mtime_ms", "size",
    ).where("line <> ''")


def read_documents(spark: SparkSession, path: str | list[str], glob: str = "*.json", host_pattern: str = r"/host=([^/]+)/") -> DataFrame:
    """Records of files that are one JSON document: the items of a list, or the object itself.

    A document can only be parsed whole, so these files are read whole; one
    that does not parse is read line by line instead.
    """
    docs = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True).select(
        file_name(F.col("_metadata.file_path")).alias("file"),
        F.unix_millis("_metadata.file_modification_time").alias("mtime_ms"), F.col("_metadata.file_size").alias("size"),
        F.col("value").alias("body"), F.try_parse_json("value").alias("doc"),
    )
    # The parser stops after the first value, so a file whose first line is a value
    # of its own and is followed by more is lines, not a document.
    content = F.filter(F.split("body", r"\r?\n"), lambda l: F.trim(l) != "")
    is_lines = F.coalesce((F.size(content) > 1) & F.try_parse_json(F.get(content, F.lit(0))).isNotNull(), F.lit(False))
    docs = docs.withColumn("doc", F.when(~is_lines, F.col("doc")))
    items = F.expr("coalesce(try_cast(doc AS array<variant>), array(doc))")
    whole = docs.where("doc is not null").select("file", "mtime_ms", "size", F.posexplode(items).alias("ord", "_item")).select(
        "file", F.col("ord").cast("bigint").alias("ord"), F.to_json("_item").alias("line"), "mtime_ms", "size"
    )
    lines = docs.where("doc is null").select("file", "mtime_ms", "size", F.posexplode(F.split("body", r"\r?\n")).alias("ord", "line")).select(
        "file", F.col("ord").cast("bigint").alias("ord"), F.trim("line").alias("line"), "mtime_ms", "size"
    ).where("line <> ''")
    return whole.unionByName(lines).select(_host(host_pattern).alias("host"), "*")


def read_bodies(spark: SparkSession, path: str | list[str], glob: str, host_pattern: str = r"/host=([^/]+)/") -> DataFrame:
    """Small files as a whole: host, file, body."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    texts = reader.text(path, wholetext=True).select(file_name(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("body"))
    return texts.select(_host(host_pattern).alias("host"), "file", "body")


def parse_records(lines: DataFrame, schema: str) -> DataFrame:
    """Lines with rec, parsed once by a schema, and ``bad`` where a line is not JSON.

    The generator keeps later filters from repeating the parse. What they ask of the line itself comes out of it
    too: a test of the line alone would move below the parse, and there build each line anew for every use. A value of
    another type than the schema's reads as NULL and does not make a line bad.
    """
    parsed = F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    cut_off = F.col("line").startswith("{") & ~F.col("line").endswith("}")
    rows = lines.select("*", F.explode(F.array(F.struct(parsed.alias("rec"), cut_off.alias("cut_off")))).alias("_p")).select(*lines.columns, "_p.rec", "_p.cut_off")
    suspect = F.col("rec._corrupt").isNotNull()
    return rows.withColumn("bad", F.when(suspect, F.try_parse_json("line").isNull()).otherwise(F.lit(False)) | F.col("cut_off")).drop("cut_off")


def parse_errors(records: DataFrame) -> DataFrame:
    """One row per line that is not JSON, coded by its line number, from 1."""
    return records.where("bad").select("host", "file", "ord", F.concat(F.lit("jsonl_line_"), (F.col("ord") + 1).cast("string")).alias("error"))


def listing(lines: DataFrame) -> DataFrame:
    """One row per file with its id: the file name without extension."""
    files = lines.groupBy("host", "file").agg(F.max("mtime_ms").alias("mtime_ms"), F.max("size").alias("size"), F.count("*").alias("lines"))
    return files.withColumn("id", file_stem(F.col("file")))


def latest_per_id(files: DataFrame) -> DataFrame:
    """The last file, by path, of each id on a host."""
    return files.groupBy("host", "id").agg(F.max_by(F.struct("file", "mtime_ms", "size", "lines"), "file").alias("f")).select("host", "id", "f.*")


def history_entries(lines: DataFrame) -> DataFrame:
    """One row: how many lines of a history file parse."""
    return lines.agg(F.count_if(F.try_parse_json("line").isNotNull()).alias("entries"))
