"""Files of the editor assistant: telemetry, debug logs, transcripts and session states, with their folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.sources import schemas
from tokentally.sources.files import file_name, parse_records, read_lines

# The size of a file up to which it is read, and where files of each kind lie.
MAX_BYTES = 50 * 1024 * 1024
STATE = r"^(.*/session-state/[^/]+)/events\.jsonl$"
STORED = r"^(.*/workspaceStorage/[^/]+)/GitHub\.copilot-chat/(debug-logs|transcripts)/.*\.jsonl$"
TELEMETRY = r"/otel/.*\.jsonl$"


def file_kind(file: Column) -> Column:
    """otel, debug, transcript or session_state; NULL for other files."""
    folder = F.regexp_extract(file, STORED, 2)
    return F.when(folder == "debug-logs", "debug").when(folder == "transcripts", "transcript").when(file.rlike(STATE), "session_state").when(file.rlike(TELEMETRY), "otel")


def owner(file: Column) -> Column:
    """The folder whose workspace file tells where the session ran."""
    return F.nullif(F.concat(F.regexp_extract(file, STORED, 1), F.regexp_extract(file, STATE, 1)), F.lit(""))


def workspace_folders(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """owner and fallback_cwd of every workspace.json and workspace.yaml below a path."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "workspace.{json,yaml}")
    texts = reader.text(path, wholetext=True).select(file_name(F.col("_metadata.file_path")).alias("file"), "value")
    folder = F.trim(F.try_variant_get(F.try_parse_json("value"), "$.folder", "string"))
    decoded = F.when(folder.startswith("file://"), F.url_decode(F.regexp_replace(F.regexp_extract(folder, "^file://[^/]*(/.*)$", 1), r"\+", "%2B"))).otherwise(folder)
    line = F.trim(F.regexp_extract("value", r"(?m)^cwd:[^\S\n]*(\S.*)$", 1))
    cwd = F.when(F.col("file").endswith(".json"), decoded).otherwise(line)
    return texts.select(F.regexp_extract("file", r"^(.*)/[^/]+$", 1).alias("owner"), F.nullif(cwd, F.lit("")).alias("fallback_cwd")).groupBy("owner").agg(F.max("fallback_cwd").alias("fallback_cwd"))


def tagged(lines: DataFrame, folders: DataFrame) -> DataFrame:
    """Lines of the four kinds, with kind, surface and the folder their workspace file names."""
    kind = file_kind(F.col("file"))
    rows = lines.withColumn("kind", kind).where("kind is not null").withColumn("surface", F.when(F.col("kind").isin("debug", "transcript"), "vscode").otherwise("cli"))
    # Folders are looked up by file, not by line.
    owners = rows.select("file").distinct().select("file", owner(F.col("file")).alias("owner")).join(folders, "owner").select("file", "fallback_cwd")
    return rows.join(owners, "file", "left")


def read_editor_records(spark: SparkSession, path: str | list[str], max_bytes: int | None = None, host_pattern: str = r"/host=([^/]+)/") -> DataFrame:
    """Records of all four kinds of files below a path; other files there are not read as logs."""
    lines = read_lines(spark, path, "*.jsonl", host_pattern, max_bytes)
    return parse_records(tagged(lines, workspace_folders(spark, path)), schemas.OTEL)
