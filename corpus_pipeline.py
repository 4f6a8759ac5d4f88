"""A corpus pipeline over the ``documents`` table: from raw documents to packed sequences.

Each stage takes all documents its predecessor kept. All but the last return the columns of
``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.llm.common import stored
from tokentally.llm.decontaminate import mark_contaminated
from tokentally.llm.minhash import without_near_duplicates
from tokentally.llm.packing import pack
from tokentally.llm.quality import fit, score
from tokentally.llm.queries import table, tokenizer
from tokentally.llm.substring_dedup import dedup_substrings


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, does not reject."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, into="quality score").where("`quality score` >= 0.5").drop("quality score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return without_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that an earlier one has; others are unchanged."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    found = dedup_substrings(docs, carry=[*others, "n_chars"])
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("rest.n_chars"))
    rows = found.select("doc_id", text.alias("text"), *[F.col(f"rest.`{c}`") for c in others], size.alias("n_chars"))
    return rows.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    marked = mark_contaminated(docs, table(spark, sf_dir, "benchmark"), into="benchmark hits")
    return marked.where(F.size("benchmark hits") == 0).drop("benchmark hits")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 tokens."""
    places, _ = pack(docs, tokenizer("word_bpe_49k.json"))
    return places


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("decontamination", decontamination), ("packing", packing)]
# Classifier, signatures and tokenizer are beyond SQL; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
