"""Queries over the test tables, one for each operator, with SQL twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where a public tokenizer file lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.packing import pack

    places, _ = pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return places


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.substring_dedup import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_print")


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.decontaminate import mark_contaminated

    marked = mark_contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", F.explode("benchmark_hits").alias("hit")).select("doc_id", "hit.*")


@query
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.embed_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.sharding import shard

    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.token_output import packed_sequences

    return packed_sequences(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 49_408)


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns recovered from transcripts that are written from all conversations; the model learns from a fifth of them, chosen by a hash."""
    from tokentally.llm import chat
    from tokentally.llm.common import stored

    lines = stored(chat.transcript_lines(table(spark, sf_dir, "conversations")))
    learned = lines.where(F.pmod(F.xxhash64("conv_id", F.lit("learn")), F.lit(5)) == 0)
    return chat.turns(lines, chat.fit(learned, chat.SPAN), chat.SPAN)


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.quality import fit, score

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    model = fit(documents, table(spark, sf_dir, "labels").where(~held_out))
    scored = score(documents, model).drop("text")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.periodic_runs import find_runs, with_periods

    found = find_runs(with_periods(table(spark, sf_dir, "documents")))
    # The greatest length over period first, compared by cross products; then the smallest start and period.
    shares = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]
    rank = lambda a, b: F.coalesce(*[F.nullif(F.signum(d.cast("double")), F.lit(0.0)) for d in (shares(b, a), a["start"] - b["start"], a["period"] - b["period"])], F.lit(0.0)).cast("int")
    best = F.get(F.array_sort("runs", rank), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.call_function("div", F.col("best.length") * 1000, F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.prefix_trie import grafted, ordered_turns, prefix_trie

    return prefix_trie(*grafted(ordered_turns(table(spark, sf_dir, "conversations"))))


@query
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentally.llm.pii import find_personal_data, fit

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(documents, fit(documents))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
