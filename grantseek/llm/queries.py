"""Registered queries of the training-data operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantseek.llm import bpe, conversations, exact_dedup, html_extract, language_id, mixing, neighbours, ngram_join, periodic, repeats, token_counts, token_file, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


@_query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encoding_digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@_query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


@_query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


@_query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


@_query
def op6_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).drop("spans")


@_query
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).drop("copies", "spans")


@_query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


ORACLES["op8_exact_dedup"] = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
WINDOW same AS (PARTITION BY body)
"""


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.file_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def _repeated_tails(docs: DataFrame) -> DataFrame:
    """The texts in which op12 looks for runs: in one of ten, picked by its id, the words from one on repeat with a period."""
    words, n = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"), F.size("words").cast("long")
    hash_ = F.crc32(F.col("doc_id").cast("string"))
    picked = docs.select("doc_id", "text", hash_.alias("h"), F.when(F.pmod(hash_, F.lit(10)) == 0, words).alias("words"))
    g = F.floor(F.col("h") / 10)
    start = picked.select("doc_id", "text", "words", g.alias("g"), F.pmod(g, F.greatest(n, F.lit(1))).alias("a"), n.alias("n"))
    period = F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.pmod("g", F.lit(8))))
    planned = start.withColumn("p", period)
    tail, times = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int")), F.ceil((F.col("n") - F.col("a")) / F.col("p"))
    repeated = F.slice(F.flatten(F.array_repeat(tail, times.cast("int"))), F.lit(1), (F.col("n") - F.col("a")).cast("int"))
    whole = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), repeated), " ")
    return planned.select("doc_id", F.when(F.col("n") > 0, whole).otherwise(F.col("text")).alias("text"))


@_query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(_repeated_tails(_table(spark, sf_dir, "documents")))


def _damaged(table: DataFrame) -> DataFrame:
    """The turns that op13 repairs: some are dropped, emptied, cut, repeated or given to the user, picked by conversation and turn."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind, text = F.pmod(F.crc32(key), F.lit(20)), F.coalesce("text", blank)
    rows = table.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return rows.drop("copy")


@_query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations")
    return conversations.Repair(_damaged(table)).report(table)


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
