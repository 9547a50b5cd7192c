"""Raw documents to token ids: toxic documents go, copies go, near copies go, sources are mixed, texts are encoded.

Each stage is a function of (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the
last return the columns of documents. ``run`` writes what a stage returns and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantseek.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from grantseek.llm.scratch import Scratch

WORDS, PERCENT = 5, 80  # of a shingle; similarity from which on documents are near copies
BATCH_ROWS = 1000  # rows that go to Python at once; what a worker holds grows with them


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier calls toxic. Rows without an id are judged by their text like others."""
    scores = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, scores)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the smallest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id, without an id only if none has one."""
    return ngram_join.drop_near_duplicates(docs, PERCENT, WORDS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for every copy of a document that it takes, and one for a part; n_chars is that of the row's text."""
    return mixing.mixed_documents(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes, a row for each row of the mix."""
    return bpe.encoding_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", remove_toxic), ("exact_dedup", remove_copies), ("ngram_jaccard_join", remove_near_copies), ("mix_sources", mix), ("byte_bpe", encode)]

ORACLE_SQL = None  # a trained classifier and byte-pair merges are beyond SQL; tests/llm checks the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, lean=True)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = scratch.write(stage(spark, docs, sf_dir), BATCH_ROWS)
        if k:
            scratch.drop(docs)
        docs = out
    return docs
