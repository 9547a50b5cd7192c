"""Exact dedup in DataFrame functions: 128-bit content hash, smallest id, bytes compared inside a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantseek.llm.scratch import named

# Runs of white space that are not one space already; what else there is stays as it is.
_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    """Every run of space, tab, line feed, vertical tab, form feed or carriage return as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUN, " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are. Rows are grouped by two 64-bit hashes *and* the text, so equal hashes of
    different texts make different groups; Spark combines copies inside every task before it moves one of them.
    The decision goes back to the rows by hash and SHA-256, without the text, and a group of any size can be split
    over tasks there. Null text counts as empty. Rows without an id are counted and never stay. An id that comes
    twice with equal texts is one document: both rows say ``kept``. Other columns are not read.
    """
    text = normalized(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("body")).select(
        "id", "body", F.xxhash64("body").alias("h1"), F.xxhash64(F.lit(20011), "body").alias("h2"))
    groups = (rows.groupBy("h1", "h2", "body").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
              .select("h1", "h2", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size"))
    marked = rows.select("id", "h1", "h2", F.sha2("body", 256).alias("text_sha256"))
    return (marked.join(groups, ["h1", "h2", "text_sha256"])
            .select(F.col("id").alias(id_col), "keep_id", "group_size",
                    F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of equal texts, all columns: that of the smallest id, without an id only if none has one.

    Rows are decided on, not ids: a text of its own stays whatever else bears its id. Of rows of one id and text the
    one with the smallest hash of its columns stays. Texts are equal when both 64-bit hashes and the SHA-256 of their normalised bytes are.
    Every task keeps one row of a group before anything is moved, and nothing is joined.
    """
    body = normalized(F.col(text_col))
    plain = [named(f.name) for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]  # maps have no hash
    order = F.struct(F.col(id_col).isNull().alias("without"), F.col(id_col).alias("id"), F.xxhash64(*plain).alias("tie"))
    rows = docs.select(F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(20011), body).alias("h2"), F.sha2(body, 256).alias("sha256"),
                       order.alias("order"), F.struct(*map(named, docs.columns)).alias("row"))
    return rows.groupBy("h1", "h2", "sha256").agg(F.min_by("row", "order").alias("row")).select("row.*")
