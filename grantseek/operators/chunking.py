"""Documents to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from grantseek.common import CHUNK_MIN, CHUNK_OVERLAP, CHUNK_SIZE
from grantseek.functions import arrow, text


def recursive_split(df: DataFrame, column: str, size: int = CHUNK_SIZE) -> DataFrame:
    """Add ``pieces``: parts of the text no longer than ``size``, cut at the strongest boundaries."""
    return df.withColumn("pieces", arrow.pieces_of(F.col(column), size))


def chunk_sections(
    df: DataFrame, size: int | None = CHUNK_SIZE, overlap: int | None = CHUNK_OVERLAP,
    min_size: int | None = CHUNK_MIN,
) -> DataFrame:
    """Overlapping chunks of documents with ``sections`` (array of text and page).

    A document is one row, so ordinals that run across its sections need no
    shuffle. Columns besides ``sections`` are kept.
    """
    size = size or CHUNK_SIZE
    overlap = CHUNK_OVERLAP if overlap is None else overlap
    min_size = min_size or CHUNK_MIN
    keep = [c for c in df.columns if c != "sections"]
    split = df.withColumn("_chunks", arrow.split_sections(F.col("sections"), size, overlap, min_size))
    rows = split.select(*keep, F.posexplode("_chunks").alias("ordinal", "_chunk"))
    return rows.select(
        text.make_chunk_id(F.col("document_id"), F.col("ordinal")).alias("chunk_id"), *keep, "ordinal",
        F.col("_chunk.content").alias("content"), F.col("_chunk.page").alias("page"),
        text.approx_tokens(F.col("_chunk.content")).alias("tokens"))


class ChunkText:
    """Table function ``chunk_text(text [, size [, overlap [, min_size]]])``: ordinal, content, tokens.

    For SQL: ``SELECT d.id, c.* FROM docs d, LATERAL chunk_text(d.text) c``. A missing text gives no row; a size that is
    missing or null has its default.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, *sizes: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError(f"chunk_text takes a text, not {text.dataType.simpleString()}")
        if len(sizes) > 3:
            raise ValueError("chunk_text takes a text, a size, an overlap and a least size")
        for given in sizes:
            if given.isConstantExpression and given.value is not None and (not isinstance(given.value, int) or given.value < 0):
                raise ValueError("sizes of chunk_text are whole numbers from 0 on")
        schema = StructType().add("ordinal", IntegerType()).add("content", StringType()).add("tokens", IntegerType())
        return AnalyzeResult(schema)

    def eval(self, text: str, *sizes: int):
        size, overlap, least = [*sizes, None, None, None][:3]
        size, least = size or CHUNK_SIZE, least or CHUNK_MIN
        overlap = CHUNK_OVERLAP if overlap is None else overlap
        for ordinal, content in enumerate(arrow.split_text(text or "", size, overlap, least)):
            yield ordinal, content, len(content) // 4


def register_chunk_function(spark: SparkSession, name: str = "chunk_text") -> str:
    """Make ``ChunkText`` known to SQL; returns its name."""
    spark.udtf.register(name, F.udtf(ChunkText))
    return name


def hard_chunks(df: DataFrame, column: str, size: int = CHUNK_SIZE) -> DataFrame:
    """Chunks by length alone, for text without any boundary."""
    body = text.strip(F.col(column))
    count = F.ceil(F.char_length(body) / size).cast("int")
    cuts = F.when(count > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))),
        lambda i: F.substr(body, i * size + 1, F.lit(size))))
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.posexplode(cuts).alias("ordinal", "content"))


def line_chunks(df: DataFrame, column: str) -> DataFrame:
    """One chunk per line."""
    keep = [c for c in df.columns if c != column]
    rows = df.select(*keep, F.posexplode(F.split(column, "\n")).alias("ordinal", "content"))
    return rows.withColumn("chunk_id", text.make_chunk_id(F.col("document_id"), F.col("ordinal")))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Chunks, tokens and characters per document."""
    return chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.sum(text.approx_tokens(F.col("content"))).alias("token_count"),
        F.sum(F.char_length("content")).cast("bigint").alias("char_count"))
