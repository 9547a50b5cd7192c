"""The lexical index and keyword search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantseek.common import KEYWORD_LIMIT, cut_lineage, split_passes, top_k
from grantseek.functions import text

# Published Okapi constants and the floor that keeps every hit above zero.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6
TOKENIZER_MODE = "bigram"


def with_tokens(chunks: DataFrame, column: str = "content") -> DataFrame:
    """Add ``lex``: the distinct index tokens of the chunk."""
    return chunks.withColumn("lex", text.lex_tokens(F.col(column)))


def build_postings(chunks: DataFrame) -> DataFrame:
    """(token, chunk_id, document_id, dl); a token counts once per chunk."""
    source = chunks if "lex" in chunks.columns else with_tokens(chunks)
    return source.select(F.explode("lex").alias("token"), "chunk_id", "document_id", F.size("lex").alias("dl"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    """Chunks per token over the whole index. Counts are combined before the shuffle."""
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def corpus_totals(chunks: DataFrame) -> DataFrame:
    """One row: chunks and mean number of tokens, chunks without tokens included."""
    source = chunks if "lex" in chunks.columns else with_tokens(chunks)
    return source.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg(F.size("lex")).alias("avg_dl"))


@dataclass(frozen=True)
class CorpusStats:
    """Statistics of the whole index: written when the index is, read by every search."""

    totals: DataFrame
    frequencies: DataFrame


def corpus_stats(chunks: DataFrame) -> CorpusStats:
    """Both statistics, written once."""
    return CorpusStats(cut_lineage(corpus_totals(chunks)), cut_lineage(document_frequencies(build_postings(chunks))))


@dataclass(frozen=True)
class StoredPostings:
    """A stored lexical index as a keyword search reads it.

    postings: token, dl, chunk_id, document_id in files that lie in order of (token, dl). lexicon: chunk_id, document_id, lex.
    """

    postings: DataFrame
    lexicon: DataFrame
    n_chunks: int
    n_tokens: int

    @property
    def avg_dl(self) -> float:
        return self.n_tokens / self.n_chunks if self.n_tokens else 1.0


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, scope_id, token) for questions that do not carry terms yet."""
    terms = F.col("terms") if "terms" in queries.columns else text.query_tokens(F.col("question"))
    scope = F.col("scope_id") if "scope_id" in queries.columns else F.col("query_id")
    return queries.select("query_id", scope.alias("scope_id"), F.explode(F.array_distinct(terms)).alias("token"))


def bm25_search(
    postings: DataFrame | StoredPostings, queries: DataFrame, stats: CorpusStats, audience: DataFrame | None = None,
    limit: int = KEYWORD_LIMIT,
) -> DataFrame:
    """Best ``limit`` chunks per request by Okapi BM25 over any matching term.

    Statistics come from the whole index. ``audience`` (document_id, audience:
    scope ids) restricts hits to documents the request may search. Request terms
    are broadcast, at most one pass of them, so a frequent token is never a join
    key of a shuffle. With postings bucketed by chunk the sum needs no shuffle
    either, and each task sends on at most ``limit`` rows per request. With
    ``StoredPostings`` only the postings that can still reach the answer are
    read (see ``ranked``); the answer is the same.
    """
    found = None
    for part in split_passes(queries, "query_id"):
        hits = bm25_pass(postings, part, stats, audience, limit)
        found = hits if found is None else found.unionByName(hits)
    return found


def bm25_pass(
    postings: DataFrame | StoredPostings, queries: DataFrame, stats: CorpusStats, audience: DataFrame | None, limit: int,
) -> DataFrame:
    """The search for one pass of requests."""
    if isinstance(postings, StoredPostings):
        from grantseek.operators import ranked
        return ranked.bounded_pass(postings, queries, stats.frequencies, audience, limit)
    row = stats.totals.first()
    n_chunks, avg_dl = int(row["n_chunks"]), float(row["avg_dl"] or 0.0) or 1.0
    terms = query_terms(queries)
    df = stats.frequencies.join(F.broadcast(terms.select("token").distinct()), "token")
    idf = F.greatest(F.log((F.lit(float(n_chunks)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    weighted = terms.join(df, "token").select("token", "query_id", "scope_id", idf.alias("idf"))
    matched = postings.join(F.broadcast(weighted), "token")
    scored = matched.groupBy("query_id", "scope_id", "chunk_id", "document_id", "dl").agg(F.sum("idf").alias("idf"))
    if audience is not None:
        scored = scored.join(audience, "document_id").where(F.array_contains("audience", F.col("scope_id")))
    length = F.lit(1.0) + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("dl") / F.lit(avg_dl))
    scored = scored.select("query_id", "chunk_id", "document_id",
                           F.round(F.col("idf") * F.lit(K1 + 1.0) / length, 6).alias("kw"))
    return top_k(scored, ["query_id"], [F.desc("kw"), F.asc("chunk_id")], limit, rank="kw_rank",
                 salts=16)


def substring_search(chunks: DataFrame, keyword: str, case_sensitive: bool = False) -> DataFrame:
    """Chunks whose text holds the keyword."""
    c = F.col("content")
    return chunks.where(c.contains(keyword) if case_sensitive else text.like_filter(c, keyword))


def tokenizer_mode_check(index_meta: DataFrame, current: str = TOKENIZER_MODE) -> DataFrame:
    """Index metadata (key, value) rows built with another tokenizer, with a warning."""
    return index_meta.where((F.col("key") == "token_mode") & (F.col("value") != current)).select(
        F.col("value").alias("built_with"), F.lit(current).alias("current_mode"),
        F.lit("tokenizer changed: parse the documents again").alias("warning"))
