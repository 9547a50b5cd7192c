"""Hybrid retrieval: keyword and vector candidates, one ranking, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantseek.common import (
    KEYWORD_LIMIT, THRESHOLD, TOP_K, TOP_N, VECTOR_WEIGHT, cut_lineage, split_passes, top_k,
)
from grantseek.functions import text
from grantseek.operators.embedding import score_pass
from grantseek.operators.lexical import CorpusStats, bm25_pass
from grantseek.sources.store import Snapshot

UNNAMED_DOCUMENT = "未命名文档"  # fixed value


def candidates(lex: DataFrame, vec: DataFrame) -> DataFrame:
    """Union of both candidate lists; a missing score is 0."""
    both = lex.select("query_id", "chunk_id", "kw").join(
        vec.select("query_id", "chunk_id", F.col("score").alias("vec")), ["query_id", "chunk_id"], "full")
    return both.select("query_id", "chunk_id", F.coalesce("vec", F.lit(0.0)).alias("vec"),
                       F.coalesce("kw", F.lit(0.0)).alias("kw"), F.col("kw").isNotNull().alias("is_hit"))


def hybrid_search(
    chunks: DataFrame, postings: DataFrame, queries: DataFrame, stats: CorpusStats,
    audience: DataFrame | None = None, *, top: int = TOP_K, weight: float = VECTOR_WEIGHT,
    threshold: float = THRESHOLD, keyword_limit: int = KEYWORD_LIMIT,
) -> DataFrame:
    """Best ``top`` chunks per request by weighted, min-max scaled vector and keyword score.

    Exact, yet one scan of the vectors is enough: a chunk that is no keyword hit
    can only be picked if it is among the best top + keyword_limit by vector, and
    the scaling bounds are two numbers per request. See ``score_pass``.
    """
    if not 0.0 <= weight <= 1.0:
        raise ValueError("weight lies between 0 and 1")
    found = None
    for part in split_passes(queries, "query_id"):
        one = hybrid_pass(chunks, postings, part, stats, audience, top, weight, threshold, keyword_limit)
        found = one if found is None else found.unionByName(one)
    return found


def hybrid_pass(
    chunks: DataFrame, postings: DataFrame, queries: DataFrame, stats: CorpusStats, audience: DataFrame | None,
    top: int, weight: float, threshold: float, keyword_limit: int = KEYWORD_LIMIT,
) -> DataFrame:
    """The search for one pass of requests."""
    top = max(top, 1)
    # At most one pass of requests times keyword_limit rows: small enough to broadcast.
    hits = cut_lineage(bm25_pass(postings, queries, stats, audience, keyword_limit))
    by_chunk = hits.groupBy("chunk_id").agg(F.collect_set("query_id").alias("hits"))
    scope = chunks.select(*[c for c in ("chunk_id", "document_id", "embedding", "model") if c in chunks.columns])
    if audience is not None:
        scope = scope.join(audience, "document_id")
    scope = scope.join(F.broadcast(by_chunk), "chunk_id", "left")
    scanned = cut_lineage(score_pass(scope, queries, k=top + keyword_limit, threshold=threshold,
                                     rank_by_id=weight == 0.0))

    key = ["query_id", "chunk_id"]
    hit_scores = scanned.where("kind = 'hit'").select(*key, F.col("score").alias("vec"))
    kw_side = hits.select(*key, "document_id", "kw").join(hit_scores, key, "left").select(
        *key, "document_id", F.coalesce("vec", F.lit(0.0)).alias("vec"), "kw",
        F.col("vec").isNull().alias("no_vector"), F.lit(True).alias("is_hit"))
    vec_side = scanned.where("kind = 'top'").join(hits.select(*key), key, "left_anti").select(
        *key, "document_id", F.col("score").alias("vec"), F.lit(0.0).alias("kw"),
        F.lit(False).alias("no_vector"), F.lit(False).alias("is_hit"))

    seen = scanned.where("kind = 'stat'").groupBy("query_id").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    kw_seen = kw_side.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_hits"), F.sum(F.col("no_vector").cast("int")).alias("n_bare"),
        F.min("kw").alias("k_min"), F.max("kw").alias("k_max"))
    bare = F.coalesce("n_bare", F.lit(0))
    zero_if_bare = F.when(bare > 0, 0.0)
    whole = F.coalesce("n", F.lit(0)) + bare
    bounds = seen.join(kw_seen, "query_id", "full").select(
        "query_id",
        F.least("lo", zero_if_bare).alias("v_lo"), F.greatest("hi", zero_if_bare).alias("v_hi"),
        F.when(whole > F.coalesce("n_hits", F.lit(0)), 0.0).otherwise(F.col("k_min")).alias("k_lo"),
        F.coalesce("k_max", F.lit(0.0)).alias("k_hi"))

    def scaled(value: str, lo: str, hi: str):
        span = F.col(hi) - F.col(lo)
        return F.when(span < 1e-9, 0.0).otherwise((F.col(value) - F.col(lo)) / span)

    final = F.round(F.lit(weight) * scaled("vec", "v_lo", "v_hi")
                    + F.lit(1.0 - weight) * scaled("kw", "k_lo", "k_hi"), 9)
    ranked = kw_side.unionByName(vec_side).where(F.col("is_hit") | (F.col("vec") >= threshold))
    ranked = ranked.join(bounds, "query_id").select(
        *key, "document_id", F.col("vec").alias("similarity"), "kw", final.alias("final"))
    return top_k(ranked, ["query_id"], [F.desc("final"), F.asc("chunk_id")], top, rank="hybrid_rank",
                 salts=16)


def late_fetch(picked: DataFrame, chunks: DataFrame | Snapshot) -> DataFrame:
    """Text of the winners only; chunks gone meanwhile fall out.

    Winners number requests x top_k; whether they are broadcast is left to their
    measured size at run time. Of a stored index only the buckets of the winners'
    documents are read.
    """
    if isinstance(chunks, Snapshot):
        picked = cut_lineage(picked)
        chunks = chunks.holding(picked)
    extra = [c for c in ("content", "page", "ordinal") if c in chunks.columns]
    return picked.join(chunks.select("chunk_id", *extra), "chunk_id")


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """First occurrence of a chunk per request; rows without a chunk id are all kept."""
    unnamed = F.col("chunk_id").isNull() | (F.col("chunk_id") == "")
    named = top_k(hits.where(~unnamed), ["query_id", "chunk_id"], [F.asc("hybrid_rank")], 1, rank="_copy")
    return named.drop("_copy").unionByName(hits.where(unnamed))


def final_rank(hits: DataFrame, top_n: int = TOP_N, threshold: float | None = THRESHOLD) -> DataFrame:
    """The answer order: by similarity, not by the hybrid score that chose the candidates."""
    kept = hits if threshold is None else hits.where(F.col("similarity") >= threshold)
    return top_k(kept, ["query_id"], [F.desc("similarity"), F.asc("hybrid_rank"), F.asc("chunk_id")], top_n,
                 rank="index")


def citations(hits: DataFrame, documents: DataFrame, kbs: DataFrame) -> DataFrame:
    """Numbered citations with the document's name, collection, address, author and page.

    Hits are few (top_n for each request): their ids pick the documents where they are read, and only those move.
    """
    have = set(documents.columns)
    doc = documents.join(hits.select("document_id").distinct().hint("broadcast"), "document_id", "left_semi").select(
        "document_id", F.col("name").alias("_name"), "kb_id",
        *[(F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in ("original_url", "author")])
    meta = doc.join(kbs.select("kb_id", F.col("name").alias("kb_name")), "kb_id", "left")
    keyword = F.col("document_keyword") if "document_keyword" in hits.columns else F.lit(None).cast("string")
    page = F.col("page") if "page" in hits.columns else F.lit(None).cast("int")
    blank = lambda c: F.when(F.length(c) > 0, c)
    return hits.join(meta, "document_id", "left").select(
        "query_id", F.col("index"), "chunk_id", "document_id",
        F.coalesce(blank(F.col("_name")), blank(keyword), F.lit(UNNAMED_DOCUMENT)).alias("document_name"),
        "kb_id", "kb_name", text.strip(F.col("content")).alias("content"),
        F.round("similarity", 4).alias("similarity"), "original_url", "author",
        F.when(page != 0, page).alias("page"))
