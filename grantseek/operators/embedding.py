"""Encoding text and scoring vectors."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantseek.common import TOP_K, split_passes, top_k
from grantseek.operators.best import Best, Floor

EMBED_BATCH = 16  # fixed value: texts per encoder call

PASS_SCHEMA = (
    "kind string, query_id bigint, chunk_id string, document_id string, score double, "
    "n bigint, lo double, hi double"
)


def hashing_encoder(dim: int = 64) -> Callable[[Sequence[str]], np.ndarray]:
    """A deterministic bag-of-words encoder, for tests and for use without a model."""
    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for word in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(word.encode())
                out[i, h % dim] += 1.0 if (h >> 16) & 1 else -1.0
        return out
    return encode


def unit_rows(mat: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(mat, axis=1, keepdims=True)
    return (mat / np.where(size == 0, 1.0, size)).astype(np.float32)


def embed(
    df: DataFrame, column: str, make_encoder: Callable[[], Callable] = hashing_encoder, *,
    out: str = "embedding", instruction: str = "", batch: int = EMBED_BATCH,
) -> DataFrame:
    """Add a unit vector per row. The encoder is built once per Python worker task."""
    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for s in batches:
            texts = [instruction + ("" if t is None else t) for t in s]
            rows: list[np.ndarray] = []
            for at in range(0, len(texts), batch):
                rows.extend(unit_rows(np.asarray(encoder(texts[at:at + batch]), dtype=np.float32)))
            yield pd.Series(rows, dtype=object)
    return df.withColumn(out, encode(column))


def vector_health(chunks: DataFrame) -> DataFrame:
    """Chunks whose vector length differs from the most common one in their dataset."""
    sized = chunks.select("dataset_id", "chunk_id", F.size("embedding").alias("dim"))
    counts = sized.groupBy("dataset_id", "dim").agg(F.count(F.lit(1)).alias("n"))
    usual = counts.groupBy("dataset_id").agg(F.max_by("dim", F.struct("n", "dim")).alias("usual_dim"))
    return sized.join(usual, "dataset_id").where("dim <> usual_dim")


def min_max_norm(df: DataFrame, column: str, by: str, out: str) -> DataFrame:
    """Scale a column to 0..1 within each key; a flat key gives 0.

    Only one (min, max) pair per key is shuffled and joined back.
    """
    bounds = df.groupBy(by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(span < 1e-9, 0.0).otherwise((F.col(column) - F.col("_lo")) / span)
    return df.join(bounds, by).withColumn(out, scaled).drop("_lo", "_hi")


def _ragged(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row number of every list element, and the elements."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.repeat(np.arange(len(column)), lengths), column.flatten()


WIDE = 1 << 20  # best rows of all requests that a task holds
SENT = 1 << 16  # rows of a batch sent on beyond that


def score_pass(
    chunks: DataFrame, queries: DataFrame, *, k: int, threshold: float | None = None, rank_by_id: bool = False,
) -> DataFrame:
    """One scan of the vectors for a bounded batch of requests.

    chunks: chunk_id, document_id, embedding, and optionally ``audience`` (ids of
    the scopes that may search the chunk), ``hits`` (requests whose keyword
    search found it) and ``model``.
    queries: query_id, qvec, and optionally scope_id and model. The batch is at
    most one pass (see ``split_passes``), so its matrix is small by construction.

    Rows that come back: kind ``stat`` (number, least and greatest score in
    scope), ``top`` (best ``k`` per task with score >= threshold) and ``hit``
    (score of every keyword hit). Nothing of size requests x chunks leaves a task,
    unless ``k`` asks for it: more than ``WIDE`` best rows are not held but sent
    on as they come, without those below the floor, and cut by the caller.
    """
    has = set(chunks.columns)
    q = queries.select(
        "query_id", F.col("qvec").cast("array<double>").alias("qvec"),
        (F.col("scope_id") if "scope_id" in queries.columns else F.col("query_id")).alias("scope_id"),
        (F.col("model") if "model" in queries.columns else F.lit("")).alias("model")).toPandas()
    groups = []
    for (model, dim), part in q.groupby([q["model"], q["qvec"].map(len)]):
        groups.append((model, dim, part["query_id"].to_numpy(np.int64), part["scope_id"].to_numpy(np.int64),
                       np.array(part["qvec"].tolist(), dtype=np.float64).T))
    floor = -np.inf if threshold is None else threshold
    asked = k * sum(len(g[2]) for g in groups)
    wide = asked > WIDE and not rank_by_id
    floored = asked <= 4 * WIDE  # a floor holds k scores a request

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, rank_by_id)
        needed = [Floor(k, np.full(len(g[2]), floor)) for g in groups]
        stats: dict[int, list[float]] = {}
        for batch in batches:
            table = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            owner, values = _ragged(table["embedding"])
            values = values.to_numpy(zero_copy_only=False).astype(np.float64)
            dims = np.bincount(owner, minlength=batch.num_rows)
            starts = np.concatenate(([0], np.cumsum(dims)))[:-1]
            models = (table["model"].to_numpy(zero_copy_only=False) if "model" in table
                      else np.full(batch.num_rows, "", dtype=object))
            ids = table["chunk_id"].to_numpy(zero_copy_only=False)
            docs = table["document_id"].to_numpy(zero_copy_only=False)
            aud = _ragged(table["audience"]) if "audience" in table else None
            hit = _ragged(table["hits"]) if "hits" in table else None
            for (model, dim, query_ids, scope_ids, mat), enough in zip(groups, needed, strict=True):
                rows = np.flatnonzero((dims == dim) & (models == model))
                if not len(rows):
                    continue
                vecs = values[starts[rows][:, None] + np.arange(dim)[None, :]]
                scores = np.round(vecs @ mat, 6) + 0.0
                allowed = np.ones(scores.shape, dtype=bool)
                if aud is not None:
                    scopes, column = np.unique(scope_ids, return_inverse=True)
                    seen = np.zeros((batch.num_rows, len(scopes)), dtype=bool)
                    who = aud[1].to_numpy(zero_copy_only=False).astype(np.int64)
                    at = np.minimum(np.searchsorted(scopes, who), len(scopes) - 1)
                    known = scopes[at] == who
                    seen[aud[0][known], at[known]] = True
                    allowed = seen[rows][:, column]
                for j in np.flatnonzero(allowed.any(axis=0)):
                    col = scores[allowed[:, j], j]
                    n, lo, hi = stats.get(query_ids[j], (0, np.inf, -np.inf))
                    stats[query_ids[j]] = (n + len(col), min(lo, col.min()), max(hi, col.max()))
                if k:
                    fits = allowed & (scores >= floor) if rank_by_id or not floored else enough.fits(scores, allowed)
                    r, j = np.nonzero(fits)
                    if not wide:
                        best.add(query_ids[j], ids[rows[r]], docs[rows[r]], scores[r, j])
                    for at in range(0, len(r) if wide else 0, SENT):
                        r_, j_ = r[at: at + SENT], j[at: at + SENT]
                        yield _rows("top", len(r_), query_id=query_ids[j_], chunk_id=ids[rows[r_]], document_id=docs[rows[r_]], score=scores[r_, j_])
                if hit is not None and len(hit[0]):
                    place = np.full(batch.num_rows, -1)
                    place[rows] = np.arange(len(rows))
                    want = hit[1].to_numpy(zero_copy_only=False).astype(np.int64)
                    order = np.argsort(query_ids)
                    at = order[np.minimum(np.searchsorted(query_ids[order], want), len(query_ids) - 1)]
                    ok = (query_ids[at] == want) & (place[hit[0]] >= 0)
                    if ok.any():
                        who, row = want[ok], hit[0][ok]
                        yield _rows("hit", len(row), query_id=who, chunk_id=ids[row], document_id=docs[row],
                                    score=scores[place[row], at[ok]])
        if stats:
            yield _rows("stat", len(stats), query_id=list(stats), n=[v[0] for v in stats.values()],
                        lo=[v[1] for v in stats.values()], hi=[v[2] for v in stats.values()])
        query, chunk, document, score = best.rows()
        if len(query):
            yield _rows("top", len(query), query_id=query, chunk_id=chunk, document_id=document, score=score)

    wanted = [c for c in ("chunk_id", "document_id", "embedding", "audience", "hits", "model") if c in has]
    if not groups:
        return chunks.sparkSession.createDataFrame([], PASS_SCHEMA)
    return chunks.select(*wanted).mapInArrow(scan, PASS_SCHEMA)


_ARROW_SCHEMA = pa.schema([
    ("kind", pa.string()), ("query_id", pa.int64()), ("chunk_id", pa.string()), ("document_id", pa.string()),
    ("score", pa.float64()), ("n", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64())])


def _rows(kind: str, count: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array([kind] * count, pa.string()) if f.name == "kind"
              else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type)
              for f in _ARROW_SCHEMA]
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW_SCHEMA)


def dot_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Number, least and greatest exact score of every request over the chunks in its scope."""
    found = [score_pass(chunks, q, k=0).where("kind = 'stat'") for q in split_passes(queries, "query_id")]
    return _union(found).groupBy("query_id").agg(
        F.sum("n").alias("n_scored"), F.min("lo").alias("min_score"), F.max("hi").alias("max_score"))


def vector_topk(chunks: DataFrame, queries: DataFrame, k: int = TOP_K, threshold: float | None = None) -> DataFrame:
    """Exact nearest chunks of every request."""
    found = [score_pass(chunks, q, k=k, threshold=threshold).where("kind = 'top'")
             for q in split_passes(queries, "query_id")]
    return top_k(_union(found).select("query_id", "chunk_id", "document_id", "score"), ["query_id"],
                 [F.desc("score"), F.asc("chunk_id")], k, salts=16)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
