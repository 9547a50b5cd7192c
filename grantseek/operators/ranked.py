"""Exact keyword top-k over stored postings that reads only what can still matter.

A token counts once in a chunk, so the score of a chunk with ``dl`` tokens is the sum of the idf of the request's tokens in it, times a
factor that falls with ``dl``. With the tokens of a request in order of idf, a chunk whose first token is the j-th
scores at most the sum of the next ``dl`` of them from the j-th on, times the factor. This gives two rounds:

1. The chunks of the rarest tokens, until these have some times ``limit`` postings. They get their whole score for every request of the
   pass from their own tokens; the ``limit``-th best of a request is a floor that its answer cannot be below.
2. Of every other token only the postings of lengths at which the bound reaches the floor. A chunk of the answer has a first token,
   and its posting is among them. The chunks found get their whole score in the same way.

If a round finds very many postings, all chunks get their score in one scan of their tokens, which moves none of them; that is the answer.

Postings are stored in order of (token, dl): the tokens of a pass skip row groups, and so do the lengths. Scores of a batch of chunks are
a sparse product: tokens of the chunks with the weights of the requests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantseek.common import cut_lineage, top_k
from grantseek.operators import lexical
from grantseek.operators.best import Best, Floor

FIRST = 5  # times the limit: postings of the first round
CLOSE = 2e-6  # scores are rounded to six places; a bound this much below the floor may still round up to it
BROADCAST_CHUNKS = 500_000  # postings whose chunk ids are sent to every task at most; of more, all chunks are scored where they lie
CELLS = 1 << 20  # of the largest matrix in a task
ANY = (0, 2**31 - 1)  # every length
CODED = "document_id string, chunk_id string, dl bigint, codes array<int>"
CODED_NAMES = ["document_id", "chunk_id", "dl", "codes"]
FOUND = "query_id bigint, chunk_id string, document_id string, kw double"


def idf(df: int, n_chunks: int) -> float:
    return max(math.log((n_chunks - df + 0.5) / (df + 0.5)), lexical.IDF_FLOOR)


def factor(dl: float, avg_dl: float) -> float:
    return (lexical.K1 + 1.0) / (1.0 + lexical.K1 * (1.0 - lexical.B + lexical.B * dl / avg_dl))


def lengths_above(weights: Sequence[float], floor: float, avg_dl: float) -> tuple[int, int] | None:
    """Least and greatest length at which a chunk may reach the floor by tokens of these weights (descending); None if none does.

    Up to as many tokens as there are weights the bound may rise and fall; beyond, it falls with the length.
    """
    if floor <= 0:
        return 0, 2**31 - 1
    reach, total = [], 0.0
    for dl, weight in enumerate(weights, 1):
        total += weight
        if total * factor(dl, avg_dl) >= floor:
            reach.append(dl)
    # total * (k1 + 1) / (1 + k1 (1 - b + b dl / avg)) >= floor
    last = ((total * (lexical.K1 + 1.0) / floor - 1.0) / lexical.K1 - (1.0 - lexical.B)) * avg_dl / lexical.B
    if last >= len(weights):
        reach.append(min(math.floor(last), 2**31 - 1))
    return (reach[0], reach[-1]) if reach else None


class _Request:
    """The tokens of a request that occur in the index, in order of idf."""

    def __init__(self, query_id: int, scope_id: int, found: list[tuple[str, int]], n_chunks: int):
        self.query_id, self.scope_id = query_id, scope_id
        self.tokens = sorted(((idf(df, n_chunks), token, df) for token, df in found), key=lambda t: (-t[0], t[1]))

    def first(self, postings: int) -> int:
        """How many tokens the first round takes."""
        seen = 0
        for k, (_, _, df) in enumerate(self.tokens):
            seen += df
            if seen >= postings:
                return k + 1
        return len(self.tokens)


def _pass_requests(index: lexical.StoredPostings, queries: DataFrame, frequencies: DataFrame) -> list[_Request]:
    """Requests of a pass with the frequencies of their tokens: at most a pass times 32 rows reach the driver."""
    asked = lexical.query_terms(queries).collect()
    tokens = sorted({r["token"] for r in asked})
    known = {r["token"]: r["df"] for r in frequencies.where(one_of("token", tokens)).collect()} if tokens else {}
    by: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for r in asked:
        by.setdefault((r["query_id"], r["scope_id"]), [])
        if r["token"] in known:
            by[r["query_id"], r["scope_id"]].append((r["token"], int(known[r["token"]])))
    return [_Request(q, s, found, index.n_chunks) for (q, s), found in by.items() if found]


def one_of(column: str, values: Sequence[str]):
    """``column IN (...)`` as text: thousands of values are one call."""
    quoted = ",".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"{column} IN ({quoted})")


def matching(postings: DataFrame, terms: dict[str, tuple[int, int]]) -> DataFrame:
    """Postings of the tokens at the lengths that go with them; tokens and the greatest length are filters of the scan."""
    rows = postings.where(one_of("token", sorted(terms)))
    if all(reach == ANY for reach in terms.values()):
        return rows
    rows = rows.where((F.col("dl") >= min(r[0] for r in terms.values())) & (F.col("dl") <= max(r[1] for r in terms.values())))
    wanted = rows.sparkSession.createDataFrame([(t, *r) for t, r in terms.items()], "token string, least int, most int")
    return rows.join(F.broadcast(wanted), "token").where(F.col("dl").between(F.col("least"), F.col("most")))  # a pass times 32 rows at most


def _scored(
    index: lexical.StoredPostings, found: DataFrame, requests: list[_Request], audience: DataFrame | None, limit: int, floors: dict[int, float],
) -> tuple[DataFrame, bool]:
    """(query_id, chunk_id, document_id, kw): the best ``limit`` of each request in each task, not below its floor, of the chunks found; and
    whether these were all chunks, because too many were found."""
    whole, scoped = found.count() > BROADCAST_CHUNKS, audience is not None
    rows = index.lexicon.where("chunk_id is not null")
    if not whole:
        rows = rows.join(F.broadcast(cut_lineage(found.select("chunk_id").distinct())), "chunk_id", "left_semi")
    # The requests of each token and its weight in them: a pass times 32 numbers.
    pairs = sorted((t[1], q, t[0]) for q, r in enumerate(requests) for t in r.tokens)
    vocabulary = pa.array(sorted({p[0] for p in pairs}), pa.string())
    bounds = np.searchsorted(np.array([p[0] for p in pairs]), np.array([*vocabulary.to_pylist()]))
    bounds, asking, weight = np.append(bounds, len(pairs)), np.array([p[1] for p in pairs]), np.array([p[2] for p in pairs])
    ids, scopes = np.array([r.query_id for r in requests]), np.array([r.scope_id for r in requests])
    floor, avg_dl = np.array([floors.get(r.query_id, 0.0) for r in requests]), index.avg_dl

    def coded(batch: pa.RecordBatch) -> pa.RecordBatch:
        """(document_id, chunk_id, dl, codes): rows with a token of the pass, and which these are."""
        lex = batch.column(2)
        lengths = np.nan_to_num(lex.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        code = pc.index_in(lex.flatten(), value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
        count = np.bincount(np.repeat(np.arange(batch.num_rows), lengths)[code >= 0], minlength=batch.num_rows)
        some = pa.array(np.flatnonzero(count))
        codes = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count[count > 0]))), pa.int32()), pa.array(code[code >= 0], pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(1).take(some), batch.column(0).take(some), pa.array(lengths).take(some), codes], names=CODED_NAMES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, needed = Best(limit), Floor(limit, floor)
        for batch in batches:
            if not scoped:
                batch = coded(batch)
            document, chunk = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lengths, codes = batch.column(2).to_numpy(), batch.column(3)
            code = codes.flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), codes.value_lengths().to_numpy())
            listed = batch.column(4) if batch.num_columns > 4 else None
            step = max(1, CELLS // len(ids))
            for begin in range(0, batch.num_rows, step):
                rows = np.arange(begin, min(begin + step, batch.num_rows))
                part = slice(*np.searchsorted(owner, (begin, begin + step)))
                times = (bounds[1:] - bounds[:-1])[code[part]]
                pair = np.repeat(bounds[code[part]] - np.cumsum(times) + times, times) + np.arange(times.sum())
                cell = np.repeat((owner[part] - begin) * len(ids), times) + asking[pair]
                scores = np.bincount(cell, weights=weight[pair], minlength=len(rows) * len(ids)).reshape(len(rows), len(ids))
                scores *= ((lexical.K1 + 1.0) / (1.0 + lexical.K1 * (1.0 - lexical.B + lexical.B * lengths[rows] / avg_dl)))[:, None]
                allowed = scores > 0  # a token is shared, even if the score rounds to nothing
                scores = np.round(scores, 6)
                if listed is not None:
                    allowed &= _allowed(listed, rows, scopes)
                r, q = np.nonzero(needed.fits(scores, allowed))
                best.add(ids[q], chunk[rows[r]], document[rows[r]], scores[r, q])
        query, chunk, document, score = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(chunk, pa.string()), pa.array(document, pa.string()), pa.array(score)],
                                         ["query_id", "chunk_id", "document_id", "kw"])
    rows = rows.select("chunk_id", "document_id", "lex")
    if scoped:  # only the codes move, not the tokens
        rows = rows.mapInArrow(lambda batches: (coded(batch) for batch in batches), CODED).join(audience, "document_id").select(*CODED_NAMES, "audience")
    return rows.mapInArrow(scan, FOUND), whole


def _allowed(listed: pa.Array, rows: np.ndarray, scopes: np.ndarray) -> np.ndarray:
    """Whether the scope of each request (columns) is listed beside each of the rows."""
    some = listed.take(pa.array(rows))
    who = some.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), np.nan_to_num(some.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    known, column = np.unique(scopes, return_inverse=True)
    at = np.minimum(np.searchsorted(known, who), len(known) - 1)
    hit = known[at] == who
    seen = np.zeros((len(rows), len(known)), bool)
    seen[row[hit], at[hit]] = True
    return seen[:, column]


def first_round(requests: list[_Request], limit: int) -> dict[str, tuple[int, int]]:
    """The rarest tokens of each request, all lengths."""
    return {t[1]: ANY for r in requests for t in r.tokens[: r.first(FIRST * limit)]}


def second_round(requests: list[_Request], taken: dict[str, tuple[int, int]], floors: dict[int, float], avg_dl: float) -> dict[str, tuple[int, int]]:
    """The other tokens, with the lengths at which a posting can still lead to an answer of some request."""
    terms: dict[str, tuple[int, int]] = {}
    for r in requests:
        weights = [t[0] for t in r.tokens]
        for j, (_, token, _) in enumerate(r.tokens):
            if token in taken:
                continue
            # Fewer than the limit so far: everything counts.
            reach = lengths_above(weights[j:], floors[r.query_id] - CLOSE, avg_dl) if r.query_id in floors else ANY
            if reach:
                held = terms.get(token, reach)
                terms[token] = min(held[0], reach[0]), max(held[1], reach[1])
    return terms


def bounded_pass(
    index: lexical.StoredPostings, queries: DataFrame, frequencies: DataFrame, audience: DataFrame | None, limit: int,
) -> DataFrame:
    """The best ``limit`` chunks of each request of one pass: query_id, chunk_id, document_id, kw, kw_rank."""
    requests = _pass_requests(index, queries, frequencies)
    if not requests:
        return index.postings.sparkSession.createDataFrame([], f"{FOUND}, kw_rank int")
    best = [F.desc("kw"), F.asc("chunk_id")]
    taken = first_round(requests, limit)
    scored, whole = _scored(index, matching(index.postings, taken), requests, audience, limit, {})
    scored = cut_lineage(top_k(scored.distinct() if whole else scored, ["query_id"], best, limit, rank="kw_rank", salts=16))
    if whole:
        return scored
    floors = {r["query_id"]: r["kw"] for r in scored.where(F.col("kw_rank") == limit).select("query_id", "kw").collect()}  # a row a request
    terms = second_round(requests, taken, floors, index.avg_dl)
    if not terms:
        return scored
    rest, whole = _scored(index, matching(index.postings, terms), requests, audience, limit, floors)
    if whole:
        return top_k(rest.distinct(), ["query_id"], best, limit, rank="kw_rank", salts=16)
    both = scored.drop("kw_rank").unionByName(rest).distinct()  # a chunk of both rounds has one score
    return top_k(both, ["query_id"], best, limit, rank="kw_rank", salts=16)
