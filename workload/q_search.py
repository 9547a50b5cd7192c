"""Vector, keyword and hybrid search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantseek.functions import vectors
from grantseek.operators import chat, chunking, embedding, folders, hybrid, lexical
from grantseek.operators import permissions as perm
from grantseek.plans import ingest, retrieval
from workload.registry import query


def chunk_index(t):
    """The vector index as it is stored: tokens, postings and statistics are made when chunks are written."""
    return t.index("chunk_index", lambda store: store.commit(t.chunk))


def line_index(t):
    lines = chunking.line_chunks(t.document.select("document_id", "kb_id", "text"), "text")
    named = lines.withColumn("dataset_id", F.concat(F.lit("ds"), F.col("kb_id").cast("string")))
    return t.index("line_index", lambda store: store.commit(named))


def renewed_index(t):
    """The same after commits that replace, remove and bring back documents, of datasets whose names look like numbers."""
    number = F.col("document_id").cast("bigint")
    kb = number % 25
    chunks = t.chunk.withColumn("dataset_id", F.when(kb == 7, "007").when(kb == 8, "1e5").otherwise(F.concat(F.lit("ds"), kb.cast("string"))))
    renewed = chunks.withColumn("content", F.concat(F.lit("renewed tion "), "content"))
    return t.index(
        "renewed_index", lambda store: store.commit(chunks.where(number % 3 != 2)), lambda store: store.commit(renewed.where(number % 5 == 0)),
        lambda store: store.commit(removed=chunks.where(number % 7 == 0)),
        lambda store: store.commit(chunks.where((number % 3 == 2) & (number % 7 == 0))), lambda store: store.compact(2))


def index_of(t):
    """(chunks, postings, statistics) of the vector index."""
    snapshot = chunk_index(t)
    return snapshot.chunks(), snapshot.stored_postings(), snapshot.stats()


def requests_of(t):
    asked = t.request_kb.groupBy("query_id").agg(F.collect_set("kb_id").alias("kb_ids"))
    return t.request.join(asked, "query_id", "left")


def catalogue_of(t):
    closure = t.stored("closure", lambda: folders.ancestor_closure(t.folder))
    places = t.stored("places", lambda: perm.folder_places(t.folder, closure))
    return retrieval.Catalogue(t.user, t.kb, t.grant, t.folder, t.document, t.acl, closure, places)


def scoped(t):
    """Requests with their scopes resolved, and who may search what."""
    requests = perm.assign_scopes(requests_of(t))
    cat = catalogue_of(t)
    resolved = retrieval.resolve(perm.scopes_of(requests, cat.users), cat)
    return requests, resolved


def audience_of(resolved):
    return perm.audience(**resolved.listing())


def search(t, **kw):
    chunks, postings, stats = index_of(t)
    return hybrid.hybrid_search(chunks, postings, t.request, stats, **kw)


def scoped_search(t, threshold):
    requests, resolved = scoped(t)
    chunks, postings, stats = index_of(t)
    found = hybrid.hybrid_search(chunks, postings, requests, stats, audience_of(resolved), threshold=threshold)
    return found.join(requests.select("query_id", "scope_id"), "query_id"), resolved


# ---------------------------------------------------------------- vectors

@query("v1_embed", """
SELECT document_id, 64 AS dim, true AS is_unit FROM fx_document""")
def _(t):
    rows = embedding.embed(t.document.select("document_id", "text"), "text")
    size = vectors.norm(F.col("embedding"))
    return rows.select("document_id", F.size("embedding").alias("dim"),
                       ((F.abs(size - 1) < 1e-5) | (size == 0)).alias("is_unit"))


@query("v2_l2_normalize", """
SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS square_sum, round(v[1] / n, 6) AS first_part, round(v[64] / n, 6) AS last_part
FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (
 SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (label + 1)) AS v FROM embeddings))""")
def _(t):
    scaled = F.transform(vectors.as_double(F.col("embedding")), lambda x: x * (F.col("label") + 1))
    rows = t.embeddings.select("vec_id", scaled.alias("v")).withColumn("u", vectors.l2_normalize(F.col("v")))
    return rows.select("vec_id", F.round(vectors.dot(F.col("v"), F.col("v")), 6).alias("square_sum"),
                       F.round(F.element_at("u", 1), 6).alias("first_part"), F.round(F.element_at("u", 64), 6).alias("last_part"))


@query("v3_route_model", """
SELECT kb_id, CASE WHEN embedding_model = 'bge-M3' THEN 'bge-m3' ELSE 'bge-small-zh-v1.5' END AS model FROM fx_kb""")
def _(t):
    return t.kb.select("kb_id", vectors.route_model(F.col("embedding_model")).alias("model"))


@query("v4_dot_scores", """
SELECT query_id, count(*) AS n_scored, min(vec) AS min_score, max(vec) AS max_score FROM d_vec_open GROUP BY query_id""")
def _(t):
    return embedding.dot_scores(t.chunk, t.request)


@query("v5_vector_topk", """
SELECT query_id, chunk_id, document_id, vec AS score, rank FROM (
 SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY vec DESC, chunk_id) AS INT) AS rank FROM d_vec_open) WHERE rank <= 30""")
def _(t):
    return embedding.vector_topk(t.chunk, t.request)


@query("v6_min_max_norm", """
SELECT event_id, round(CASE WHEN hi - lo < 1e-9 THEN 0.0 ELSE (value - lo) / (hi - lo) END, 9) AS scaled
FROM (SELECT event_id, value, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events)""")
def _(t):
    rows = embedding.min_max_norm(t.events, "value", "user_id", "scaled")
    return rows.select("event_id", F.round("scaled", 9).alias("scaled"))


@query("v7_vector_health", """
SELECT c.dataset_id, c.chunk_id, c.dim, u.usual_dim FROM (
 SELECT concat('ds', CAST(vec_id % 25 AS STRING)) AS dataset_id, CAST(vec_id AS STRING) AS chunk_id, CASE WHEN label = 3 THEN 32 ELSE 64 END AS dim FROM embeddings) c
JOIN (SELECT dataset_id, dim AS usual_dim FROM (
  SELECT dataset_id, dim, row_number() OVER (PARTITION BY dataset_id ORDER BY count(*) DESC, dim DESC) AS rn FROM (
   SELECT concat('ds', CAST(vec_id % 25 AS STRING)) AS dataset_id, CASE WHEN label = 3 THEN 32 ELSE 64 END AS dim FROM embeddings)
  GROUP BY dataset_id, dim) WHERE rn = 1) u ON u.dataset_id = c.dataset_id WHERE c.dim <> u.usual_dim""")
def _(t):
    short = F.when(F.col("label") == 3, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    chunks = t.embeddings.select(F.concat(F.lit("ds"), (F.col("vec_id") % 25).cast("string")).alias("dataset_id"),
                                 F.col("vec_id").cast("string").alias("chunk_id"), short.alias("embedding"))
    return embedding.vector_health(chunks).select("dataset_id", "chunk_id", "dim", "usual_dim")


# ---------------------------------------------------------------- keywords

@query("l1_build_postings", "SELECT token, chunk_id, document_id, CAST(dl AS INT) AS dl FROM d_posting")
def _(t):
    return line_index(t).postings().select("token", "chunk_id", "document_id", "dl")


@query("l2_document_frequencies", "SELECT token, count(*) AS df FROM d_posting GROUP BY token")
def _(t):
    return lexical.document_frequencies(line_index(t).postings())


@query("l2_corpus_totals", "SELECT count(*) AS n_chunks, round(avg(len(lex)), 9) AS avg_dl FROM d_lex")
def _(t):
    return lexical.corpus_totals(line_index(t).chunks()).withColumn("avg_dl", F.round("avg_dl", 9))


@query("l2_maintained_frequencies", "SELECT token, count(*) AS df FROM d_kept_posting GROUP BY token")
def _(t):
    """Kept by commits, never counted again."""
    return renewed_index(t).frequencies()


@query("l2_maintained_totals", "SELECT count(*) AS n_chunks, round(avg(len(lex)), 9) AS avg_dl FROM d_kept_lex")
def _(t):
    return renewed_index(t).totals().withColumn("avg_dl", F.round("avg_dl", 9))


@query("s13_committed_chunks", "SELECT dataset_id, document_id, chunk_id, content FROM d_kept_chunk")
def _(t):
    return renewed_index(t).chunks().select("dataset_id", "document_id", "chunk_id", "content")


@query("s13_committed_search", """
SELECT query_id, chunk_id, document_id, kw, CAST(row_number() OVER (PARTITION BY query_id ORDER BY kw DESC, chunk_id) AS INT) AS kw_rank FROM (
 SELECT t.query_id, p.chunk_id, p.document_id,
  round(sum(greatest(ln((s.n - f.df + 0.5) / (f.df + 0.5)), 0.000001)) * 2.2 / (1.0 + 1.2 * (0.25 + 0.75 * p.dl / s.avgdl)), 6) AS kw
 FROM d_term t JOIN d_kept_posting p ON p.token = t.token JOIN (SELECT token, CAST(count(*) AS DOUBLE) AS df FROM d_kept_posting GROUP BY token) f ON f.token = t.token
 CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(lex)) AS avgdl FROM d_kept_lex) s
 GROUP BY t.query_id, p.chunk_id, p.document_id, p.dl, s.avgdl) QUALIFY kw_rank <= 200""")
def _(t):
    """Keyword search over what the last commit left."""
    snapshot = renewed_index(t)
    return lexical.bm25_search(snapshot.stored_postings(), t.request, snapshot.stats())


@query("l3_bm25_search", """
SELECT query_id, chunk_id, document_id, kw, CAST(row_number() OVER (PARTITION BY query_id ORDER BY kw DESC, chunk_id) AS INT) AS kw_rank FROM d_kw_open""")
def _(t):
    _chunks, postings, stats = index_of(t)
    return lexical.bm25_search(postings, t.request, stats)


@query("l3_bm25_lines", """
SELECT query_id, chunk_id, document_id, kw, rn AS kw_rank FROM (
 SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY kw DESC, chunk_id) AS INT) AS rn FROM (
  SELECT t.query_id, p.chunk_id, p.document_id,
   round(sum(greatest(ln((s.n - f.df + 0.5) / (f.df + 0.5)), 0.000001)) * 2.2 / (1.0 + 1.2 * (0.25 + 0.75 * p.dl / s.avgdl)), 6) AS kw
  FROM d_term t JOIN d_posting p ON p.token = t.token JOIN (SELECT token, CAST(count(*) AS DOUBLE) AS df FROM d_posting GROUP BY token) f ON f.token = t.token
  CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(lex)) AS avgdl FROM d_lex) s
  GROUP BY t.query_id, p.chunk_id, p.document_id, p.dl, s.avgdl)) WHERE rn <= 200""")
def _(t):
    snapshot = line_index(t)
    return lexical.bm25_search(snapshot.stored_postings(), t.request, snapshot.stats())


@query("l3_bm25_scoped", "SELECT query_id, chunk_id, document_id, kw FROM d_kw_scoped")
def _(t):
    requests, resolved = scoped(t)
    _chunks, postings, stats = index_of(t)
    return lexical.bm25_search(postings, requests, stats, audience_of(resolved)).drop("kw_rank")


@query("l4_substring_search", "SELECT chunk_id FROM d_line WHERE content ILIKE '%TION%'")
def _(t):
    lines = chunking.line_chunks(t.document.select("document_id", "text"), "text")
    return lexical.substring_search(lines, "TION").select("chunk_id")


@query("l4_substring_search_exact", "SELECT chunk_id FROM d_line WHERE contains(content, 'Tion')")
def _(t):
    lines = chunking.line_chunks(t.document.select("document_id", "text"), "text")
    return lexical.substring_search(lines, "Tion", case_sensitive=True).select("chunk_id")


@query("l5_tokenizer_mode_check", """
SELECT doc_id, 'jieba' AS built_with, 'bigram' AS current_mode FROM documents WHERE lang <> 'en'""")
def _(t):
    """Index parts written by language; those not English used another tokenizer."""
    meta = t.documents.select("doc_id", F.lit("token_mode").alias("key"),
                              F.when(F.col("lang") == "en", "bigram").otherwise("jieba").alias("value"))
    checked = lexical.tokenizer_mode_check(meta.select("key", F.col("value"))).select("built_with", "current_mode").distinct()
    return meta.join(checked, F.col("value") == F.col("built_with")).select("doc_id", "built_with", "current_mode")


# ---------------------------------------------------------------- hybrid

@query("h1_candidates", """
SELECT coalesce(v.query_id, k.query_id) AS query_id, count(*) AS n, count(*) FILTER (WHERE k.kw IS NOT NULL) AS n_hits,
 count(*) FILTER (WHERE k.kw IS NOT NULL AND coalesce(v.vec, 0.0) = 0) AS n_keyword_only, max(coalesce(k.kw, 0.0)) AS best_kw, max(coalesce(v.vec, 0.0)) AS best_vec, round(sum(coalesce(v.vec, 0.0)), 3) AS sum_vec
FROM d_vec_open v FULL JOIN d_kw_open k ON k.query_id = v.query_id AND k.chunk_id = v.chunk_id GROUP BY ALL""")
def _(t):
    """All scores of both sides, as counts and sums of each request."""
    chunks, postings, stats = index_of(t)
    both = hybrid.candidates(lexical.bm25_search(postings, t.request, stats), embedding.vector_topk(chunks, t.request, chunks.count()))
    return both.groupBy("query_id").agg(
        F.count("*").alias("n"), F.count_if("is_hit").alias("n_hits"), F.count_if(F.col("is_hit") & (F.col("vec") == 0)).alias("n_keyword_only"),
        F.max("kw").alias("best_kw"), F.max("vec").alias("best_vec"), F.round(F.sum("vec"), 3).alias("sum_vec"))


for _name, _suffix, _threshold in (("h2_hybrid_search", "", 0.4), ("h2_hybrid_search_low", "_low", 0.15)):
    @query(_name, f"""
SELECT query_id, chunk_id, document_id, vec AS similarity, kw, final, CAST(hybrid_rank AS INT) AS hybrid_rank FROM d_top_open{_suffix}""")
    def _(t, threshold=_threshold):
        return search(t, threshold=threshold)


@query("h2_hybrid_scoped", """
SELECT query_id, chunk_id, document_id, vec AS similarity, kw, final, CAST(hybrid_rank AS INT) AS hybrid_rank FROM d_top_scoped_low""")
def _(t):
    return scoped_search(t, 0.15)[0].drop("scope_id")


@query("h3_late_fetch", """
SELECT h.query_id, h.chunk_id, c.content FROM d_top_open h JOIN fx_chunk c ON c.chunk_id = h.chunk_id""")
def _(t):
    return hybrid.late_fetch(search(t), chunk_index(t)).select("query_id", "chunk_id", "content")


@query("h4_permission_filter", "SELECT query_id, chunk_id FROM d_seen_low")
def _(t):
    hits, resolved = scoped_search(t, 0.15)
    return perm.permission_filter(hits, **resolved.decide()).select("query_id", "chunk_id")


@query("h5_dedupe_hits", "SELECT query_id, chunk_id, CAST(hybrid_rank AS INT) AS hybrid_rank FROM d_top_open")
def _(t):
    hits = search(t)
    again = hits.withColumn("hybrid_rank", F.col("hybrid_rank") + 100)
    return hybrid.dedupe_hits(hits.unionByName(again)).select("query_id", "chunk_id", "hybrid_rank")


@query("h6_final_rank", """
SELECT query_id, chunk_id, vec AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY vec DESC, hybrid_rank, chunk_id) AS INT) AS index
FROM d_top_open_low WHERE vec >= 0.15 QUALIFY index <= 8""")
def _(t):
    ranked = hybrid.final_rank(search(t, threshold=0.15), threshold=0.15)
    return ranked.select("query_id", "chunk_id", "similarity", "index")


def preview(t, threshold):
    chunks, postings, stats = index_of(t)
    return retrieval.retrieve(requests_of(t), catalogue_of(t), chunks, postings, stats, threshold=threshold,
                              final_threshold=threshold)


@query("h7_citations", """
SELECT k.query_id, CAST(k.rank AS INT) AS index, k.chunk_id, k.document_id, d.name AS document_name, d.kb_id, b.name AS kb_name,
 round(k.vec, 4) AS similarity, d.original_url, d.author, c.content
FROM d_kept_low k JOIN fx_document d ON d.document_id = k.document_id JOIN fx_kb b ON b.kb_id = d.kb_id JOIN fx_chunk c ON c.chunk_id = k.chunk_id""")
def _(t):
    return preview(t, 0.15)[1].drop("page")


def _summary_sql(suffix):
    return f"""
SELECT r.query_id, coalesce(a.n, 0) AS raw_candidates, coalesce(a.n, 0) - coalesce(s.n, 0) AS dropped_by_permission, coalesce(k.n, 0) AS kept,
 CASE WHEN NOT EXISTS (SELECT 1 FROM d_scope_kb x WHERE x.scope_id = r.query_id) THEN 'no readable collection'
  WHEN NOT EXISTS (SELECT 1 FROM d_search_doc x WHERE x.scope_id = r.query_id) THEN 'no visible document'
  WHEN trim(r.question) = '' THEN 'empty question' WHEN k.n IS NULL THEN 'nothing found' END AS reason
FROM fx_request r LEFT JOIN (SELECT query_id, count(*) AS n FROM d_top_scoped{suffix} GROUP BY query_id) a ON a.query_id = r.query_id
LEFT JOIN (SELECT query_id, count(*) AS n FROM d_seen{suffix} GROUP BY query_id) s ON s.query_id = r.query_id
LEFT JOIN (SELECT query_id, count(*) AS n FROM d_kept{suffix} GROUP BY query_id) k ON k.query_id = r.query_id"""


@query("h8_retrieval_preview", _summary_sql(""))
def _(t):
    return preview(t, 0.4)[0]


@query("h8_retrieval_preview_low", _summary_sql("_low"))
def _(t):
    return preview(t, 0.15)[0]


@query("h9_empty_reason", """
SELECT r.query_id, CASE WHEN NOT EXISTS (SELECT 1 FROM d_scope_kb x WHERE x.scope_id = r.query_id) THEN 'no readable collection'
  WHEN NOT EXISTS (SELECT 1 FROM d_search_doc x WHERE x.scope_id = r.query_id) THEN 'no visible document'
  WHEN NOT EXISTS (SELECT 1 FROM d_kw_scoped x WHERE x.query_id = r.query_id) THEN 'nothing found' END AS reason FROM fx_request r""")
def _(t):
    requests, resolved = scoped(t)
    _chunks, postings, stats = index_of(t)
    listed = audience_of(resolved)
    hits = lexical.bm25_search(postings, requests, stats, listed)
    return retrieval.empty_reason(requests, resolved.access, retrieval.searchable_scopes(listed, resolved.rules), hits)


CONTEXTS_SQL = """
 SELECT query_id, string_agg(concat('[', CAST(rank AS STRING), '] 来源：', name, '（', kb_name, '）', chr(10), substring(body, 1, CAST(6000 - used AS BIGINT))),
   concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rank) AS context
 FROM (SELECT k.query_id, k.rank, d.name, b.name AS kb_name, trim(c.content, ' ' || chr(10)) AS body,
   coalesce(sum(length(trim(c.content, ' ' || chr(10)))) OVER (PARTITION BY k.query_id ORDER BY k.rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vec DESC, hybrid_rank, chunk_id) AS rank
    FROM d_top_open_low WHERE vec >= 0.15 QUALIFY rank <= 8) k
  JOIN fx_document d ON d.document_id = k.document_id JOIN fx_kb b ON b.kb_id = d.kb_id JOIN fx_chunk c ON c.chunk_id = k.chunk_id)
 WHERE used < 6000 GROUP BY query_id"""


def contexts_of(t):
    ranked = hybrid.final_rank(hybrid.late_fetch(search(t, threshold=0.15), t.chunk), threshold=0.15)
    return chat.context_block(hybrid.citations(ranked, t.document, t.kb), t.request, budget=6000)


@query("h10_context_block", f"""
SELECT r.query_id, coalesce(c.context, '（本轮没有检索到任何可用片段）') AS context FROM fx_request r LEFT JOIN ({CONTEXTS_SQL}) c ON c.query_id = r.query_id""")
def _(t):
    return contexts_of(t)


@query("h11_prompt_messages", """
SELECT m.query_id, 2 + coalesce(h.n, 0) AS n_messages,
 CASE WHEN m.query_id % 2 = 0 THEN '【用户附加内容】' || chr(10) || '[附件] note.txt' || chr(10) || substring(m.question, 1, 8000) || chr(10) || chr(10) ELSE '' END
 || '【参考片段】' || chr(10) || coalesce(c.context, '（本轮没有检索到任何可用片段）') || chr(10) || chr(10) || '【用户问题】' || chr(10) || m.question AS last_message
FROM fx_request m LEFT JOIN (SELECT session_id, count(*) AS n FROM (
  SELECT session_id, content, row_number() OVER (PARTITION BY session_id ORDER BY message_id DESC) AS p FROM fx_message)
 WHERE p <= 12 AND trim(content) <> '' GROUP BY session_id) h ON h.session_id = m.query_id
LEFT JOIN (""" + CONTEXTS_SQL + """) c ON c.query_id = m.query_id""")
def _(t):
    """History, passages and, for every second request, an attached file."""
    asked = t.request.select("query_id", "question", F.col("query_id").alias("session_id"))
    files = asked.where("query_id % 2 = 0").select("query_id", F.lit(1).alias("seq"), F.lit("file").alias("type"), F.lit("note.txt").alias("name"), F.col("question").alias("text"))
    rows = chat.prompt_messages(asked, contexts_of(t), chat.history_window(t.message), files)
    return rows.select("query_id", F.size("messages").cast("bigint").alias("n_messages"),
                       F.element_at("messages", -1)["content"].alias("last_message"))


@query("h12_history_window", """
SELECT session_id, message_id, CAST(position AS INT) AS position, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, substring(body, 1, 4000) AS content
FROM (SELECT *, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS body, row_number() OVER (PARTITION BY session_id ORDER BY message_id DESC) AS position FROM fx_message)
WHERE position <= 4 AND body <> ''""")
def _(t):
    return chat.history_window(t.message, rounds=2)


@query("ingest_documents")
def _(t):
    """Parse, cut, tokenize and encode every document."""
    files = t.document.select("document_id", F.concat(F.lit("ds"), F.col("kb_id").cast("string")).alias("dataset_id"),
                              "name", F.col("text").cast("binary").alias("content"))
    parsed, chunks = ingest.ingest_documents(files)
    return ingest.ingest_status(parsed, chunks)
