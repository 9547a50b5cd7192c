"""Catalogue, index, chat and log tables derived from the test data.

Every statement is portable between Spark SQL and DuckDB and reads whole
tables: more rows in gives more rows out. ``with_sql`` puts the statements a
query names in front of it as CTEs.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantseek.common import ensure_checkpoint_dir, shuffles_freed
from grantseek.sources.index import save_bucketed
from grantseek.sources.store import IndexStore, Snapshot

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
        "conversations").split()

FX = {
    "fx_kb": """
SELECT CAST(n_nationkey AS BIGINT) AS kb_id, concat('ds', CAST(n_nationkey AS STRING)) AS dataset_id, n_name AS name,
 n_nationkey % 8 <> 7 AS is_active,
 CASE WHEN n_nationkey % 5 = 0 THEN 'bge-M3' ELSE 'bge-small-zh-v1.5' END AS embedding_model FROM nation""",
    "fx_user": """
SELECT c_custkey AS user_id, c_name AS username,
 CASE WHEN c_custkey % 50 = 0 THEN 'admin' WHEN c_custkey % 10 = 1 THEN 'collaborator' ELSE 'user' END AS role,
 c_mktsegment AS tag, c_acctbal >= 0 AS is_active FROM customer""",
    "fx_grant": """
SELECT o_custkey AS user_id, o_orderkey % 25 AS kb_id, max(o_totalprice) > 100000 AS can_read,
 max(o_totalprice) > 250000 AS can_upload, max(o_totalprice) > 400000 AS can_manage
 FROM orders GROUP BY o_custkey, o_orderkey % 25""",
    "fx_folder": """
SELECT p_partkey + 1 AS folder_id, p_partkey % 25 AS kb_id,
 CASE WHEN p_partkey >= 75 THEN CAST(floor((floor(p_partkey / 25) - 3) / 3) AS BIGINT) * 25 + p_partkey % 25 + 1 END AS parent_id,
 p_name AS name, CASE WHEN p_size % 9 = 0 THEN 'restricted' ELSE 'public' END AS visibility,
 CAST(p_size AS BIGINT) AS sort_order FROM part""",
    "fx_document": """
SELECT CAST(doc_id AS STRING) AS document_id, doc_id % 25 AS kb_id,
 CASE WHEN doc_id % 3 <> 0 THEN (CAST(floor(doc_id / 25) AS BIGINT) % (SELECT CAST(floor(count(*) / 25) AS BIGINT) FROM part)) * 25
   + doc_id % 25 + 1 END AS folder_id,
 CASE WHEN n_chars % 4 = 0 THEN 'restricted' ELSE 'public' END AS visibility,
 CASE WHEN doc_id % 20 = 0 THEN 'failed' WHEN doc_id % 20 = 1 THEN 'parsing' ELSE 'ready' END AS status,
 concat(source, '-', CAST(doc_id AS STRING), '.txt') AS name, source AS category, n_chars AS size_bytes,
 CAST(floor(n_chars / 400) AS BIGINT) + 1 AS chunk_count, CAST(floor(n_chars / 4) AS BIGINT) AS token_count,
 concat('https://docs.example/', CAST(doc_id AS STRING)) AS original_url, lang AS author, text FROM documents""",
    "fx_rule_target": """
SELECT o_orderkey, o_custkey, o_orderpriority, CAST(floor(o_totalprice) AS BIGINT) % 100 AS t,
 (o_orderkey * 7) % (SELECT count(*) FROM documents) AS doc_no,
 (o_orderkey * 11) % (SELECT count(*) FROM part) AS folder_no FROM orders""",
    "fx_acl": """
SELECT o_orderkey AS acl_id, CASE WHEN t < 65 THEN doc_no % 25 WHEN t < 98 THEN folder_no % 25 ELSE o_orderkey % 25 END AS kb_id,
 CASE WHEN o_orderkey % 40 = 0 THEN 'role' WHEN o_orderkey % 40 IN (1, 2) THEN 'tag' ELSE 'user' END AS subject_type,
 CASE WHEN o_orderkey % 40 = 0 THEN CASE o_custkey % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'collaborator' ELSE 'user' END
   WHEN o_orderkey % 40 IN (1, 2) THEN CASE o_custkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING'
     WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END
   ELSE CAST(o_custkey AS STRING) END AS subject_id,
 CASE WHEN t < 65 THEN CAST(doc_no AS STRING) END AS document_id,
 CASE WHEN t < 25 THEN concat(CAST(doc_no AS STRING), '-0000') END AS chunk_id,
 CASE WHEN t >= 65 AND t < 98 THEN folder_no + 1 END AS folder_id,
 CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'deny' ELSE 'allow' END AS effect
 FROM fx_rule_target""",
    "fx_request": """
SELECT b.item_id AS query_id, b.text AS question, e.embedding AS qvec,
 (b.item_id * 7) % (SELECT count(*) FROM customer) AS user_id
 FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id""",
    "fx_request_kb": """
SELECT b.item_id AS query_id, CAST(n.n_nationkey AS BIGINT) AS kb_id
 FROM benchmark b JOIN nation n ON n.n_regionkey = CASE WHEN b.item_id % 4 = 0 THEN b.item_id % 5 ELSE -1 END""",
    "fx_chunk": """
SELECT concat(CAST(e.vec_id AS STRING), '-0000') AS chunk_id, CAST(e.vec_id AS STRING) AS document_id,
 concat('ds', CAST(e.vec_id % 25 AS STRING)) AS dataset_id, CAST(0 AS INT) AS ordinal, e.embedding, d.text AS content
 FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id""",
    "fx_log": """
SELECT event_id AS log_id, ts AS created_at, user_id, concat('u', CAST(user_id AS STRING)) AS username, event_type AS action,
 CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 37 = 0 THEN 'denied' ELSE 'success' END AS status,
 CAST(floor(value * 10) AS BIGINT) AS duration_ms, props AS detail, concat('/api/', event_type) AS path FROM events""",
    "fx_session": """
SELECT conv_id AS session_id, conv_id % 50 AS user_id, max(CASE WHEN turn = 0 THEN text ELSE '' END) AS title,
 conv_id % 7 = 0 AS is_archived, max(turn) * 1000 + conv_id % 997 AS updated_at FROM conversations GROUP BY conv_id""",
    "fx_message": """
SELECT conv_id * 100 + turn AS message_id, conv_id AS session_id, conv_id % 50 AS user_id, role, text AS content
 FROM conversations""",
    "fx_exposure": """
SELECT event_id, user_id, event_id AS created_at, concat(CAST((event_id * 3) % (SELECT count(*) FROM documents) AS STRING), '-0000') AS hit_a,
 concat(CAST((event_id * 7 + user_id) % (SELECT count(*) FROM documents) AS STRING), '-0000') AS hit_b FROM events""",
    "fx_status": """
SELECT document_id, concat('ds', CAST(kb_id AS STRING)) AS dataset_id, name,
 CASE WHEN size_bytes % 5 = 0 THEN 'pending' WHEN size_bytes % 5 = 1 THEN 'parsing' WHEN size_bytes % 5 = 2 THEN 'failed' ELSE 'done' END AS state,
 CAST(size_bytes % 100 AS DOUBLE) / 100 AS progress, chunk_count, token_count, size_bytes AS char_count,
 concat('/up/', name) AS source_path, 'txt' AS ext,
 CASE WHEN size_bytes % 5 = 2 THEN concat('cannot read ', name) END AS message, size_bytes * 3 AS updated_at FROM fx_document""",
    "fx_status_update": """
SELECT CAST(doc_id * 2 AS STRING) AS document_id, concat('ds', CAST(doc_id * 2 % 25 AS STRING)) AS dataset_id,
 concat('new-', CAST(doc_id AS STRING)) AS name, CASE WHEN quality = 1 THEN 'done' ELSE 'failed' END AS state,
 CASE WHEN toxic = 1 THEN 'checked' END AS message, CASE WHEN quality = 1 THEN concat('/new/', CAST(doc_id AS STRING)) END AS source_path,
 CASE WHEN toxic = 1 THEN 'md' END AS ext, doc_id + 1000000 AS updated_at,
 CASE WHEN quality = 1 THEN doc_id + 5 END AS chunk_count FROM labels""",
    "fx_file": """
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN concat('/tmp/in/', source, '.PDF') WHEN 1 THEN concat(source, ' (1).txt')
   WHEN 2 THEN source WHEN 3 THEN concat('.', source) WHEN 4 THEN concat(source, '.exe') WHEN 5 THEN concat('a/b/', lang, '#', source, '.tar.Md')
   WHEN 6 THEN concat(source, '.epub') ELSE concat('  ', source, '.html') END AS name,
 CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 13 = 0 THEN n_chars * 1000000 ELSE n_chars END AS size, text FROM documents""",
    "fx_version": """
SELECT p_partkey AS version_id, p_brand AS platform,
 concat('v', CAST(p_size % 4 AS STRING), '.', CAST(p_partkey % 13 AS STRING), '.', CASE WHEN p_size % 6 = 0 THEN 'x' ELSE CAST(p_size AS STRING) END,
   CASE WHEN p_size % 5 = 0 THEN '-beta' ELSE '' END) AS version,
 CASE WHEN p_size % 3 = 0 THEN concat(CAST(p_size % 3 + 1 AS STRING), '.', CAST(p_partkey % 5 AS STRING)) END AS min_supported_version,
 p_size % 17 = 0 AS mandatory, p_size % 4 <> 3 AS published FROM part""",
    "fx_client": """
SELECT c_custkey AS client_id, concat('Brand#', CAST(c_custkey % 30 AS STRING)) AS platform,
 concat(CAST(c_nationkey % 4 AS STRING), '.', CAST(c_custkey % 15 AS STRING)) AS current_version FROM customer""",
    "fx_token": """
SELECT o_orderkey AS token_id, o_custkey AS user_id, o_orderstatus = 'F' AS revoked, o_orderdate AS created_at,
 o_orderdate + INTERVAL 30 DAY AS expires_at, concat('PC%20', o_orderpriority, '+', CAST(o_orderkey AS STRING)) AS device_name FROM orders""",
    "fx_attempt": """
SELECT event_id AS attempt_id, user_id % 100 AS user_id, ts AS tried_at, event_type = 'purchase' AS ok FROM events""",
}

# Index tokens and request terms, in DuckDB only; Spark uses the library.
DUCK = {
    "d_line": """
SELECT document_id, kb_id, CAST(ordinal AS INT) AS ordinal, content,
 concat(document_id, '-', CASE WHEN ordinal < 1000 THEN lpad(CAST(ordinal AS STRING), 4, '0') ELSE CAST(ordinal AS STRING) END) AS chunk_id
 FROM (SELECT document_id, kb_id, unnest(string_split(text, chr(10))) AS content,
   unnest(range(len(string_split(text, chr(10))))) AS ordinal FROM fx_document)""",
    "d_lex": """
SELECT chunk_id, document_id, list_distinct(list_transform(regexp_extract_all(content, '[0-9A-Za-z_]+'), lambda x: lower(x))) AS lex FROM d_line""",
    "d_posting": "SELECT unnest(lex) AS token, chunk_id, document_id, len(lex) AS dl FROM d_lex",
    "d_chunk_lex": """
SELECT chunk_id, document_id, list_distinct(list_transform(regexp_extract_all(content, '[0-9A-Za-z_]+'), lambda x: lower(x))) AS lex FROM fx_chunk""",
    "d_chunk_posting": "SELECT unnest(lex) AS token, chunk_id, document_id, len(lex) AS dl FROM d_chunk_lex",
    # first occurrence order, first 32 distinct words
    "d_term": """
SELECT query_id, token FROM (SELECT query_id, token, row_number() OVER (PARTITION BY query_id ORDER BY first_at) AS rn FROM (
 SELECT query_id, token, min(pos) AS first_at FROM (
  SELECT query_id, unnest(words) AS token, unnest(range(len(words))) AS pos FROM (
   SELECT query_id, list_transform(regexp_extract_all(question, '[0-9A-Za-z_]+'), lambda x: lower(x)) AS words FROM fx_request))
 GROUP BY query_id, token)) WHERE rn <= 32""",
    # permissions, decided pair by pair
    "d_closure": """
SELECT folder_id, ancestor_id, distance FROM (
 WITH RECURSIVE up AS (SELECT folder_id, folder_id AS ancestor_id, 0 AS distance FROM fx_folder
  UNION ALL SELECT up.folder_id, f.parent_id, up.distance + 1 FROM up JOIN fx_folder f ON f.folder_id = up.ancestor_id WHERE f.parent_id IS NOT NULL)
 SELECT * FROM up)""",
    "d_readable": """
SELECT u.user_id, k.kb_id FROM fx_user u JOIN fx_kb k ON k.is_active AND u.role = 'admin'
 UNION ALL SELECT g.user_id, g.kb_id FROM fx_grant g JOIN fx_user u ON u.user_id = g.user_id AND u.role <> 'admin'
 JOIN fx_kb k ON k.kb_id = g.kb_id AND k.is_active WHERE g.can_read""",
    "d_uploadable": """
SELECT u.user_id, k.kb_id FROM fx_user u JOIN fx_kb k ON k.is_active AND u.role = 'admin'
 UNION ALL SELECT g.user_id, g.kb_id FROM fx_grant g JOIN fx_user u ON u.user_id = g.user_id AND u.role = 'collaborator'
 JOIN fx_kb k ON k.kb_id = g.kb_id AND k.is_active WHERE g.can_upload""",
    # scope = request; Spark merges equal scopes, which must not change any answer
    "d_scope": """
SELECT r.query_id AS scope_id, u.user_id, u.role, u.tag FROM fx_request r JOIN fx_user u ON u.user_id = r.user_id""",
    "d_scope_kb": """
SELECT s.scope_id, d.kb_id, s.role = 'admin' AS is_admin FROM d_scope s JOIN d_readable d ON d.user_id = s.user_id
 WHERE NOT EXISTS (SELECT 1 FROM fx_request_kb q WHERE q.query_id = s.scope_id)
  OR EXISTS (SELECT 1 FROM fx_request_kb q WHERE q.query_id = s.scope_id AND q.kb_id = d.kb_id)""",
    "d_rule": """
SELECT s.scope_id, a.* FROM fx_acl a JOIN d_scope s ON (a.subject_type = 'user' AND a.subject_id = CAST(s.user_id AS STRING))
  OR (a.subject_type = 'role' AND a.subject_id = s.role) OR (a.subject_type = 'tag' AND a.subject_id = s.tag)
 JOIN d_scope_kb k ON k.scope_id = s.scope_id AND k.kb_id = a.kb_id""",
    "d_chunk_rule": """
SELECT scope_id, chunk_id, document_id, effect FROM d_rule WHERE chunk_id IS NOT NULL""",
    "d_doc_rule": """
SELECT scope_id, document_id, effect FROM d_rule WHERE chunk_id IS NULL AND document_id IS NOT NULL""",
    "d_folder_rule": """
SELECT scope_id, folder_id, effect FROM d_rule WHERE chunk_id IS NULL AND document_id IS NULL AND folder_id IS NOT NULL""",
    "d_kb_rule": """
SELECT scope_id, kb_id, effect FROM d_rule WHERE chunk_id IS NULL AND document_id IS NULL AND folder_id IS NULL""",
    "d_folder_hit": """
SELECT r.scope_id, c.folder_id, bool_or(r.effect = 'allow') AS allow, bool_or(r.effect = 'deny') AS deny
 FROM d_folder_rule r JOIN d_closure c ON c.ancestor_id = r.folder_id GROUP BY ALL""",
    "d_folder_state": """
SELECT k.scope_id, f.kb_id, f.folder_id, coalesce(h.deny, false) AS denied,
 CASE WHEN coalesce(h.deny, false) THEN false WHEN coalesce(h.allow, false) THEN true WHEN k.is_admin THEN true
  WHEN x.folder_id IS NOT NULL THEN false ELSE true END AS visible,
 NOT coalesce(h.deny, false) AND coalesce(h.allow, false) AS granted
 FROM d_scope_kb k JOIN fx_folder f ON f.kb_id = k.kb_id
 LEFT JOIN d_folder_hit h ON h.scope_id = k.scope_id AND h.folder_id = f.folder_id
 LEFT JOIN (SELECT DISTINCT c.folder_id FROM d_closure c JOIN fx_folder r ON r.folder_id = c.ancestor_id AND r.visibility = 'restricted') x
  ON x.folder_id = f.folder_id""",
    "d_decision": """
SELECT k.scope_id, d.kb_id, d.document_id, CASE
 WHEN EXISTS (SELECT 1 FROM d_doc_rule r WHERE r.scope_id = k.scope_id AND r.document_id = d.document_id AND r.effect = 'deny')
   OR EXISTS (SELECT 1 FROM d_kb_rule r WHERE r.scope_id = k.scope_id AND r.kb_id = d.kb_id AND r.effect = 'deny') THEN 'rule_deny'
 WHEN EXISTS (SELECT 1 FROM d_doc_rule r WHERE r.scope_id = k.scope_id AND r.document_id = d.document_id AND r.effect = 'allow')
   OR EXISTS (SELECT 1 FROM d_kb_rule r WHERE r.scope_id = k.scope_id AND r.kb_id = d.kb_id AND r.effect = 'allow') THEN 'rule_allow'
 WHEN s.denied THEN 'folder_deny' WHEN k.is_admin THEN 'admin'
 WHEN d.folder_id IS NOT NULL AND NOT coalesce(s.visible, false) THEN 'folder_hidden' WHEN s.granted THEN 'folder_allow'
 WHEN d.visibility = 'public' THEN 'public' ELSE 'restricted' END AS decided_by
 FROM d_scope_kb k JOIN fx_document d ON d.kb_id = k.kb_id
 LEFT JOIN d_folder_state s ON s.scope_id = k.scope_id AND s.folder_id = d.folder_id""",
    "d_visible": """
SELECT scope_id, kb_id, document_id FROM d_decision WHERE decided_by IN ('rule_allow', 'admin', 'folder_allow', 'public')""",
    "d_search_doc": """
SELECT scope_id, document_id FROM d_visible UNION SELECT scope_id, document_id FROM d_chunk_rule WHERE effect = 'allow' AND document_id IS NOT NULL""",
    # the same for every user who was shown something
    "d_scope_u": """
SELECT user_id AS scope_id, user_id, role, tag FROM fx_user WHERE user_id IN (SELECT user_id FROM fx_exposure)""",
    "d_scope_kb_u": """
SELECT s.scope_id, d.kb_id, s.role = 'admin' AS is_admin FROM d_scope_u s JOIN d_readable d ON d.user_id = s.user_id""",
    # an index after four commits: some documents, others renewed, some removed, some back
    "d_kept_chunk": """
SELECT concat(CAST(v AS STRING), '-0000') AS chunk_id, CAST(v AS STRING) AS document_id,
 CASE v % 25 WHEN 7 THEN '007' WHEN 8 THEN '1e5' ELSE concat('ds', CAST(v % 25 AS STRING)) END AS dataset_id,
 CASE WHEN v % 7 <> 0 AND v % 5 = 0 THEN concat('renewed tion ', text) ELSE text END AS content
 FROM (SELECT e.vec_id AS v, d.text FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)
 WHERE CASE WHEN v % 7 = 0 THEN v % 3 = 2 WHEN v % 5 = 0 THEN true ELSE v % 3 <> 2 END""",
    "d_kept_lex": """
SELECT chunk_id, document_id, list_distinct(list_transform(regexp_extract_all(content, '[0-9A-Za-z_]+'), lambda x: lower(x))) AS lex FROM d_kept_chunk""",
    "d_kept_posting": "SELECT unnest(lex) AS token, chunk_id, document_id, len(lex) AS dl FROM d_kept_lex",
    # search
    "d_stat": "SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(lex)) AS avgdl FROM d_chunk_lex",
    "d_df": "SELECT token, CAST(count(*) AS DOUBLE) AS df FROM d_chunk_posting GROUP BY token",
    "d_kw_all": """
SELECT t.query_id, p.chunk_id, p.document_id,
 round(sum(greatest(ln((s.n - f.df + 0.5) / (f.df + 0.5)), 0.000001)) * 2.2 / (1.0 + 1.2 * (0.25 + 0.75 * p.dl / s.avgdl)), 6) AS kw
 FROM d_term t JOIN d_chunk_posting p ON p.token = t.token JOIN d_df f ON f.token = t.token CROSS JOIN d_stat s
 GROUP BY t.query_id, p.chunk_id, p.document_id, p.dl, s.avgdl""",
    "d_vec_all": """
SELECT q.query_id, c.chunk_id, c.document_id, round(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(q.qvec AS DOUBLE[])), 6) AS vec
 FROM fx_request q CROSS JOIN fx_chunk c""",
}

# The search over everything, and the search inside each request's scope.
for _tag, _kw_scope, _vec_scope in (
    ("open", "", ""),
    ("scoped", " JOIN d_search_doc v ON v.scope_id = a.query_id AND v.document_id = a.document_id",
     " JOIN d_search_doc v ON v.scope_id = a.query_id AND v.document_id = a.document_id"),
):
    DUCK[f"d_kw_{_tag}"] = f"""
SELECT query_id, chunk_id, document_id, kw FROM (SELECT a.*, row_number() OVER (PARTITION BY a.query_id ORDER BY a.kw DESC, a.chunk_id) AS rn
 FROM d_kw_all a{_kw_scope}) WHERE rn <= 200"""
    DUCK[f"d_vec_{_tag}"] = f"SELECT a.* FROM d_vec_all a{_vec_scope}"
    DUCK[f"d_cand_{_tag}"] = f"""
SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.chunk_id, k.chunk_id) AS chunk_id,
 coalesce(v.document_id, k.document_id) AS document_id, coalesce(v.vec, 0.0) AS vec, coalesce(k.kw, 0.0) AS kw, k.kw IS NOT NULL AS is_hit
 FROM d_vec_{_tag} v FULL JOIN d_kw_{_tag} k ON k.query_id = v.query_id AND k.chunk_id = v.chunk_id"""
    DUCK[f"d_final_{_tag}"] = f"""
SELECT query_id, chunk_id, document_id, vec, kw, is_hit, round(0.6 * CASE WHEN vhi - vlo < 1e-9 THEN 0.0 ELSE (vec - vlo) / (vhi - vlo) END
  + 0.4 * CASE WHEN khi - klo < 1e-9 THEN 0.0 ELSE (kw - klo) / (khi - klo) END, 9) AS final
 FROM (SELECT *, min(vec) OVER w AS vlo, max(vec) OVER w AS vhi, min(kw) OVER w AS klo, max(kw) OVER w AS khi
  FROM d_cand_{_tag} WINDOW w AS (PARTITION BY query_id))"""
    for _name, _cut in (("", "0.4"), ("_low", "0.15")):
        DUCK[f"d_top_{_tag}{_name}"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, chunk_id) AS hybrid_rank
 FROM d_final_{_tag} WHERE is_hit OR vec >= {_cut}) WHERE hybrid_rank <= 30"""
for _name, _cut in (("", "0.4"), ("_low", "0.15")):
    DUCK[f"d_seen{_name}"] = f"""
SELECT * FROM (SELECT h.*, CASE
  WHEN EXISTS (SELECT 1 FROM d_chunk_rule r WHERE r.scope_id = h.query_id AND r.chunk_id = h.chunk_id AND r.effect = 'deny') THEN false
  WHEN EXISTS (SELECT 1 FROM d_chunk_rule r WHERE r.scope_id = h.query_id AND r.chunk_id = h.chunk_id AND r.effect = 'allow') THEN true
  WHEN EXISTS (SELECT 1 FROM d_chunk_rule r WHERE r.scope_id = h.query_id AND r.document_id = h.document_id AND r.effect = 'allow') THEN false
  ELSE EXISTS (SELECT 1 FROM d_visible v WHERE v.scope_id = h.query_id AND v.document_id = h.document_id) END AS visible
 FROM d_top_scoped{_name} h) WHERE visible"""
    DUCK[f"d_kept{_name}"] = f"""
SELECT query_id, chunk_id, document_id, vec, row_number() OVER (PARTITION BY query_id ORDER BY vec DESC, hybrid_rank, chunk_id) AS rank
 FROM d_seen{_name} WHERE vec >= {_cut} QUALIFY rank <= 8"""

_BY_SCOPE = ("d_rule", "d_chunk_rule", "d_doc_rule", "d_folder_rule", "d_kb_rule", "d_folder_hit", "d_folder_state", "d_decision", "d_visible")
DUCK |= {f"{name}_u": re.sub(rf"\b({'|'.join(('d_scope', 'd_scope_kb', *_BY_SCOPE))})\b", r"\1_u", DUCK[name]) for name in _BY_SCOPE}
ALL = {**FX, **DUCK}
_NAME = re.compile(r"\b(?:fx|d)_[a-z_]+\b")


def _needed(text: str, found: list[str]) -> list[str]:
    for name in _NAME.findall(text):
        if name in ALL and name not in found:
            _needed(ALL[name], found)
            found.append(name)
    return found


def with_sql(body: str) -> str:
    """The query with the tables it names in front, in an order that resolves."""
    names = _needed(body, [])
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({ALL[n]})" if n in DUCK else f"{n} AS ({ALL[n]})" for n in names)
    return f"WITH {ctes}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as Spark reads it."""
    sql = with_sql(f"SELECT * FROM {name}")
    for base in BASE:
        if re.search(rf"\b{base}\b", sql):
            table(spark, sf_dir, base).createOrReplaceTempView(f"src_{base}")
            sql = re.sub(rf"\b(FROM|JOIN) {base}\b", rf"\1 src_{base}", sql)
    df = spark.sql(sql)
    if name == "fx_user":
        df = df.withColumn("tags", F.array("tag"))
    return df


TEXT = ("document", "chunk", "file")
ROW_GROUP = 16 << 20  # bytes
_STORED: dict[tuple[str, str, str], object] = {}


class Tables:
    """Derived tables of one scale factor by attribute: ``t.user``, ``t.acl`` ...

    As in a running system these are stored tables: each is derived in full from
    the test data once per session and scale factor, then read.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def stored(self, name: str, make) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORED:
            path = f"{ensure_checkpoint_dir(self.spark)}/tables/{uuid.uuid4().hex}"
            rows = make()
            if name in TEXT:  # as many files as cores; the test data is one small file per table
                rows = rows.repartition(self.spark.sparkContext.defaultParallelism)
            with shuffles_freed(self.spark):  # a file has many row groups, so that no task reads a whole file
                rows.write.option("parquet.block.size", ROW_GROUP).parquet(path)
            _STORED[key] = path, rows.schema
        path, schema = _STORED[key]
        return self.spark.read.schema(schema).parquet(path)

    def bucketed(self, name: str, make) -> DataFrame:
        """The same as a table bucketed by document, the layout of a stored index."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORED:
            ident = uuid.uuid4().hex
            path = f"{ensure_checkpoint_dir(self.spark)}/tables/{ident}"
            save_bucketed(make(), f"index_{ident}", path, self.spark.sparkContext.defaultParallelism)
            _STORED[key] = f"index_{ident}"
        return self.spark.table(_STORED[key])

    def index(self, name: str, *commits) -> Snapshot:
        """A stored index made by these commits, each a function of the store, once per session and scale factor."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORED:
            store = IndexStore(self.spark, f"{ensure_checkpoint_dir(self.spark)}/tables/{uuid.uuid4().hex}", buckets=16)
            for commit in commits:
                commit(store)
            _STORED[key] = store.snapshot()
        return _STORED[key]

    def __getattr__(self, name: str) -> DataFrame:
        if f"fx_{name}" in FX:
            return self.stored(name, lambda: fx(self.spark, self.sf_dir, f"fx_{name}"))
        if name in BASE:
            return table(self.spark, self.sf_dir, name)
        raise AttributeError(name)
