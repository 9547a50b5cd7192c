"""Catalogue and index housekeeping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantseek.operators import catalog, chunking
from grantseek.operators import permissions as perm
from grantseek.sources import index
from workload.registry import query


def index_chunks(t):
    lines = chunking.line_chunks(t.document.select("document_id", "kb_id", "text"), "text")
    return lines.select("chunk_id", "document_id", F.concat(F.lit("ds"), F.col("kb_id").cast("string")).alias("dataset_id"), "ordinal", "content")


def labelled(t):
    """New one-line versions of the labelled documents."""
    doc = F.col("doc_id").cast("string")
    return t.labels.select(
        F.concat(doc, F.lit("-0000")).alias("chunk_id"), doc.alias("document_id"),
        F.concat(F.lit("ds"), (F.col("doc_id") % 25).cast("string")).alias("dataset_id"), F.lit(0).alias("ordinal"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("content"))


# ---------------------------------------------------------------- index

@query("s12_scan_index", """
SELECT chunk_id FROM d_line WHERE kb_id IN (1, 5, 9) AND document_id IN (SELECT CAST(doc_id AS STRING) FROM labels)""")
def _(t):
    documents = t.labels.select(F.col("doc_id").cast("string").alias("document_id"))
    return index.scan_index(index_chunks(t), ["ds1", "ds5", "ds9"], documents).select("chunk_id")


@query("s13_replace_document_chunks", """
SELECT chunk_id, content FROM d_line WHERE document_id NOT IN (SELECT CAST(doc_id AS STRING) FROM labels)
UNION ALL SELECT concat(CAST(doc_id AS STRING), '-0000'), concat('quality ', CAST(quality AS STRING)) FROM labels""")
def _(t):
    return index.replace_document_chunks(index_chunks(t), labelled(t)).select("chunk_id", "content")


@query("s14_delete_documents", "SELECT chunk_id FROM d_line WHERE document_id NOT IN (SELECT CAST(doc_id AS STRING) FROM labels)")
def _(t):
    left, _removed = index.delete_documents(labelled(t), chunks=index_chunks(t), status=t.status)
    return left["chunks"].select("chunk_id")


@query("s14_delete_documents_removed", """
SELECT document_id, count(*) AS removed FROM d_line WHERE document_id IN (SELECT CAST(doc_id AS STRING) FROM labels) GROUP BY document_id""")
def _(t):
    return index.delete_documents(labelled(t), chunks=index_chunks(t))[1]


@query("s15_delete_datasets", "SELECT document_id FROM fx_status WHERE dataset_id NOT IN (SELECT dataset_id FROM fx_kb WHERE NOT is_active)")
def _(t):
    gone = t.kb.where("NOT is_active")
    return index.delete_datasets(gone, chunks=index_chunks(t), status=t.status)[0]["status"].select("document_id")


@query("s15_delete_datasets_removed", """
SELECT k.dataset_id, count(*) AS removed FROM d_line l JOIN fx_kb k ON k.kb_id = l.kb_id AND NOT k.is_active GROUP BY k.dataset_id""")
def _(t):
    return index.delete_datasets(t.kb.where("NOT is_active"), chunks=index_chunks(t))[1]


@query("s16_upsert_document_status", """
SELECT coalesce(s.document_id, u.document_id) AS document_id, coalesce(s.dataset_id, u.dataset_id) AS dataset_id, CASE WHEN u.document_id IS NULL THEN s.name ELSE u.name END AS name,
 CASE WHEN u.document_id IS NULL THEN s.state ELSE u.state END AS state, CASE WHEN u.document_id IS NULL THEN s.message ELSE u.message END AS message,
 coalesce(u.source_path, s.source_path) AS source_path, coalesce(u.ext, s.ext) AS ext, CASE WHEN u.document_id IS NULL THEN s.updated_at ELSE u.updated_at END AS updated_at,
 coalesce(s.chunk_count, 0) AS chunk_count, coalesce(s.progress, 0.0) AS progress
FROM fx_status s FULL JOIN fx_status_update u ON u.document_id = s.document_id""")
def _(t):
    return index.upsert_document_status(t.status, t.status_update).drop("token_count", "char_count")


@query("s17_set_document_state", """
SELECT s.document_id, CASE WHEN u.document_id IS NULL THEN s.state ELSE u.state END AS state, CASE WHEN u.document_id IS NULL THEN s.message ELSE u.message END AS message,
 coalesce(u.chunk_count, s.chunk_count) AS chunk_count, s.token_count, s.progress, coalesce(u.updated_at, s.updated_at) AS updated_at
FROM fx_status s LEFT JOIN fx_status_update u ON u.document_id = s.document_id""")
def _(t):
    return index.set_document_state(t.status, t.status_update).select(
        "document_id", "state", "message", "chunk_count", "token_count", "progress", "updated_at")


# ---------------------------------------------------------------- catalogue

@query("k1_page", "SELECT document_id, name FROM (SELECT *, row_number() OVER (ORDER BY name DESC, document_id) AS rn FROM fx_document) WHERE rn > 40 AND rn <= 60")
def _(t):
    return catalog.page(t.document, [F.desc("name"), F.asc("document_id")], 3, 20)[0].select("document_id", "name")


@query("k2_list_kbs", """
SELECT v.user_id, k.kb_id, k.name, r.user_id IS NOT NULL AS can_read, u.user_id IS NOT NULL AS can_upload, v.is_admin OR u.user_id IS NOT NULL AS can_manage
FROM (SELECT user_id, kb_id, role = 'admin' AS is_admin FROM fx_user CROSS JOIN fx_kb WHERE role = 'admin'
 UNION ALL SELECT r.user_id, r.kb_id, false FROM d_readable r JOIN fx_user u ON u.user_id = r.user_id AND u.role <> 'admin') v
JOIN fx_kb k ON k.kb_id = v.kb_id LEFT JOIN d_readable r ON r.user_id = v.user_id AND r.kb_id = v.kb_id
LEFT JOIN d_uploadable u ON u.user_id = v.user_id AND u.kb_id = v.kb_id WHERE k.name ILIKE '%nation_1%'""")
def _(t):
    readable = perm.readable_kbs(t.user, t.kb, t.grant)
    uploadable = perm.uploadable_kbs(t.user, t.kb, t.grant)
    rows = catalog.list_kbs(readable, uploadable, t.user, t.kb, "nation_1", include_inactive=True)
    return rows.select("user_id", "kb_id", "name", "can_read", "can_upload", "can_manage")


@query("k3_list_documents", """
SELECT document_id, name FROM fx_document WHERE name ILIKE '%src1%' AND status = 'ready' AND visibility = 'public' AND folder_id IS NULL""")
def _(t):
    rows = catalog.list_documents(t.document, keyword="SRC1", status="ready", visibility="public", folder_id=0)
    return rows.select("document_id", "name")


@query("k4_list_chunks", """
SELECT chunk_id, document_id, content, ordinal AS index, CAST(floor(length(content) / 4) AS BIGINT) AS token_count FROM (
 SELECT * FROM d_line WHERE document_id = (SELECT document_id FROM fx_document ORDER BY size_bytes DESC, document_id LIMIT 1) ORDER BY ordinal LIMIT 200) WHERE contains(content, 'the')""")
def _(t):
    from grantseek.functions import text
    largest = t.document.orderBy(F.desc("size_bytes"), "document_id").select("document_id").first()["document_id"]
    chunks = index_chunks(t).withColumn("tokens", text.approx_tokens(F.col("content")))
    return catalog.list_chunks(chunks, largest, "the")


@query("k5_kb_counters", """
SELECT k.kb_id, coalesce(d.n, 0) AS doc_count, coalesce(d.c, 0) AS chunk_count FROM fx_kb k LEFT JOIN (
 SELECT kb_id, count(*) AS n, CAST(sum(chunk_count) AS BIGINT) AS c FROM fx_document WHERE status <> 'failed' GROUP BY kb_id) d ON d.kb_id = k.kb_id""")
def _(t):
    return catalog.kb_counters(t.kb, t.document)


@query("k6_sync_status", """
SELECT d.document_id, CASE s.state WHEN 'pending' THEN 'parsing' WHEN 'parsing' THEN 'parsing' WHEN 'done' THEN 'ready' WHEN 'failed' THEN 'failed' ELSE d.status END AS status,
 CASE s.state WHEN 'failed' THEN coalesce(s.message, 'parse failed') WHEN 'done' THEN NULL ELSE 'old' END AS error_message, coalesce(s.progress, 0.5) AS progress,
 coalesce(s.chunk_count, d.chunk_count) AS chunk_count, coalesce(s.token_count, d.token_count) AS token_count
FROM fx_document d LEFT JOIN (SELECT * FROM fx_status WHERE document_id IN (SELECT CAST(doc_id AS STRING) FROM labels)) s ON s.document_id = d.document_id""")
def _(t):
    documents = t.document.withColumns({"error_message": F.lit("old"), "progress": F.lit(0.5)})
    found = t.status.join(t.labels.select(F.col("doc_id").cast("string").alias("document_id")), "document_id", "left_semi")
    return catalog.sync_status(documents, found).select(
        "document_id", "status", "error_message", "progress", "chunk_count", "token_count")


@query("k7_pending_documents", "SELECT document_id, state, updated_at FROM fx_status WHERE state IN ('pending', 'parsing')")
def _(t):
    return catalog.pending_documents(t.status).select("document_id", "state", "updated_at")


@query("k8_queue_status", """
SELECT count(*) FILTER (WHERE state = 'pending') AS queued, count(*) FILTER (WHERE state = 'parsing') AS running, count(*) FILTER (WHERE state = 'done') AS done,
 count(*) FILTER (WHERE state = 'failed') AS failed,
 (SELECT message FROM fx_status WHERE state = 'failed' ORDER BY updated_at DESC, document_id DESC LIMIT 1) AS last_error FROM fx_status""")
def _(t):
    return catalog.queue_status(t.status)


@query("k9_index_stats", """
SELECT d.dataset_id, d.n AS documents, coalesce(c.n, 0) AS chunks FROM (SELECT dataset_id, count(*) AS n FROM fx_status GROUP BY ROLLUP (dataset_id)) d
LEFT JOIN (SELECT concat('ds', CAST(kb_id AS STRING)) AS dataset_id, count(*) AS n FROM d_line GROUP BY ROLLUP (concat('ds', CAST(kb_id AS STRING)))) c ON c.dataset_id IS NOT DISTINCT FROM d.dataset_id""")
def _(t):
    return catalog.index_stats(t.status, index_chunks(t))


@query("k10_system_overview", """
SELECT (SELECT count(*) FROM fx_user) AS users, (SELECT count(*) FROM fx_kb) AS kbs, (SELECT count(*) FROM fx_document) AS documents,
 (SELECT CAST(sum(chunk_count) AS BIGINT) FROM fx_document) AS chunks""")
def _(t):
    return catalog.system_overview(t.user, t.kb, t.document)


_PATCH = """(SELECT CAST(doc_id AS STRING) AS document_id, doc_id % 25 AS kb_id, CASE WHEN quality = 1 THEN concat('n', CAST(doc_id AS STRING)) END AS name,
 CASE WHEN toxic = 1 THEN 'restricted' END AS visibility, quality = 0 AS set_folder, CASE WHEN toxic = 0 THEN doc_id % 30 + 1 END AS folder_id FROM labels)"""


def patched(t):
    doc = F.col("doc_id")
    patch = t.labels.select(
        doc.cast("string").alias("document_id"), (doc % 25).alias("kb_id"),
        F.when(F.col("quality") == 1, F.concat(F.lit("n"), doc.cast("string"))).alias("name"),
        F.when(F.col("toxic") == 1, "restricted").alias("visibility"), (F.col("quality") == 0).alias("set_folder"),
        F.when(F.col("toxic") == 0, doc % 30 + 1).alias("folder_id"))
    return catalog.update_documents(t.document, patch, t.folder)


_PATCH_BAD = f"(SELECT * FROM {_PATCH} p WHERE set_folder AND folder_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx_folder f WHERE f.folder_id = p.folder_id AND f.kb_id = p.kb_id))"


@query("k11_update_documents", f"""
SELECT d.document_id, coalesce(p.name, d.name) AS name, coalesce(p.visibility, d.visibility) AS visibility,
 CASE WHEN p.set_folder THEN p.folder_id ELSE d.folder_id END AS folder_id
FROM fx_document d LEFT JOIN (SELECT * FROM {_PATCH} WHERE document_id NOT IN (SELECT document_id FROM {_PATCH_BAD})) p ON p.document_id = d.document_id""")
def _(t):
    return patched(t)[0].select("document_id", "name", "visibility", "folder_id")


@query("k11_update_documents_rejected", f"SELECT document_id FROM {_PATCH_BAD}")
def _(t):
    return patched(t)[1].select("document_id")


def registered(t):
    from grantseek.sources import files
    scanned = files.file_identity(files.validate_files(t.file.withColumns({"path": F.concat(F.lit("/in/"), F.col("doc_id").cast("string")), "content": F.col("text")})))
    return catalog.bulk_register(scanned.withColumn("name", F.col("display_name")), 3, " a, b ,", "https://docs.example/")


@query("k12_bulk_register", """
SELECT concat('/in/', CAST(doc_id AS STRING)) AS source_path, sha256(text) AS checksum, concat('https://docs.example/', regexp_replace(base, '\\.[^.]*$', '')) AS original_url, 'a|b' AS tags
FROM (SELECT *, substring(regexp_replace(trim(regexp_extract(name, '[^/]*$')), '[^\\p{L}\\p{N}_\\-. ]', '_', 'g'), 1, 200) AS base FROM fx_file)
WHERE lower(regexp_extract(base, '^.*[^.].*\\.([^.]*)$', 1)) IN ('pdf', 'txt', 'md', 'epub', 'html') AND size > 0 AND size <= 209715200""")
def _(t):
    return registered(t)[0].select("source_path", "checksum", "original_url", F.array_join("tags", "|").alias("tags"))


@query("k12_bulk_register_counts", """
SELECT success, count(*) AS files FROM (SELECT lower(regexp_extract(trim(regexp_extract(name, '[^/]*$')), '^.*[^.].*\\.([^.]*)$', 1)) IN ('pdf', 'txt', 'md', 'epub', 'html')
 AND size > 0 AND size <= 209715200 AS success FROM fx_file) GROUP BY success""")
def _(t):
    return registered(t)[1]


@query("k13_resolve_tags", "SELECT DISTINCT name FROM (SELECT tag AS name FROM fx_user UNION ALL SELECT source FROM documents)")
def _(t):
    tags = catalog.list_tags(t.user)
    asked = t.documents.select(F.concat(F.lit("  "), "source", F.lit(" ")).alias("name"))
    return catalog.resolve_tags(tags, asked)


@query("k14_list_users", "SELECT user_id, username FROM fx_user WHERE role = 'collaborator' AND is_active AND username ILIKE '%#0000%'")
def _(t):
    return catalog.list_users(t.user, "#0000", "collaborator", True).select("user_id", "username")


@query("k14_list_tags", "SELECT DISTINCT tag AS name FROM fx_user")
def _(t):
    return catalog.list_tags(t.user)


@query("k15_last_admin_check", """
SELECT user_id, n - CAST(was AS INT) + CAST(will AS INT) AS admins_left, n - CAST(was AS INT) + CAST(will AS INT) > 0 AS allowed
FROM (SELECT user_id, role = 'admin' AND is_active AS was, role = 'collaborator' AND user_id % 3 = 0 AS will,
 (SELECT count(*) FROM fx_user WHERE role = 'admin' AND is_active) AS n FROM fx_user)""")
def _(t):
    changes = t.user.select("user_id", F.when(F.col("role") == "collaborator", "admin").otherwise("user").alias("new_role"),
                            (F.col("user_id") % 3 == 0).alias("new_active"))
    return catalog.last_admin_check(t.user, changes).select("user_id", "admins_left", "allowed")


@query("k16_cascade_delete_kbs", """
SELECT 'grant' AS kind, count(*) AS n FROM fx_grant WHERE kb_id IN (SELECT kb_id FROM fx_kb WHERE is_active)
UNION ALL SELECT 'document', count(*) FROM fx_document WHERE kb_id IN (SELECT kb_id FROM fx_kb WHERE is_active)
UNION ALL SELECT 'folder', count(*) FROM fx_folder WHERE kb_id IN (SELECT kb_id FROM fx_kb WHERE is_active)
UNION ALL SELECT 'acl', count(*) FROM fx_acl WHERE kb_id IN (SELECT kb_id FROM fx_kb WHERE is_active)""")
def _(t):
    left = catalog.cascade_delete_kbs(t.kb.where("NOT is_active"), grant=t.grant, document=t.document, folder=t.folder, acl=t.acl)
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n") for name, df in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("k16_cascade_delete_users", """
SELECT o_orderkey AS acl_id, CASE WHEN o_custkey IN (SELECT user_id FROM fx_user WHERE is_active) THEN o_custkey END AS created_by FROM orders""")
def _(t):
    acl = t.acl.join(t.orders.select(F.col("o_orderkey").alias("acl_id"), F.col("o_custkey").alias("created_by")), "acl_id")
    left = catalog.cascade_delete_users(t.user.where("NOT is_active"), owned={"grant": t.grant}, authored={"acl": (acl, "created_by")})
    return left["acl"].select("acl_id", "created_by")


@query("k16_cascade_delete_user_grants", "SELECT user_id, kb_id FROM fx_grant WHERE user_id IN (SELECT user_id FROM fx_user WHERE is_active)")
def _(t):
    left = catalog.cascade_delete_users(t.user.where("NOT is_active"), owned={"grant": t.grant}, authored={})
    return left["grant"].select("user_id", "kb_id")
