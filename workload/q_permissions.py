"""Permission and folder queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantseek.common import cut_lineage
from grantseek.operators import folders as tree
from grantseek.operators import permissions as perm
from grantseek.plans import retrieval
from workload.q_search import catalogue_of, scoped
from workload.registry import query


def by_request(t, df, requests):
    """Rows per request instead of per merged scope."""
    return cut_lineage(requests.select("query_id", "scope_id")).join(df, "scope_id").drop("scope_id")


# ---------------------------------------------------------------- collections

@query("p1_kb_capabilities", """
SELECT p.user_id, p.kb_id, u.role = 'admin' OR coalesce(g.can_read, false) AS can_read, u.role = 'admin' OR coalesce(g.can_upload, false) AS can_upload,
 u.role = 'admin' OR coalesce(g.can_manage, false) AS can_manage
FROM (SELECT o_custkey AS user_id, (o_orderkey + 1) % 25 AS kb_id FROM orders UNION SELECT user_id, kb_id FROM fx_grant) p
JOIN fx_user u ON u.user_id = p.user_id LEFT JOIN fx_grant g ON g.user_id = p.user_id AND g.kb_id = p.kb_id""")
def _(t):
    asked = t.orders.select(F.col("o_custkey").alias("user_id"), ((F.col("o_orderkey") + 1) % 25).alias("kb_id"))
    pairs = asked.unionByName(t.grant.select("user_id", "kb_id")).distinct()
    return perm.kb_capabilities(pairs, t.user, t.grant)


@query("p2_readable_kbs", "SELECT user_id, kb_id FROM d_readable")
def _(t):
    return perm.readable_kbs(t.user, t.kb, t.grant)


@query("p3_uploadable_kbs", "SELECT user_id, kb_id FROM d_uploadable")
def _(t):
    return perm.uploadable_kbs(t.user, t.kb, t.grant)


@query("p4_requested_scope", "SELECT scope_id AS query_id, kb_id, is_admin FROM d_scope_kb")
def _(t):
    requests, resolved = scoped(t)
    return by_request(t, resolved.access.select("scope_id", "kb_id", "is_admin"), requests)


@query("p5_expand_subjects", """
SELECT user_id, 'user' AS subject_type, CAST(user_id AS STRING) AS subject_id FROM fx_user UNION ALL SELECT user_id, 'role', role FROM fx_user
UNION ALL SELECT user_id, 'tag', tag FROM fx_user""")
def _(t):
    return perm.expand_subjects(perm.user_scopes(t.user)).withColumnRenamed("scope_id", "user_id")


@query("p6_applicable_rules", """
SELECT scope_id AS query_id, kb_id, CASE WHEN chunk_id IS NOT NULL THEN 'chunk' WHEN document_id IS NOT NULL THEN 'document' WHEN folder_id IS NOT NULL THEN 'folder' ELSE 'kb' END AS target,
 document_id, chunk_id, folder_id, bool_or(effect = 'allow') AS allow, bool_or(effect = 'deny') AS deny FROM d_rule
GROUP BY scope_id, kb_id, document_id, chunk_id, folder_id""")
def _(t):
    requests, resolved = scoped(t)
    return by_request(t, resolved.rules, requests)


@query("p7_folder_visibility", "SELECT scope_id AS query_id, kb_id, folder_id, denied, visible, granted FROM d_folder_state")
def _(t):
    requests, resolved = scoped(t)
    return by_request(t, perm.folder_visibility(resolved.access, resolved.places, resolved.hits), requests)


@query("p8_document_visibility", """
SELECT scope_id AS query_id, kb_id, document_id, decided_by, decided_by IN ('rule_allow', 'admin', 'folder_allow', 'public') AS visible FROM d_decision""")
def _(t):
    requests, resolved = scoped(t)
    return by_request(t, perm.document_visibility(**resolved.decide()), requests)


@query("p9_chunk_visibility", """
SELECT k.scope_id AS query_id, c.chunk_id, CASE
  WHEN EXISTS (SELECT 1 FROM d_chunk_rule r WHERE r.scope_id = k.scope_id AND r.chunk_id = c.chunk_id AND r.effect = 'deny') THEN false
  WHEN EXISTS (SELECT 1 FROM d_chunk_rule r WHERE r.scope_id = k.scope_id AND r.chunk_id = c.chunk_id AND r.effect = 'allow') THEN true
  WHEN EXISTS (SELECT 1 FROM d_chunk_rule r WHERE r.scope_id = k.scope_id AND r.document_id = c.document_id AND r.effect = 'allow') THEN false
  ELSE EXISTS (SELECT 1 FROM d_visible v WHERE v.scope_id = k.scope_id AND v.document_id = c.document_id) END AS visible
FROM d_scope_kb k JOIN fx_document d ON d.kb_id = k.kb_id JOIN fx_chunk c ON c.document_id = d.document_id""")
def _(t):
    """Every chunk of the collections each request may read."""
    requests, resolved = scoped(t)
    chunks = t.chunk.select("chunk_id", "document_id").join(t.document.select("document_id", "kb_id"), "document_id")
    seen = perm.chunk_visibility(chunks, **resolved.decide())
    return by_request(t, seen, requests).select("query_id", "chunk_id", "visible")


@query("p10_search_documents", "SELECT scope_id AS query_id, document_id FROM d_search_doc")
def _(t):
    requests, resolved = scoped(t)
    visible = perm.document_visibility(**resolved.decide())
    return by_request(t, perm.search_documents(visible, resolved.rules), requests)


@query("p10_audience", """
SELECT d.document_id, count(*) AS n_requests, CAST(sum(s.scope_id) AS BIGINT) AS id_sum FROM d_search_doc s JOIN fx_document d ON d.document_id = s.document_id GROUP BY d.document_id""")
def _(t):
    """The per-document list a search uses gives the same pairs."""
    requests, resolved = scoped(t)
    listed = perm.audience(**resolved.listing())
    pairs = listed.select("document_id", F.explode("audience").alias("scope_id"))
    return by_request(t, pairs, requests).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_requests"), F.sum("query_id").alias("id_sum"))


@query("p11_scope_stats", """
SELECT s.scope_id AS query_id,
 (SELECT count(*) FROM d_scope_kb k WHERE k.scope_id = s.scope_id) AS kb_count,
 (SELECT count(*) FROM d_scope_kb k WHERE k.scope_id = s.scope_id) AS dataset_count,
 (SELECT count(*) FROM d_visible v WHERE v.scope_id = s.scope_id) AS visible_documents,
 (SELECT count(*) FROM d_search_doc v WHERE v.scope_id = s.scope_id) AS searchable_documents,
 (SELECT count(*) FROM d_decision v WHERE v.scope_id = s.scope_id) AS total_documents,
 (SELECT count(DISTINCT chunk_id) FROM d_chunk_rule r WHERE r.scope_id = s.scope_id AND r.effect = 'allow') AS chunk_allow_rules,
 (SELECT count(DISTINCT chunk_id) FROM d_chunk_rule r WHERE r.scope_id = s.scope_id AND r.effect = 'deny') AS chunk_deny_rules,
 (SELECT count(DISTINCT document_id) FROM d_chunk_rule r WHERE r.scope_id = s.scope_id AND r.effect = 'allow') AS documents_in_whitelist_mode,
 (SELECT count(*) FROM d_folder_state f WHERE f.scope_id = s.scope_id) AS total_folders,
 (SELECT count(*) FROM d_folder_state f WHERE f.scope_id = s.scope_id AND f.visible) AS visible_folders,
 (SELECT count(*) FROM d_folder_state f WHERE f.scope_id = s.scope_id AND f.granted) AS folder_granted FROM d_scope s""")
def _(t):
    requests, r = scoped(t)
    stats = perm.scope_stats(r.scopes, documents=t.document, **r.listing())
    return by_request(t, stats, requests)


@query("p12_diagnose", """
SELECT DISTINCT scope_id AS query_id, kind, item FROM (
 SELECT scope_id, CASE WHEN decided_by IN ('rule_allow', 'admin', 'folder_allow', 'public') THEN 'visible_document' ELSE 'hidden_document' END AS kind, document_id AS item FROM d_decision
 UNION ALL SELECT scope_id, CASE WHEN effect = 'allow' THEN 'allowed_chunk' ELSE 'denied_chunk' END, chunk_id FROM d_chunk_rule
 UNION ALL SELECT scope_id, 'whitelist_document', document_id FROM d_chunk_rule WHERE effect = 'allow'
 UNION ALL SELECT scope_id, CASE WHEN visible THEN 'visible_folder' ELSE 'hidden_folder' END, CAST(folder_id AS STRING) FROM d_folder_state
 UNION ALL SELECT scope_id, 'granted_folder', CAST(folder_id AS STRING) FROM d_folder_state WHERE granted)""")
def _(t):
    requests, r = scoped(t)
    return by_request(t, perm.diagnose(**r.listing()), requests)


@query("p13_visibility_matrix", """
SELECT document_id, decided_by, count(*) AS n_scopes FROM d_decision GROUP BY document_id, decided_by""")
def _(t):
    """How many requests each kind of rule decides, per document; one scope per request."""
    requests = t.request.select("query_id", "user_id").withColumn("scope_id", F.col("query_id"))
    asked = t.request_kb.groupBy("query_id").agg(F.collect_set("kb_id").alias("kb_ids"))
    requests = requests.join(asked, "query_id", "left").withColumn(
        "kb_ids", F.coalesce("kb_ids", F.array().cast("array<bigint>")))
    cat = catalogue_of(t)
    r = retrieval.resolve(perm.scopes_of(requests, cat.users), cat)
    return perm.visibility_matrix(**r.listing())


@query("p13_user_visible_counts", """
SELECT u.user_id, count(*) AS n_visible FROM (SELECT user_id, kb_id, decided_by FROM (
 SELECT k.user_id, d.kb_id, d.document_id, CASE
  WHEN coalesce(r.deny, false) OR coalesce(b.deny, false) THEN 'rule_deny' WHEN coalesce(r.allow, false) OR coalesce(b.allow, false) THEN 'rule_allow'
  WHEN coalesce(h.deny, false) THEN 'folder_deny' WHEN k.role = 'admin' THEN 'admin' WHEN coalesce(h.allow, false) THEN 'folder_allow'
  WHEN x.folder_id IS NOT NULL THEN 'folder_hidden' WHEN d.visibility = 'public' THEN 'public' ELSE 'restricted' END AS decided_by
 FROM (SELECT a.user_id, a.kb_id, u.role FROM d_readable a JOIN fx_user u ON u.user_id = a.user_id) k JOIN fx_document d ON d.kb_id = k.kb_id
 LEFT JOIN (SELECT user_id, document_id, bool_or(effect = 'allow') AS allow, bool_or(effect = 'deny') AS deny FROM e_rule WHERE chunk_id IS NULL AND document_id IS NOT NULL GROUP BY ALL) r
  ON r.user_id = k.user_id AND r.document_id = d.document_id
 LEFT JOIN (SELECT user_id, kb_id, bool_or(effect = 'allow') AS allow, bool_or(effect = 'deny') AS deny FROM e_rule WHERE document_id IS NULL AND folder_id IS NULL GROUP BY ALL) b
  ON b.user_id = k.user_id AND b.kb_id = d.kb_id
 LEFT JOIN (SELECT r.user_id, c.folder_id, bool_or(r.effect = 'allow') AS allow, bool_or(r.effect = 'deny') AS deny FROM e_rule r
   JOIN d_closure c ON c.ancestor_id = r.folder_id WHERE r.folder_id IS NOT NULL GROUP BY ALL) h ON h.user_id = k.user_id AND h.folder_id = d.folder_id
 LEFT JOIN (SELECT DISTINCT c.folder_id FROM d_closure c JOIN fx_folder f ON f.folder_id = c.ancestor_id AND f.visibility = 'restricted') x ON x.folder_id = d.folder_id)
 ) u WHERE decided_by IN ('rule_allow', 'admin', 'folder_allow', 'public') GROUP BY u.user_id""".replace(
    "e_rule", """(SELECT u.user_id, a.kb_id, a.document_id, a.chunk_id, a.folder_id, a.effect FROM (
   SELECT user_id, 'user' AS st, CAST(user_id AS STRING) AS si FROM fx_user UNION ALL SELECT user_id, 'role', role FROM fx_user UNION ALL SELECT user_id, 'tag', tag FROM fx_user) u
   JOIN fx_acl a ON a.subject_type = u.st AND a.subject_id = u.si JOIN d_readable k ON k.user_id = u.user_id AND k.kb_id = a.kb_id)"""))
def _(t):
    """Visible documents of every user, without a row per user and document."""
    cat = catalogue_of(t)
    users = retrieval.resolve_classes(perm.user_scopes(cat.users), cat)
    counts = users.visible_counts().where("n_visible > 0")
    return counts.withColumnRenamed("scope_id", "user_id")


@query("p14_grant_kb", """
SELECT coalesce(g.user_id, n.user_id) AS user_id, coalesce(g.kb_id, n.kb_id) AS kb_id, coalesce(n.can_read, g.can_read) AS can_read,
 coalesce(n.can_upload, g.can_upload) AS can_upload, coalesce(n.can_manage, g.can_manage) AS can_manage
FROM fx_grant g FULL JOIN (SELECT c_custkey AS user_id, CAST(c_nationkey AS BIGINT) AS kb_id, true AS can_read, c_acctbal > 0 AS can_upload, false AS can_manage FROM customer) n
 ON n.user_id = g.user_id AND n.kb_id = g.kb_id""")
def _(t):
    new = t.customer.select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("bigint").alias("kb_id"), F.lit(True).alias("can_read"),
        (F.col("c_acctbal") > 0).alias("can_upload"), F.lit(False).alias("can_manage"))
    return perm.grant_kb(t.grant, new)


_REVOKED = "(SELECT c_custkey AS user_id, CAST(c_nationkey AS BIGINT) AS kb_id FROM customer)"


def revoked(t):
    who = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("bigint").alias("kb_id"))
    return perm.revoke_kb(t.grant, t.acl, who)


@query("p15_revoke_kb", f"""
SELECT user_id, kb_id FROM fx_grant g WHERE NOT EXISTS (SELECT 1 FROM {_REVOKED} w WHERE w.user_id = g.user_id AND w.kb_id = g.kb_id)""")
def _(t):
    return revoked(t)[0].select("user_id", "kb_id")


@query("p15_revoke_kb_rules", f"""
SELECT acl_id FROM fx_acl a WHERE NOT (a.subject_type = 'user' AND EXISTS (SELECT 1 FROM {_REVOKED} w JOIN fx_grant g ON g.user_id = w.user_id AND g.kb_id = w.kb_id
 WHERE CAST(w.user_id AS STRING) = a.subject_id AND w.kb_id = a.kb_id))""")
def _(t):
    return revoked(t)[1].select("acl_id")


@query("p15_revoke_kb_counts", f"""
SELECT w.user_id, w.kb_id, (SELECT count(*) FROM fx_acl a WHERE a.subject_type = 'user' AND a.subject_id = CAST(w.user_id AS STRING) AND a.kb_id = w.kb_id) AS removed_rules
FROM {_REVOKED} w JOIN fx_grant g ON g.user_id = w.user_id AND g.kb_id = w.kb_id""")
def _(t):
    return revoked(t)[2]


_NEW_RULES = """(SELECT 10000000 + doc_id AS acl_id, CASE WHEN quality = 1 THEN doc_id % 25 ELSE (doc_id + 1) % 25 END AS kb_id, 'tag' AS subject_type, 'BUILDING' AS subject_id,
 CASE WHEN toxic = 0 THEN CAST(doc_id AS STRING) END AS document_id, CASE WHEN toxic = 0 THEN 'allow' ELSE 'deny' END AS effect FROM labels)"""


def new_rules(t):
    toxic, doc = F.col("toxic") == 1, F.col("doc_id")
    return t.labels.select(
        (F.lit(10000000).cast("bigint") + doc).alias("acl_id"), F.when(F.col("quality") == 1, doc % 25).otherwise((doc + 1) % 25).alias("kb_id"),
        F.lit("tag").alias("subject_type"), F.lit("BUILDING").alias("subject_id"),
        F.when(~toxic, doc.cast("string")).alias("document_id"), F.lit(None).cast("string").alias("chunk_id"),
        F.lit(None).cast("bigint").alias("folder_id"), F.when(toxic, "deny").otherwise("allow").alias("effect"))


@query("p16_add_acl", f"""
SELECT acl_id, kb_id, document_id, effect FROM fx_acl UNION ALL SELECT acl_id, kb_id, document_id, effect FROM {_NEW_RULES} n
WHERE document_id IS NULL OR EXISTS (SELECT 1 FROM fx_document d WHERE d.document_id = n.document_id AND d.kb_id = n.kb_id)""")
def _(t):
    return perm.add_acl(t.acl, new_rules(t), t.document)[0].select("acl_id", "kb_id", "document_id", "effect")


@query("p16_add_acl_rejected", f"""
SELECT acl_id, kb_id, document_id FROM {_NEW_RULES} n WHERE document_id IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM fx_document d WHERE d.document_id = n.document_id AND d.kb_id = n.kb_id)""")
def _(t):
    return perm.add_acl(t.acl, new_rules(t), t.document)[1].select("acl_id", "kb_id", "document_id")


@query("p16_add_acl_batch", """
SELECT kb_id, subject_id, document_id, chunk_id, effect FROM fx_acl UNION ALL
SELECT doc_id % 25, 'MACHINERY', CAST(doc_id AS STRING), concat(CAST(doc_id AS STRING), '-', s), 'allow' FROM labels CROSS JOIN (VALUES ('0000'), ('0001')) v(s)""")
def _(t):
    doc = F.col("doc_id").cast("string")
    new = t.labels.select(
        (F.col("doc_id") % 25).alias("kb_id"), F.lit("tag").alias("subject_type"), F.lit("MACHINERY").alias("subject_id"),
        doc.alias("document_id"), F.array(F.concat(doc, F.lit("-0000")), F.concat(doc, F.lit("-0001"))).alias("chunk_ids"),
        F.lit("allow").alias("effect"))
    return perm.add_acl_batch(t.acl, new).select("kb_id", "subject_id", "document_id", "chunk_id", "effect")


@query("p17_remove_acl", """
SELECT acl_id FROM fx_acl a WHERE acl_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')
 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND CAST(l.doc_id AS STRING) = a.document_id AND l.doc_id % 25 = a.kb_id)""")
def _(t):
    ids = t.events.where("event_type = 'error'").select(F.col("event_id").alias("acl_id"))
    docs = t.labels.where("toxic = 1").select((F.col("doc_id") % 25).alias("kb_id"), F.col("doc_id").cast("string").alias("document_id"))
    return perm.remove_acl(t.acl, ids, docs).select("acl_id")


def folder_grants(t):
    return t.part.select((F.col("p_partkey") % 25).alias("kb_id"), (F.col("p_partkey") + 1).alias("folder_id"), F.lit("role").alias("subject_type"),
                         F.when(F.col("p_size") % 2 == 0, " user ").otherwise("  ").alias("subject_id"), F.lit("deny").alias("effect"))


@query("p18_grant_folder_acl", """
SELECT acl_id, kb_id, folder_id, subject_type, subject_id, effect FROM fx_acl a WHERE NOT (a.folder_id IS NOT NULL AND a.subject_type = 'role' AND a.subject_id = 'user'
 AND EXISTS (SELECT 1 FROM part p WHERE p.p_size % 2 = 0 AND p.p_partkey + 1 = a.folder_id AND p.p_partkey % 25 = a.kb_id))
UNION ALL SELECT NULL, p_partkey % 25, p_partkey + 1, 'role', 'user', 'deny' FROM part WHERE p_size % 2 = 0""")
def _(t):
    return perm.grant_folder_acl(t.acl, folder_grants(t)).select("acl_id", "kb_id", "folder_id", "subject_type", "subject_id", "effect")


@query("p19_revoke_folder_acl", """
SELECT acl_id FROM fx_acl a WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = a.acl_id AND o.o_orderkey % 25 = a.kb_id AND a.folder_id IS NOT NULL)""")
def _(t):
    ids = t.acl.join(t.orders.select(F.col("o_orderkey").alias("acl_id")), "acl_id").where("acl_id % 25 = kb_id").select("kb_id", "folder_id", "acl_id")
    return perm.revoke_folder_acl(t.acl, ids).select("acl_id")


@query("p19_list_folder_acls", """
SELECT a.acl_id, a.folder_id, a.subject_id, a.effect FROM fx_acl a JOIN fx_folder f ON f.folder_id = a.folder_id AND f.kb_id = a.kb_id WHERE f.visibility = 'restricted'""")
def _(t):
    return perm.list_folder_acls(t.acl, t.folder.where("visibility = 'restricted'")).select("acl_id", "folder_id", "subject_id", "effect")


@query("p20_list_acl", """
SELECT acl_id, CASE WHEN chunk_id IS NOT NULL THEN 'chunk' WHEN document_id IS NOT NULL THEN 'document' WHEN folder_id IS NOT NULL THEN 'folder' ELSE 'knowledge_base' END AS scope
FROM fx_acl WHERE kb_id = 7""")
def _(t):
    return perm.list_acl(t.acl, 7).select("acl_id", "scope")


@query("p20_list_permissions", """
SELECT g.user_id, g.kb_id, g.can_read, u.username, u.role FROM fx_grant g LEFT JOIN fx_user u ON u.user_id = g.user_id""")
def _(t):
    return perm.list_permissions(t.grant, t.user).select("user_id", "kb_id", "can_read", "username", "role")


@query("p21_grant_candidates", """
SELECT user_id, EXISTS (SELECT 1 FROM fx_grant g WHERE g.user_id = u.user_id AND g.kb_id = 3) AS granted FROM fx_user u WHERE is_active AND username ILIKE '%CUSTOMER#%'""")
def _(t):
    return perm.grant_candidates(t.user, t.grant, 3, "CUSTOMER#").select("user_id", "granted")


# ---------------------------------------------------------------- folders

@query("f1_ancestor_closure", "SELECT folder_id, ancestor_id, distance FROM d_closure")
def _(t):
    return tree.ancestor_closure(t.folder)


_PATH = """(SELECT f.*, coalesce(p.path, '/') AS path, CAST(coalesce(p.depth, 0) AS INT) AS depth FROM fx_folder f LEFT JOIN (
 SELECT folder_id, concat('/', string_agg(CAST(ancestor_id AS STRING), '/' ORDER BY distance DESC), '/') AS path, count(*) AS depth
 FROM d_closure WHERE distance > 0 GROUP BY folder_id) p ON p.folder_id = f.folder_id)"""


@query("f2_materialize_paths", f"SELECT folder_id, path, depth FROM {_PATH}")
def _(t):
    return tree.materialize_paths(t.folder).select("folder_id", "path", "depth")


@query("f3_subtree", "SELECT ancestor_id AS root_id, folder_id, distance FROM d_closure WHERE ancestor_id IN (SELECT folder_id FROM fx_folder WHERE visibility = 'restricted')")
def _(t):
    roots = t.folder.where("visibility = 'restricted'").select(F.col("folder_id").alias("root_id"))
    return tree.subtree(tree.ancestor_closure(t.folder), roots)


_COUNTS = """(SELECT count(*) FROM fx_document d WHERE d.folder_id = f.folder_id) AS doc_count,
 (SELECT count(*) FROM fx_folder c WHERE c.parent_id = f.folder_id) AS child_count,
 (SELECT count(*) FROM fx_acl a WHERE a.folder_id = f.folder_id AND a.kb_id = f.kb_id) AS acl_count"""


@query("f4_folder_tree", f"SELECT f.folder_id, f.path, f.depth, {_COUNTS} FROM {_PATH} f")
def _(t):
    rows = tree.folder_tree(t.folder, t.document, t.acl, tree.ancestor_closure(t.folder))
    return rows.select("folder_id", "path", "depth", "doc_count", "child_count", "acl_count")


@query("f4_folder_tree_pruned", f"""
SELECT s.scope_id AS query_id, f.folder_id, {_COUNTS} FROM d_folder_state s JOIN fx_folder f ON f.folder_id = s.folder_id
WHERE NOT EXISTS (SELECT 1 FROM d_closure c JOIN d_folder_state x ON x.folder_id = c.ancestor_id WHERE x.scope_id = s.scope_id AND c.folder_id = s.folder_id AND NOT x.visible)""")
def _(t):
    requests, r = scoped(t)
    closure = tree.ancestor_closure(t.folder)
    rows = tree.folder_tree(t.folder, t.document, t.acl, closure, perm.open_folders(r.access, r.places, r.hits, closure))
    return by_request(t, rows, requests).select("query_id", "folder_id", "doc_count", "child_count", "acl_count")


@query("f4_root_documents", "SELECT kb_id, count(*) FILTER (WHERE folder_id IS NULL) AS root_doc_count FROM fx_document GROUP BY kb_id")
def _(t):
    return tree.root_document_counts(t.document)


_MOVED = """(SELECT folder_id AS root_id, kb_id + 1 AS target FROM fx_folder f WHERE visibility = 'restricted' AND folder_id <> kb_id + 1
 AND NOT EXISTS (SELECT 1 FROM d_closure c JOIN fx_folder r ON r.folder_id = c.ancestor_id AND r.visibility = 'restricted' WHERE c.folder_id = f.folder_id AND c.distance > 0))"""


@query("f5_move_folder", f"""
SELECT f.folder_id, CASE WHEN u.distance = 0 THEN u.target ELSE f.parent_id END AS parent_id,
 CASE WHEN u.distance = 0 THEN concat('/', CAST(u.target AS STRING), '/')
  WHEN u.distance > 0 THEN concat('/', CAST(u.target AS STRING), '/', substring(f.path, position(concat('/', CAST(u.root_id AS STRING), '/') IN f.path) + 1)) ELSE f.path END AS path,
 CAST(coalesce(1 + u.distance, f.depth) AS INT) AS depth
FROM {_PATH} f LEFT JOIN (SELECT c.folder_id, c.distance, m.root_id, m.target FROM d_closure c JOIN {_MOVED} m ON m.root_id = c.ancestor_id) u ON u.folder_id = f.folder_id""")
def _(t):
    """The topmost restricted folders move below the first folder of their collection; illegal moves are ignored."""
    closure = tree.ancestor_closure(t.folder)
    folders = tree.materialize_paths(t.folder, closure)
    shut = t.folder.where("visibility = 'restricted'").select("folder_id")
    nested = closure.where("distance > 0").join(shut.withColumnRenamed("folder_id", "ancestor_id"), "ancestor_id", "left_semi")
    topmost = t.folder.where("visibility = 'restricted'").join(nested, "folder_id", "left_anti").select("folder_id", (F.col("kb_id") + 1).alias("new_parent_id"))
    to_self = t.folder.where("visibility = 'public'").select("folder_id", F.col("folder_id").alias("new_parent_id"))
    into_child = t.folder.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("folder_id")).agg(F.max("folder_id").alias("new_parent_id"))
    abroad = t.folder.where("visibility = 'public'").select("folder_id", ((F.col("kb_id") + 1) % 25 + 1).alias("new_parent_id"))
    moves = topmost.unionByName(to_self).unionByName(into_child).unionByName(abroad)
    return tree.move_folder(folders, moves, closure).select("folder_id", "parent_id", "path", "depth")


_MOVES = "(SELECT CAST(doc_id AS STRING) AS document_id, doc_id % 25 AS kb_id, CASE WHEN quality = 1 THEN (doc_id + toxic) % 25 + 1 ELSE 0 END AS target FROM labels)"


@query("f6_move_documents", f"""
SELECT d.document_id, CASE WHEN m.document_id IS NULL THEN d.folder_id WHEN m.target = 0 THEN NULL
 WHEN EXISTS (SELECT 1 FROM fx_folder f WHERE f.folder_id = m.target AND f.kb_id = m.kb_id) THEN m.target ELSE d.folder_id END AS folder_id
FROM fx_document d LEFT JOIN {_MOVES} m ON m.document_id = d.document_id""")
def _(t):
    doc = F.col("doc_id")
    moves = t.labels.select(doc.cast("string").alias("document_id"), (doc % 25).alias("kb_id"),
                            F.when(F.col("quality") == 1, (doc + F.col("toxic")) % 25 + 1).otherwise(0).alias("new_folder_id"))
    return tree.move_documents(t.document, moves, t.folder).select("document_id", "folder_id")


@query("f7_deletable_folders", """
SELECT folder_id FROM fx_folder f WHERE NOT EXISTS (SELECT 1 FROM fx_folder c WHERE c.parent_id = f.folder_id) AND NOT EXISTS (SELECT 1 FROM fx_document d WHERE d.folder_id = f.folder_id)""")
def _(t):
    return tree.deletable_folders(t.folder, t.document).select("folder_id")


@query("f7_delete_folders_rules", """
SELECT acl_id FROM fx_acl a WHERE a.folder_id IS NULL OR a.folder_id NOT IN (SELECT folder_id FROM fx_folder f WHERE f.visibility = 'restricted'
 AND NOT EXISTS (SELECT 1 FROM fx_folder c WHERE c.parent_id = f.folder_id) AND NOT EXISTS (SELECT 1 FROM fx_document d WHERE d.folder_id = f.folder_id))""")
def _(t):
    return tree.delete_folders(t.folder, t.document, t.acl, t.folder.where("visibility = 'restricted'"))[1].select("acl_id")


@query("f8_sibling_name_conflicts", """
SELECT kb_id, parent_id, name, count(*) AS copies, min(folder_id) AS first_id FROM fx_folder GROUP BY kb_id, parent_id, name HAVING count(*) > 1""")
def _(t):
    return tree.sibling_name_conflicts(t.folder)
