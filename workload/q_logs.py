"""Log, chat and version queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from grantseek.common import cut_lineage
from grantseek.operators import chat, logs
from grantseek.operators import permissions as perm
from grantseek.plans import retrieval
from grantseek.sources import audit
from workload.q_search import catalogue_of
from workload.registry import query

NOW = dt.datetime(2024, 1, 31)
_WEEK = "created_at >= TIMESTAMP '2024-01-24 00:00:00'"


def recent(t, days=7):
    return logs.recent(t.log, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), days)


@query("s18_audit_rows", "SELECT log_id, CAST(CAST(created_at AS DATE) AS STRING) AS day, detail, '***' AS token FROM fx_log")
def _(t):
    rows = audit.audit_rows(t.log.withColumn("detail", F.create_map(F.lit("k"), F.col("detail"), F.lit("Token"), F.col("username"))))
    return rows.select("log_id", F.col("day").cast("string").alias("day"), F.col("detail")["k"].alias("detail"), F.col("detail")["Token"].alias("token"))


@query("a1_list_logs", f"""
SELECT log_id, username, action FROM fx_log WHERE {_WEEK} AND status = 'denied' AND (username ILIKE '%u1%' OR path ILIKE '%u1%')""")
def _(t):
    rows = logs.list_logs(t.log, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), user_id=0, role="admin", status="denied", keyword="U1")
    return rows.select("log_id", "username", "action")


@query("a1_list_own_logs", f"SELECT log_id, action FROM fx_log WHERE {_WEEK} AND user_id = (SELECT max(user_id) FROM fx_log)")
def _(t):
    who = t.log.agg(F.max("user_id")).first()[0]
    rows = logs.list_logs(t.log, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), user_id=who, role="user")
    return rows.select("log_id", "action")


@query("a2_log_actions", "SELECT DISTINCT action FROM fx_log")
def _(t):
    return logs.log_actions(t.log)


@query("a3_log_status_counts", f"""
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'failed') AS failed,
 count(*) FILTER (WHERE status = 'denied') AS denied FROM fx_log WHERE {_WEEK}""")
def _(t):
    return logs.log_status_counts(recent(t))


@query("a4_top_actions", f"SELECT action, count(*) AS count FROM fx_log WHERE {_WEEK} GROUP BY action ORDER BY count DESC, action LIMIT 15")
def _(t):
    return logs.top_actions(recent(t))


@query("a5_top_users", f"SELECT username, count(*) AS count FROM fx_log WHERE {_WEEK} GROUP BY username ORDER BY count DESC, username LIMIT 15")
def _(t):
    return logs.top_users(recent(t))


@query("a6_log_daily_stats", """
SELECT CAST(CAST(created_at AS DATE) AS STRING) AS day, action, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS sum_ms, max(duration_ms) AS max_ms
FROM fx_log GROUP BY ROLLUP (CAST(created_at AS DATE), action)""")
def _(t):
    return logs.log_daily_stats(t.log).withColumn("day", F.col("day").cast("string"))


@query("a6_log_latency", """
SELECT action, count(*) AS n, quantile_disc(duration_ms, 0.5) AS p50_ms, quantile_disc(duration_ms, 0.95) AS p95_ms, quantile_disc(duration_ms, 0.99) AS p99_ms
FROM fx_log GROUP BY action""")
def _(t):
    return logs.log_latency(t.log, accuracy=1000000)


@query("a7_user_stats", """
SELECT s.user_id, count(DISTINCT s.session_id) AS sessions, count(m.message_id) AS messages FROM fx_session s LEFT JOIN fx_message m ON m.session_id = s.session_id GROUP BY s.user_id""")
def _(t):
    return chat.user_stats(t.session, t.message)


@query("a8_list_sessions", "SELECT session_id, user_id, updated_at FROM fx_session WHERE NOT is_archived AND title ILIKE '%on t%'")
def _(t):
    return chat.list_sessions(t.session, "on T").select("session_id", "user_id", "updated_at")


@query("a9_session_detail", "SELECT s.session_id, s.title, m.message_id, m.role, m.content FROM fx_session s LEFT JOIN fx_message m ON m.session_id = s.session_id")
def _(t):
    return chat.session_detail(t.session, t.message).select("session_id", "title", "message_id", "role", "content")


@query("a10_message_counts", "SELECT session_id, count(*) AS message_count FROM fx_message GROUP BY session_id")
def _(t):
    return chat.message_counts(t.message)


@query("a11_apply_feedback", """
SELECT message_id, CASE WHEN message_id % 3 = 0 AND message_id % 2 = 0 THEN 'up' WHEN message_id % 3 = 1 AND message_id % 2 = 0 THEN NULL ELSE 'down' END AS feedback FROM fx_message""")
def _(t):
    """Own marks on even messages count, marks by a stranger or with an unknown value do not."""
    m = F.col("message_id")
    mine = F.when(m % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1)
    value = F.when(m % 3 == 0, "up").when(m % 3 == 2, "sideways")
    feedback = t.message.select("message_id", mine.alias("user_id"), value.alias("value"))
    return chat.apply_feedback(t.message.withColumn("feedback", F.lit("down")), feedback, t.session).select("message_id", "feedback")


def exposures(t):
    rows = t.exposure.select("user_id", "created_at", F.array("hit_a", "hit_b").alias("hit_chunk_ids"))
    return chat.exposure_audit(rows)


_EXPOSED = "(SELECT user_id, created_at, hit_a AS chunk_id FROM fx_exposure UNION ALL SELECT user_id, created_at, hit_b FROM fx_exposure)"


@query("a12_exposure_audit", f"SELECT user_id, chunk_id, min(created_at) AS first_seen, count(*) AS n FROM {_EXPOSED} GROUP BY user_id, chunk_id")
def _(t):
    return exposures(t)


@query("a12_denied_exposure", f"""
SELECT DISTINCT e.user_id, e.chunk_id FROM {_EXPOSED} e JOIN fx_user u ON u.user_id = e.user_id JOIN fx_chunk c ON c.chunk_id = e.chunk_id
WHERE CASE WHEN EXISTS (SELECT 1 FROM d_chunk_rule_u r WHERE r.scope_id = e.user_id AND r.chunk_id = e.chunk_id AND r.effect = 'deny') THEN true
 WHEN EXISTS (SELECT 1 FROM d_chunk_rule_u r WHERE r.scope_id = e.user_id AND r.chunk_id = e.chunk_id AND r.effect = 'allow') THEN false
 WHEN EXISTS (SELECT 1 FROM d_chunk_rule_u r WHERE r.scope_id = e.user_id AND r.document_id = c.document_id AND r.effect = 'allow') THEN true
 ELSE NOT EXISTS (SELECT 1 FROM d_visible_u v WHERE v.scope_id = e.user_id AND v.document_id = c.document_id) END""")
def _(t):
    cat = catalogue_of(t)
    seen = exposures(t)
    users = cat.users.join(seen.select("user_id").distinct(), "user_id", "left_semi")
    found = seen.join(users.select("user_id"), "user_id", "left_semi").join(t.chunk.select("chunk_id", "document_id"), "chunk_id")
    found = cut_lineage(found.select(F.col("user_id").alias("scope_id"), "chunk_id", "document_id"))
    resolved = retrieval.resolve_found(found, perm.user_scopes(users), cat)
    decided = perm.chunk_visibility(found, **resolved.decide())
    return chat.denied_exposure(seen, decided).select("user_id", "chunk_id")


@query("a13_retrieval_quality", """
SELECT CAST(CAST(created_at AS DATE) AS STRING) AS day, count(*) AS answers, round(avg(log_id % 9), 6) AS mean_citations, round(sum(log_id % 4) / sum(log_id % 30 + 4), 6) AS dropped_share,
 round(avg(duration_ms), 6) AS mean_ms, round(avg(CASE WHEN status = 'failed' THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM fx_log GROUP BY CAST(created_at AS DATE)""")
def _(t):
    detail = F.to_json(F.struct((F.col("log_id") % 30 + 4).alias("raw_candidates"), (F.col("log_id") % 4).alias("dropped_by_permission"), (F.col("log_id") % 9).alias("citations")))
    return chat.retrieval_quality(t.log.withColumn("detail", detail)).withColumn("day", F.col("day").cast("string"))


_ATTEMPTS = """
 SELECT attempt_id, user_id, tried_at, ok, row_number() OVER (PARTITION BY user_id ORDER BY tried_at, attempt_id) AS rn FROM fx_attempt"""

LOCKOUT_SQL = f"""
SELECT attempt_id, user_id, outcome, failures FROM (WITH RECURSIVE a AS MATERIALIZED ({_ATTEMPTS}), run AS (
 SELECT attempt_id, user_id, tried_at, rn, CASE WHEN ok THEN 'success' ELSE 'failed' END AS outcome, CASE WHEN ok THEN 0 ELSE 1 END AS failures, TIMESTAMP '1970-01-01' AS until FROM a WHERE rn = 1
 UNION ALL SELECT a.attempt_id, a.user_id, a.tried_at, a.rn,
  CASE WHEN r.until > a.tried_at THEN 'denied' WHEN a.ok THEN 'success' WHEN r.failures + 1 >= 5 THEN 'locked' ELSE 'failed' END,
  CASE WHEN r.until > a.tried_at THEN r.failures WHEN a.ok THEN 0 WHEN r.failures + 1 >= 5 THEN 0 ELSE r.failures + 1 END,
  CASE WHEN r.until > a.tried_at THEN r.until WHEN a.ok THEN TIMESTAMP '1970-01-01' WHEN r.failures + 1 >= 5 THEN a.tried_at + INTERVAL 720 MINUTE ELSE r.until END
 FROM run r JOIN a ON a.user_id = r.user_id AND a.rn = r.rn + 1) SELECT * FROM run)"""


@query("a14_login_lockouts", LOCKOUT_SQL)
def _(t):
    return logs.login_lockouts(t.attempt, minutes=720).select("attempt_id", "user_id", "outcome", "failures")


@query("a15_active_devices", "SELECT token_id, user_id FROM fx_token WHERE NOT revoked AND expires_at > TIMESTAMP '1998-01-01 00:00:00'")
def _(t):
    return logs.active_devices(t.token, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")).select("token_id", "user_id")


_KEYED = """(SELECT *, [coalesce(TRY_CAST(p[1] AS INT), 0), coalesce(TRY_CAST(p[2] AS INT), 0), coalesce(TRY_CAST(p[3] AS INT), 0)] AS k
 FROM (SELECT *, string_split(split_part(ltrim(version, 'vV'), '-', 1), '.') AS p FROM fx_version WHERE published))"""
_LATEST = f"""(SELECT platform, version, mandatory, min_supported_version, k FROM (
 SELECT *, row_number() OVER (PARTITION BY platform ORDER BY k DESC, version_id DESC) AS best FROM (
  SELECT *, row_number() OVER (PARTITION BY platform ORDER BY version_id DESC) AS rn FROM {_KEYED}) WHERE rn <= 50) WHERE best = 1)"""


@query("a16_latest_version", f"SELECT platform, version AS latest_version, mandatory, min_supported_version FROM {_LATEST}")
def _(t):
    return logs.latest_version(t.version)


@query("a16_update_check", f"""
SELECT c.client_id, l.version AS latest_version, coalesce(l.k > c.k, false) AS has_update,
 coalesce(l.mandatory, false) OR coalesce(c.k < l.mk, false) AS mandatory
FROM (SELECT *, [CAST(p[1] AS INT), CAST(p[2] AS INT), 0] AS k FROM (SELECT *, string_split(current_version, '.') AS p FROM fx_client)) c
LEFT JOIN (SELECT *, CASE WHEN min_supported_version IS NOT NULL THEN [CAST(split_part(min_supported_version, '.', 1) AS INT), CAST(split_part(min_supported_version, '.', 2) AS INT), 0] END AS mk FROM {_LATEST}) l
 ON l.platform = c.platform""")
def _(t):
    return logs.update_check(t.client, t.version).select("client_id", "latest_version", "has_update", "mandatory")
