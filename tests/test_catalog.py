from pyspark.sql import functions as F

from grantseek.operators import catalog, lexical
from grantseek.operators import permissions as perm
from grantseek.sources import index
from tests.test_permissions import ACL, GRANT


def test_page(spark):
    rows, total = catalog.page(spark.range(25), [F.desc("id")], 3, 10)
    assert [r["id"] for r in rows.collect()] == [4, 3, 2, 1, 0] and total == 25


def test_list_chunks_limits_before_the_keyword(spark):
    rows = [("d", i, "Apple" if i % 2 else "pear", 1) for i in range(10)]
    df = spark.createDataFrame(rows, "document_id string, ordinal int, content string, tokens bigint").withColumn("chunk_id", F.col("ordinal").cast("string"))
    assert [r["index"] for r in catalog.list_chunks(df, "d", "Apple", limit=4).collect()] == [1, 3]
    assert catalog.list_chunks(df, "d", "apple").count() == 0
    assert catalog.list_index_chunks(df, "d", "apple").count() == 5


def test_status_upsert_keeps_path(spark):
    schema = "document_id string, dataset_id string, name string, state string, message string, source_path string, ext string, updated_at bigint, chunk_count bigint, progress double"
    current = spark.createDataFrame([("a", "x", "old", "done", "m", "/p", "txt", 1, 5, 1.0)], schema)
    updates = spark.createDataFrame([("a", "x", "new", "pending", None, None, "md", 2), ("b", "x", "b", "pending", None, None, None, 2)],
                                    "document_id string, dataset_id string, name string, state string, message string, source_path string, ext string, updated_at bigint")
    got = {r["document_id"]: r for r in index.upsert_document_status(current, updates).collect()}
    a = got["a"]
    assert (a["name"], a["state"], a["message"], a["source_path"], a["ext"], a["chunk_count"]) == ("new", "pending", None, "/p", "md", 5)
    assert got["b"]["chunk_count"] == 0
    moved = index.set_document_state(current, spark.createDataFrame([("a", "failed", "why", None, 9), ("zz", "done", None, 1, 9)],
                                                                    "document_id string, state string, message string, chunk_count bigint, updated_at bigint"))
    assert [(r["document_id"], r["state"], r["message"], r["chunk_count"]) for r in moved.collect()] == [("a", "failed", "why", 5)]


def test_revoke_without_grant_removes_nothing(spark):
    grants = spark.createDataFrame([(1, 1, True, True, True)], GRANT)
    acl = spark.createDataFrame([(1, 1, "user", "1", None, None, None, "allow"), (2, 1, "user", "2", None, None, None, "allow"), (3, 1, "role", "1", None, None, None, "allow")], ACL)
    who = spark.createDataFrame([(1, 1), (2, 1)], "user_id bigint, kb_id bigint")
    left, rules, counts = perm.revoke_kb(grants, acl, who)
    assert left.count() == 0 and sorted(r["acl_id"] for r in rules.collect()) == [2, 3]
    assert [(r["user_id"], r["removed_rules"]) for r in counts.collect()] == [(1, 1)]


def test_grant_folder_acl_is_idempotent(spark):
    acl = spark.createDataFrame([], ACL)
    new = spark.createDataFrame([(1, 5, "tag", " hr ", "allow")], "kb_id bigint, folder_id bigint, subject_type string, subject_id string, effect string")
    once = perm.grant_folder_acl(acl, new)
    assert perm.grant_folder_acl(once, new).count() == 1


def test_tokenizer_mode_check(spark):
    meta = spark.createDataFrame([("token_mode", "jieba"), ("schema_version", "1")], "key string, value string")
    assert lexical.tokenizer_mode_check(meta).count() == 1
    assert lexical.tokenizer_mode_check(meta, "jieba").count() == 0


def test_resolve_tags(spark):
    tags = spark.createDataFrame([(1, "a")], "tag_id bigint, name string")
    names = spark.createDataFrame([(" a ",), ("b",), ("b",), (" ",)], "name string")
    assert sorted((r["name"], r["tag_id"]) for r in catalog.resolve_tags(tags, names).collect()) == [("a", 1), ("b", None)]


def test_queue_status_of_nothing(spark):
    empty = spark.createDataFrame([], "document_id string, state string, message string, updated_at bigint")
    row = catalog.queue_status(empty).first()
    assert (row["queued"], row["last_error"]) == (0, None)
