import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from grantseek.operators import lexical, logs
from grantseek.plans.ingest import load_documents
from grantseek.sources.store import IndexStore
from grantseek.streaming import ingest
from grantseek.streaming import logs as live

START = dt.datetime(2024, 1, 1)


def attempts(spark, rows):
    df = spark.createDataFrame([(i, u, START + dt.timedelta(minutes=m), ok) for i, (u, m, ok) in enumerate(rows)],
                               "attempt_id bigint, user_id bigint, tried_at timestamp, ok boolean")
    return df


def by_hand(rows):
    out, state = {}, {}
    for i, (u, m, ok) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[1][1], x[0])):
        n, until = state.get(u, (0, -1))
        if until > m:
            out[i] = "denied"
        elif ok:
            out[i], n, until = "success", 0, -1
        elif n == 4:
            out[i], n, until = "locked", 0, m + 15
        else:
            out[i], n = "failed", n + 1
        state[u] = (n, until)
    return out


def test_lockout_by_hand(spark):
    rows = [(1, m, False) for m in range(5)] + [(1, 10, True), (1, 19, True), (1, 20, False)]
    got = {r["attempt_id"]: r["outcome"] for r in logs.login_lockouts(attempts(spark, rows)).collect()}
    assert [got[i] for i in range(8)] == ["failed"] * 4 + ["locked", "denied", "success", "failed"]


@pytest.mark.parametrize("seed", range(3))
def test_lockouts_of_a_hot_user_cross_partitions(spark, seed):
    rng = random.Random(seed)
    rows = [(7 if rng.random() < 0.7 else rng.randrange(5), rng.randrange(2000), rng.random() < 0.1) for _ in range(1500)]
    df = attempts(spark, rows)
    got = {r["attempt_id"]: r["outcome"] for r in logs.login_lockouts(df).collect()}
    assert got == by_hand(rows)


def test_an_endless_row_of_failures_takes_two_replays(spark, monkeypatch):
    """Every boundary carries a count; the driver chains them without reading anything again."""
    rows = [(i, 7, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), False) for i in range(1600)]
    df = spark.createDataFrame(rows, "attempt_id bigint, user_id bigint, tried_at timestamp, ok boolean").repartition(16)
    replays = []
    real = type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, *a, **k: replays.append(1) or real(self, *a, **k))
    got = {r["attempt_id"]: r["outcome"] for r in logs.login_lockouts(df, minutes=0).collect()}
    assert got == {i: "locked" if i % 5 == 4 else "failed" for i in range(1600)} and len(replays) == 2


def test_pages_of_logs_go_on_after_a_key(spark):
    rows = spark.createDataFrame([(i, i // 3) for i in range(20)], "log_id bigint, created_at bigint")
    seen, after = [], None
    while page := [(r["created_at"], r["log_id"]) for r in logs.newest_logs(rows, 6, after).collect()]:
        seen += page
        after = page[-1]
    assert seen == sorted(((i // 3, i) for i in range(20)), reverse=True)


def test_lockout_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted(((rng.randrange(3), rng.randrange(600), rng.random() < 0.2) for _ in range(200)), key=lambda r: r[1])
    df = attempts(spark, rows)
    for part in range(4):  # four micro-batches in time order
        df.where(f"attempt_id >= {part * 50} AND attempt_id < {part * 50 + 50}").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    live.lockout_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(
        availableNow=True).start(out).awaitTermination()
    got = {r["attempt_id"]: r["outcome"] for r in spark.read.parquet(out).collect()}
    assert got == {r["attempt_id"]: r["outcome"] for r in logs.login_lockouts(df).collect()}


def test_versions(spark):
    versions = spark.createDataFrame(
        [(1, "win", "9.9.9", None, False, True)] + [(i, "win", f"1.0.{i}", "1.0.3", False, True) for i in range(2, 52)] + [(60, "mac", "2.0", None, True, False)],
        "version_id bigint, platform string, version string, min_supported_version string, mandatory boolean, published boolean")
    clients = spark.createDataFrame([(1, "win", "1.0.2"), (2, "win", "v1.0.51"), (3, "mac", "1.0")], "client_id bigint, platform string, current_version string")
    got = {r["client_id"]: (r["latest_version"], r["has_update"], r["mandatory"]) for r in logs.update_check(clients, versions).collect()}
    assert got == {1: ("1.0.51", True, True), 2: ("1.0.51", False, False), 3: (None, False, False)}  # 9.9.9 is not among the newest 50


def log_rows(spark, rows):
    return spark.createDataFrame([(i, START + dt.timedelta(minutes=m), u, "view", "success") for i, (u, m) in enumerate(rows)],
                                 "log_id bigint, created_at timestamp, user_id bigint, action string, status string")


def test_activity_sessions_in_batch(spark):
    rows = log_rows(spark, [(1, 0), (1, 29), (1, 60), (1, 200), (2, 5)])
    got = sorted((r["user_id"], r["n"]) for r in live.user_activity_sessions(rows, "30 minutes").collect())
    assert got == [(1, 1), (1, 1), (1, 2), (2, 1)]


def test_sliding_windows_in_batch(spark):
    rows = log_rows(spark, [(1, 10), (1, 70)])
    got = {r["window_start"].hour if r["window_start"].day == 1 else -1: r["total"] for r in live.log_stream_stats(rows, "2 hours", "1 hour").collect()}
    assert got == {-1: 1, 0: 2, 1: 1}


def test_list_logs_scopes_to_the_user(spark):
    rows = log_rows(spark, [(1, 0), (2, 0), (2, 60 * 24 * 30)]).withColumn("username", F.lit("bob"))
    now = START + dt.timedelta(days=1)
    assert logs.list_logs(rows, now, user_id=2, role="user").count() == 2
    assert logs.list_logs(rows, now, user_id=2, role="admin").count() == 3
    assert logs.list_logs(rows, now, user_id=2, role="admin", of_user=1, keyword="BOB").count() == 1


def test_ingest_stream_resumes_and_replaces(spark, tmp_path):
    src, idx, status, ck = (str(tmp_path / d) for d in ("src", "idx", "status", "ck"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.txt").write_text("first text about apples")
    (tmp_path / "src" / "b.txt").write_text("  ")
    run = lambda: ingest.ingest_stream(spark, src, idx, status, ck, "ds", buckets=2).awaitTermination()
    run()
    states = {r["name"]: (r["state"], r["chunk_count"]) for r in ingest.last_status(spark.read.parquet(status)).collect()}
    assert states == {"a.txt": ("done", 1), "b.txt": ("failed", 0)}
    (tmp_path / "src" / "c.md").write_text("second text about pears")
    run()  # only the new file is read
    now = IndexStore(spark, idx, 2).snapshot()
    assert sorted(r["content"] for r in now.chunks().collect()) == ["first text about apples", "second text about pears"]
    assert spark.read.parquet(status).where("batch = 1").count() == 1
    asked = spark.createDataFrame([(1, "pears")], "query_id bigint, question string")
    hits = lexical.bm25_search(now.stored_postings(), asked, now.stats()).collect()  # what was just loaded is found
    assert [r["chunk_id"] for r in hits] == [r["chunk_id"] for r in now.chunks().where("content LIKE 'second%'").collect()]


def test_files_stored_from_the_same_bytes_are_left_alone(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), 4)

    def load(rows):
        files = spark.createDataFrame([("ds", i, f"{i}.txt", bytearray(c.encode())) for i, c in rows], "dataset_id string, document_id string, name string, content binary")
        return {r["document_id"]: r["state"] for r in load_documents(files, store).collect()}
    assert load([("a", "apples and pears"), ("b", "plums"), ("c", " ")]) == {"a": "done", "b": "done", "c": "failed"}
    assert load([("a", "apples and pears"), ("b", "cherries"), ("c", " ")]) == {"b": "done", "c": "failed"}
    assert load([("b", " ")]) == {"b": "failed"}  # nothing readable is left of it
    assert [(r["document_id"], r["content"]) for r in store.snapshot().chunks().collect()] == [("a", "apples and pears")]
    for k in range(4):
        load([("d", f"round {k}")])
    before = len(store.snapshot().segments)
    store.maintain(most=3)
    after = store.snapshot()
    assert len(after.segments) < before and sorted(r["content"] for r in after.chunks().collect()) == ["apples and pears", "round 3"]
    assert {r["token"]: r["df"] for r in after.frequencies().collect()} == dict.fromkeys(["apples", "and", "pears", "round", "3"], 1)
