"""The stored index: commits, versions, statistics, and keyword search that skips what cannot matter."""

import json
import random
import re
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from grantseek.operators import best, hybrid, lexical, ranked
from grantseek.sources import store as stored
from grantseek.sources.store import ConcurrentCommit, IndexStore

SCHEMA = "dataset_id string, document_id string, chunk_id string, ordinal int, content string"
WORDS = [f"w{i}" for i in range(40)]


def rows_of(rng, dataset, document, n=3):
    words = lambda: " ".join(rng.choices(WORDS, weights=[60 // (i + 1) + 1 for i in range(40)], k=rng.randrange(0, 14)))
    return [(dataset, document, f"{dataset}-{document}-{i:04d}", i, words()) for i in range(n)]


def live(store, version=None):
    return sorted(tuple(r) for r in store.snapshot(version).chunks().select("dataset_id", "document_id", "chunk_id", "ordinal", "content").collect())


def rebuilt(snapshot):
    """Statistics made from the chunks themselves."""
    chunks = snapshot.chunks()
    totals = lexical.corpus_totals(chunks).first()
    return (totals["n_chunks"], round(totals["avg_dl"] or 0.0, 9)), {r["token"]: r["df"] for r in lexical.document_frequencies(lexical.build_postings(chunks)).collect()}


def kept(snapshot):
    totals = snapshot.totals().first()
    return (totals["n_chunks"], round(totals["avg_dl"] or 0.0, 9)), {r["token"]: r["df"] for r in snapshot.frequencies().collect()}


@pytest.fixture
def store(spark, tmp_path):
    return IndexStore(spark, str(tmp_path / "index"), buckets=4)


def test_commits_replace_whole_documents(spark, store):
    rng = random.Random(1)
    want = {}

    def commit(new=(), removed=()):
        for key in removed:
            want.pop(key, None)
        for key, rows in new:
            want[key] = rows
        store.commit(spark.createDataFrame([r for _, rows in new for r in rows], SCHEMA) if new else None,
                     spark.createDataFrame(list(removed), "dataset_id string, document_id string") if removed else None)
        assert live(store) == sorted(r for rows in want.values() for r in rows)
        assert kept(store.snapshot()) == rebuilt(store.snapshot())
        postings = sorted((r.token, r.dl, r.chunk_id) for r in store.snapshot().postings().collect())
        assert postings == sorted((r.token, r.dl, r.chunk_id) for r in lexical.build_postings(store.snapshot().chunks()).collect())

    docs = [("007", "1"), ("1e5", "1"), ("2024-01-01", "b"), ("x", "a/b c"), ("x", "1")]
    commit([(d, rows_of(rng, *d)) for d in docs])
    commit([(d, rows_of(rng, *d, n=5)) for d in docs[:2]])  # the same id in two datasets is two documents
    commit(removed=[("007", "1"), ("nowhere", "9")])
    commit([(("x", "1"), rows_of(rng, "x", "1", n=1)), (("new", "n"), rows_of(rng, "new", "n"))], removed=[("x", "1"), ("x", "a/b c")])
    commit([(("007", "1"), rows_of(rng, "007", "1"))])  # back again
    commit(removed=[("new", "n")])
    before = store.snapshot()
    store.compact(2)
    assert live(store) == sorted(r for rows in want.values() for r in rows) and kept(store.snapshot()) == kept(before)
    commit([(("007", "1"), rows_of(rng, "007", "1"))], removed=[("1e5", "1")])
    store.compact()
    after = store.snapshot()
    assert len(after.segments) == 1 and live(store) == sorted(r for rows in want.values() for r in rows)
    assert kept(after) == rebuilt(after)
    assert live(store, before.version) == sorted(tuple(r) for r in before.chunks().select("dataset_id", "document_id", "chunk_id", "ordinal", "content").collect())
    assert store.vacuum(keep=1) and live(store) == sorted(r for rows in want.values() for r in rows)
    commit([(("last", "1"), rows_of(rng, "last", "1"))])


def test_a_repeated_commit_changes_nothing(spark, store):
    rng = random.Random(2)
    rows = rows_of(rng, "a", "1") + rows_of(rng, "a", "2")
    store.commit(spark.createDataFrame(rows, SCHEMA))
    store.commit(spark.createDataFrame(rows, SCHEMA))
    assert live(store) == sorted(rows) and kept(store.snapshot()) == rebuilt(store.snapshot())


def test_a_writer_that_dies_is_not_seen(spark, store, monkeypatch):
    rng = random.Random(3)
    store.commit(spark.createDataFrame(rows_of(rng, "a", "1"), SCHEMA))
    old, stats = live(store), kept(store.snapshot())

    class Killed(Exception):
        pass

    def die(*_args):
        raise Killed
    for step in ("_write_postings", "_write_frequencies"):
        with monkeypatch.context() as m:
            m.setattr(IndexStore, step, staticmethod(die))
            with pytest.raises(Killed):
                store.commit(spark.createDataFrame(rows_of(rng, "a", "1"), SCHEMA))
        assert live(store) == old and kept(store.snapshot()) == stats
    with monkeypatch.context() as m:  # between the claim and the manifest
        m.setattr(stored, "json", SimpleNamespace(dumps=die, loads=json.loads))
        with pytest.raises(Killed):
            store.commit(spark.createDataFrame(rows_of(rng, "a", "1"), SCHEMA))
    assert live(store) == old
    with pytest.raises(ConcurrentCommit):
        store.commit(spark.createDataFrame(rows_of(rng, "a", "1"), SCHEMA))
    store.recover()
    new = rows_of(rng, "a", "1", n=2)
    assert store.commit(spark.createDataFrame(new, SCHEMA)) == 2
    assert live(store) == sorted(new)
    assert live(store, 1) == old  # a pinned version keeps its rows
    assert len(store.vacuum(keep=2)) == 4


def test_readers_pin_and_second_writers_fail(spark, store):
    rng = random.Random(4)
    first = rows_of(rng, "a", "1")
    store.commit(spark.createDataFrame(first, SCHEMA))
    pinned = store.snapshot()
    store.commit(spark.createDataFrame(rows_of(rng, "a", "1"), SCHEMA))
    assert sorted(r.chunk_id for r in pinned.chunks().collect()) == [r[2] for r in first]
    with pytest.raises(ConcurrentCommit):
        store._publish(1, 2, [], 0, 0, pinned.schema)
    with pytest.raises(ValueError, match="first commit"):
        IndexStore(spark, store.path + "-other").commit(removed=spark.createDataFrame([("a", "1")], "dataset_id string, document_id string"))


def plan(df):
    return df._jdf.queryExecution().explainString(spark_mode(df, "formatted"))


def spark_mode(df, name):
    return df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(name)


def test_a_commit_reads_only_the_buckets_it_replaces(spark, tmp_path, monkeypatch):
    store = IndexStore(spark, str(tmp_path / "index"), buckets=16)
    rng = random.Random(5)
    store.commit(spark.createDataFrame([r for d in range(60) for r in rows_of(rng, "a", str(d))], SCHEMA))
    asked = []
    chunks = stored.Snapshot.chunks

    def seen(self, buckets=None):
        out = chunks(self, buckets)
        asked.append((buckets, out))
        return out
    monkeypatch.setattr(stored.Snapshot, "chunks", seen)
    store.commit(spark.createDataFrame(rows_of(rng, "a", "7") + rows_of(rng, "a", "8"), SCHEMA))
    (buckets, read), = asked  # no other scan of the index
    assert 1 <= len(buckets) <= 2
    assert "PartitionFilters: [isnotnull(doc_bucket" in plan(read) or "PartitionFilters: [doc_bucket" in plan(read)
    assert kept(store.snapshot()) == rebuilt(store.snapshot())


def test_winners_are_fetched_from_their_buckets(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), buckets=16)
    rng = random.Random(10)
    store.commit(spark.createDataFrame([r for d in range(60) for r in rows_of(rng, "a", str(d))], SCHEMA))
    picked = spark.createDataFrame([(1, "a-7-0001", "7"), (2, "a-9-0000", "9"), (2, "a-9-0009", "9")], "query_id bigint, chunk_id string, document_id string")
    got = hybrid.late_fetch(picked, store.snapshot())
    assert sorted((r.query_id, r.chunk_id) for r in got.collect()) == [(1, "a-7-0001"), (2, "a-9-0000")]
    read = store.snapshot().holding(picked)
    assert scan_metric(read, "numPartitions") <= 2 and scan_metric(store.snapshot().chunks(), "numPartitions") > 10
    with pytest.raises(ValueError, match="16 buckets"):
        IndexStore(spark, store.path, buckets=4).commit(removed=picked.selectExpr("'a' AS dataset_id", "document_id"))


def scan_metric(df, name):
    """Sum of a metric over the file scans of an executed plan."""
    df.collect()
    total, queue = 0, [df._jdf.queryExecution().executedPlan()]
    while queue:
        node = queue.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            queue.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            queue.append(node.plan())
        if kind == "FileSourceScanExec" and node.metrics().contains(name):
            total += node.metrics().apply(name).value()
        children = node.children()
        queue += [children.apply(i) for i in range(children.size())]
    return total


def test_terms_reach_the_scan_and_skip_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "ROW_GROUP", 4096)
    store = IndexStore(spark, str(tmp_path / "index"), buckets=4)
    rows = [("a", str(d), f"{d:05d}", 0, " ".join(f"t{(d * 17 + i) % 3000:04d}" for i in range(12))) for d in range(4000)]
    store.commit(spark.createDataFrame(rows, SCHEMA))
    index = store.snapshot().stored_postings()
    found = ranked.matching(index.postings, {"t0100": (0, 50), "t2900": (0, 40)})
    text = plan(found)
    assert re.search(r"PushedFilters: \[.*In\(token, \[t0100,t2900\]\)", text) and "LessThanOrEqual(dl,50)" in text
    assert found.count() == sum(t in r[4].split() for r in rows for t in ("t0100", "t2900"))
    whole = index.postings.select("token", "chunk_id")
    read = index.postings.where(F.col("token").isin("t0100", "t2900")).select("token", "chunk_id")
    assert 0 < scan_metric(read, "numOutputRows") < scan_metric(whole, "numOutputRows") / 3


def test_lengths_above_are_those_of_every_length():
    rng = random.Random(6)
    for _ in range(500):
        weights = sorted((rng.choice([1e-6, rng.random() * 9]) for _ in range(rng.randrange(1, 9))), reverse=True)
        floor, avg = rng.random() * 12 + 1e-3, rng.random() * 30 + 1
        want = [d for d in range(1, 400) if sum(weights[:d]) * ranked.factor(d, avg) >= floor]
        got = ranked.lengths_above(weights, floor, avg)
        if want:
            assert got[0] <= want[0] and (got[1] >= want[-1]) and (want[-1] == 399 or got[1] == want[-1])
        else:
            assert got is None or got[0] > 399
    assert ranked.lengths_above([1.0], 0.0, 5.0) == (0, 2**31 - 1)


@pytest.mark.parametrize("seed,limit,scoped", [(1, 5, False), (2, 20, True), (3, 3, True), (4, 1000, False)])
def test_bounded_search_equals_the_sum_over_all_postings(spark, store, monkeypatch, seed, limit, scoped):
    monkeypatch.setattr(ranked, "FIRST", 1)
    rng = random.Random(seed)
    rows = [r for d in range(60) for r in rows_of(rng, f"s{d % 3}", str(d), n=6)]
    store.commit(spark.createDataFrame(rows[:180], SCHEMA))
    store.commit(spark.createDataFrame(rows[180:] + rows_of(rng, "s0", "0", n=2), SCHEMA), spark.createDataFrame([("s1", "1")], "dataset_id string, document_id string"))
    snapshot = store.snapshot()
    asked = [(q, " ".join(rng.sample(WORDS, rng.randrange(0, 9)) + ["never"])) for q in range(12)]
    queries = spark.createDataFrame(asked, "query_id bigint, question string")
    audience = None
    if scoped:
        audience = spark.createDataFrame([(str(d), [q for q in range(12) if (q + d) % 3]) for d in range(60)], "document_id string, audience array<bigint>")
    plain = lexical.bm25_search(lexical.build_postings(snapshot.chunks()), queries, lexical.corpus_stats(snapshot.chunks()), audience, limit)
    got = lexical.bm25_search(snapshot.stored_postings(), queries, snapshot.stats(), audience, limit)
    columns = ["query_id", "chunk_id", "document_id", "kw", "kw_rank"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))


@pytest.mark.parametrize("scoped", [False, True])
def test_where_very_many_postings_match_the_tokens_stay_where_they_are(spark, store, monkeypatch, scoped):
    """The same answer as the sum over postings, without a shuffle of the chunks' tokens."""
    rng = random.Random(9)
    store.commit(spark.createDataFrame([r for d in range(60) for r in rows_of(rng, f"s{d % 3}", str(d), n=6)], SCHEMA))
    snapshot = store.snapshot()
    queries = spark.createDataFrame([(q, " ".join(rng.sample(WORDS, 5))) for q in range(12)], "query_id bigint, question string")
    audience = None
    if scoped:
        audience = spark.createDataFrame([(str(d), [q for q in range(12) if (q + d) % 3]) for d in range(60)], "document_id string, audience array<bigint>")
    plain = lexical.bm25_search(lexical.build_postings(snapshot.chunks()), queries, lexical.corpus_stats(snapshot.chunks()), audience, 7)
    monkeypatch.setattr(ranked, "BROADCAST_CHUNKS", 0)
    plans = []
    top_k = ranked.top_k
    monkeypatch.setattr(ranked, "top_k", lambda df, *a, **kw: (plans.append(df), top_k(df, *a, **kw))[1])
    got = lexical.bm25_search(snapshot.stored_postings(), queries, snapshot.stats(), audience, 7)
    columns = ["query_id", "chunk_id", "document_id", "kw", "kw_rank"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))
    plan = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == int(scoped) and not any("lex#" in line for line in joins)
    assert plan.index("MapInArrow") < plan.index("lex#")  # no join sees tokens


def test_tokens_are_made_where_chunks_are_written(spark, store, monkeypatch):
    made = []
    monkeypatch.setattr(stored, "with_tokens", lambda df: (made.append(df), lexical.with_tokens(df))[1])
    store.commit(spark.createDataFrame(rows_of(random.Random(1), "s0", "0", n=6), SCHEMA))
    assert "RepartitionByExpression" in made[-1]._jdf.queryExecution().analyzed().toString()


def test_postings_are_sorted_a_range_of_tokens_at_a_time(spark, store, monkeypatch):
    """Every posting is written once, in more than one pass, and reads skip what other passes wrote."""
    monkeypatch.setattr(stored, "PASS_POSTINGS", 8)
    parts, write = [], IndexStore._write

    def seen(rows, folder, *args, **kwargs):
        if "/postings/" in folder:
            parts.append({r.token for r in rows.select("token").collect()})
        return write(rows, folder, *args, **kwargs)
    monkeypatch.setattr(IndexStore, "_write", staticmethod(seen))
    rows = [("s", str(i), f"{i}-0000", 0, text) for i, text in enumerate(["pear fig apple", "fig 7 çedilla apple", "zoo 中文字 pear", "", "apple kiwi 7 7"])]
    store.commit(spark.createDataFrame(rows, SCHEMA))
    assert len(parts) > 1
    assert sum(map(len, parts)) == len(set().union(*parts)) and all(a and b and max(a) < min(b) for a, b in zip(parts, parts[1:]))
    now = store.snapshot()
    assert kept(now) == rebuilt(now)
    postings = sorted((r.token, r.dl, r.chunk_id) for r in now.postings().collect())
    assert postings == sorted((r.token, r.dl, r.chunk_id) for r in lexical.build_postings(now.chunks()).collect())


def test_tokens_are_read_only_where_a_document_is_replaced(spark, store, monkeypatch):
    rng = random.Random(3)
    cut, written = stored.cut_lineage, []
    monkeypatch.setattr(stored, "cut_lineage", lambda df: (written.append(df.columns), cut(df))[1])
    store.commit(spark.createDataFrame(rows_of(rng, "a", "1"), SCHEMA))
    store.commit(spark.createDataFrame(rows_of(rng, "a", "2"), SCHEMA))
    assert not any("lex" in columns for columns in written)
    store.commit(spark.createDataFrame(rows_of(rng, "a", "1"), SCHEMA))
    assert any("lex" in columns for columns in written)
    assert kept(store.snapshot()) == rebuilt(store.snapshot())


def test_a_score_that_rounds_to_nothing_is_a_hit(spark, store):
    rows = [("a", str(d), f"{d}", 0, "common") for d in range(10)] + [("a", "long", "long", 0, " ".join(["common", *(f"x{i}" for i in range(400))]))]
    store.commit(spark.createDataFrame(rows, SCHEMA))
    now = store.snapshot()
    got = lexical.bm25_search(now.stored_postings(), spark.createDataFrame([(1, "common")], "query_id bigint, question string"), now.stats()).collect()
    assert len(got) == 11 and {r.chunk_id: r.kw for r in got}["long"] == 0.0


def test_bounded_search_touches_few_postings(spark, tmp_path):
    rng = random.Random(7)
    vocabulary = [f"r{i}" for i in range(3000)]
    rows = []
    for d in range(3000):
        common = [w for i, w in enumerate(WORDS[:8]) if rng.random() < 0.6 / (i + 1)]
        rows.append(("a", str(d), f"{d:05d}", 0, " ".join(common + rng.choices(vocabulary, k=rng.randrange(1, 12)))))
    store = IndexStore(spark, str(tmp_path / "index"), buckets=4)
    store.commit(spark.createDataFrame(rows, SCHEMA))
    snapshot = store.snapshot()
    index = snapshot.stored_postings()
    queries = spark.createDataFrame([(q, " ".join(WORDS[:8] + rng.sample(vocabulary, 12))) for q in range(8)], "query_id bigint, question string")
    requests = ranked._pass_requests(index, queries, snapshot.frequencies())
    answer = lexical.bm25_search(index, queries, snapshot.stats(), limit=5)
    floors = {r.query_id: r.kw for r in answer.where("kw_rank = 5").collect()}
    whole = sum(t[2] for r in requests for t in r.tokens)
    taken = ranked.first_round(requests, 5)
    terms = ranked.second_round(requests, taken, floors, index.avg_dl)
    read = ranked.matching(index.postings, taken).count() + (ranked.matching(index.postings, terms).count() if terms else 0)
    assert read < whole / 10


@pytest.mark.parametrize("by_id", [False, True])
def test_best_rows_of_a_stream(monkeypatch, by_id):
    monkeypatch.setattr(best, "HELD", 50)
    rng = random.Random(8)
    held, rows = best.Best(7, by_id), []
    for _ in range(60):
        part = [(rng.randrange(4), f"c{rng.randrange(10**6)}", "d", rng.randrange(5) / 4) for _ in range(rng.randrange(30))]
        rows += part
        held.add(*(np.array(c) for c in (zip(*part, strict=True) if part else ([], [], [], []))))
    want = []
    for q in range(4):
        mine = sorted((r for r in rows if r[0] == q), key=(lambda r: r[1]) if by_id else (lambda r: (-r[3], r[1])))
        want += mine[:7]
    assert [(int(a), str(b), str(c), float(d)) for a, b, c, d in zip(*held.rows(), strict=True)] == want
    assert len(best.Best(3).rows()[0]) == 0


def test_floor_keeps_every_row_of_the_best():
    rng = np.random.default_rng(9)
    floor, kept, scores = best.Floor(5, np.full(3, 0.25)), [], []
    for n in (2, 40, 0, 7, 60):
        part = rng.integers(0, 8, (n, 3)) / 8
        allowed = rng.random((n, 3)) < 0.8
        kept += list(np.where(floor.fits(part, allowed), part, -1))
        scores += list(np.where(allowed & (part >= 0.25), part, -1))
    for q in range(3):
        assert sorted((r[q] for r in kept), reverse=True)[:5] == sorted((r[q] for r in scores), reverse=True)[:5]
    assert sum((np.array(kept) >= 0).sum(axis=0)) < sum((np.array(scores) >= 0).sum(axis=0))
