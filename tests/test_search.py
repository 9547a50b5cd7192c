"""Search against brute force over every pair."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grantseek import common
from grantseek.functions import vectors
from grantseek.operators import chat, embedding, hybrid, lexical
from grantseek.plans import retrieval
from grantseek.sources import index

WORDS = [f"w{i}" for i in range(30)]


def corpus(seed, n=150, dim=8):
    rng, gen = random.Random(seed), np.random.default_rng(seed)
    chunks = []
    for i in range(n):
        words = ["w0"] * (rng.random() < 0.4) + rng.sample(WORDS, rng.randrange(0, 8))
        vec = None if i % 17 == 5 else embedding.unit_rows(gen.normal(size=(1, dim)))[0].tolist()
        chunks.append((f"d{i % 40}-{i:04d}", f"d{i % 40}", " ".join(words), vec))
    queries = [(q, " ".join(rng.sample(WORDS, 3) + ["w0"]), embedding.unit_rows(gen.normal(size=(1, dim)))[0].tolist()) for q in range(6)]
    scope = {q: {f"d{d}" for d in range(40) if rng.random() < 0.5} for q in range(6)}
    return chunks, queries, scope


def brute(chunks, queries, scope, top, weight, threshold, limit):
    lex = {c: list(dict.fromkeys(t.split())) for c, _d, t, _v in chunks}
    n, avg = len(chunks), sum(map(len, lex.values())) / len(chunks)
    df = {w: sum(w in t for t in lex.values()) for w in WORDS}
    out = {}
    for q, question, vec in queries:
        kw, sim = {}, {}
        for c, d, _t, v in chunks:
            if scope is not None and d not in scope[q]:
                continue
            idf = [max(math.log((n - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) for w in set(question.split()) if w in lex[c]]
            if idf:
                kw[c] = round(sum(idf) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(lex[c]) / avg)), 6)
            if v is not None:
                sim[c] = round(float(np.dot(np.array(v, dtype=np.float32).astype(float), np.array(vec, dtype=np.float32).astype(float))), 6)
        kw = dict(sorted(kw.items(), key=lambda x: (-x[1], x[0]))[:limit])
        ids = set(kw) | set(sim)
        vs, ks = {c: sim.get(c, 0.0) for c in ids}, {c: kw.get(c, 0.0) for c in ids}
        scaled = lambda m, c: 0.0 if max(m.values()) - min(m.values()) < 1e-9 else (m[c] - min(m.values())) / (max(m.values()) - min(m.values()))
        rank = sorted(((-round(weight * scaled(vs, c) + (1 - weight) * scaled(ks, c), 9), c) for c in ids))
        out[q] = [c for _s, c in rank if c in kw or vs[c] >= threshold][:top]
    return out


@pytest.mark.parametrize("seed,weight,threshold,scoped", [(1, 0.6, 0.4, False), (2, 0.6, 0.1, True), (3, 0.0, 0.0, True), (4, 1.0, -1.0, False), (5, 0.3, 0.2, True)])
def test_hybrid_equals_brute_force(spark, seed, weight, threshold, scoped):
    chunks, queries, scope = corpus(seed)
    df = lexical.with_tokens(spark.createDataFrame(chunks, "chunk_id string, document_id string, content string, embedding array<float>").repartition(5))
    q = spark.createDataFrame(queries, "query_id bigint, question string, qvec array<float>")
    audience = None
    if scoped:
        rows = [(d, [k for k in scope if d in scope[k]]) for d in {c[1] for c in chunks}]
        audience = spark.createDataFrame([r for r in rows if r[1]], "document_id string, audience array<bigint>")
    got = hybrid.hybrid_search(df, lexical.build_postings(df), q, lexical.corpus_stats(df), audience, top=10, weight=weight,
                               threshold=threshold, keyword_limit=15)
    found = {}
    for r in got.orderBy("query_id", "hybrid_rank").collect():
        found.setdefault(r["query_id"], []).append(r["chunk_id"])
    want = brute(chunks, queries, scope if scoped else None, 10, weight, threshold, 15)
    assert found == {k: v for k, v in want.items() if v}


def test_passes_do_not_change_the_answer(spark, monkeypatch):
    chunks, queries, _scope = corpus(7)
    df = lexical.with_tokens(spark.createDataFrame(chunks, "chunk_id string, document_id string, content string, embedding array<float>"))
    q = spark.createDataFrame(queries, "query_id bigint, question string, qvec array<float>")
    stats = lexical.corpus_stats(df)
    run = lambda: sorted(map(tuple, hybrid.hybrid_search(df, lexical.build_postings(df), q, stats, threshold=0.1).collect()))
    whole = run()
    split = common.split_passes
    monkeypatch.setattr(hybrid, "split_passes", lambda d, k: split(d, k, 2))
    assert len(common.split_passes(q, "query_id", 2)) == 3
    assert run() == whole


def test_models_do_not_mix(spark):
    chunks = spark.createDataFrame([("a", "d1", [1.0, 0.0], "s"), ("b", "d2", [0.0, 1.0, 0.0], "l"), ("c", "d3", [1.0, 0.0, 0.0], "l")],
                                   "chunk_id string, document_id string, embedding array<float>, model string")
    q = spark.createDataFrame([(1, [1.0, 0.0], "s"), (1, [0.0, 1.0, 0.0], "l")], "query_id bigint, qvec array<float>, model string")
    got = {r["chunk_id"]: r["score"] for r in embedding.vector_topk(chunks, q, 5).collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": 0.0}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r["u"] for r in df.select(vectors.l2_normalize(F.col("v")).alias("u")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    flat = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 0.0), (2, 10.0)], "k int, x double")
    assert sorted((r["k"], r["s"]) for r in embedding.min_max_norm(flat, "x", "k", "s").collect()) == [(1, 0.0), (1, 0.0), (2, 0.0), (2, 1.0)]


def test_hot_key_helpers(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(0).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(0, "hot"), (3, "x"), (5000, "none")], "k bigint, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(str, common.spread_join(big, small, ["k"], by="v", how=how).collect()))
        assert a == sorted(map(str, big.join(small, "k", how).collect()))
    one = common.top_k(big, ["k"], [F.desc("v")], 2)
    two = common.top_k(big, ["k"], [F.desc("v")], 2, salts=8)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_bucketed_postings_sum_without_a_shuffle(spark):
    chunks, queries, _scope = corpus(9)
    df = lexical.with_tokens(spark.createDataFrame(chunks, "chunk_id string, document_id string, content string, embedding array<float>"))
    index.save_bucketed(df, "chunks_by_document", buckets=4)
    try:
        stats = lexical.corpus_stats(df)
        q = spark.createDataFrame(queries, "query_id bigint, question string, qvec array<float>")
        got = lexical.bm25_search(lexical.build_postings(spark.table("chunks_by_document")), q, stats)
        plain = lexical.bm25_search(lexical.build_postings(df), q, stats)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not any("hashpartitioning(" in line and "document_id" in line for line in plan.splitlines())
    finally:
        spark.sql("DROP TABLE chunks_by_document")


def test_final_rank_orders_by_similarity(spark):
    rows = [(1, f"c{i}", s, i) for i, s in enumerate([0.5, 0.9, 0.39, 0.9, 0.4], start=1)]
    hits = spark.createDataFrame(rows, "query_id bigint, chunk_id string, similarity double, hybrid_rank int")
    ranked = [(r["index"], r["chunk_id"]) for r in hybrid.final_rank(hits, 3).orderBy("index").collect()]
    assert ranked == [(1, "c2"), (2, "c4"), (3, "c1")]
    assert hybrid.final_rank(hits, 10, None).count() == 5


def test_dedupe_keeps_unnamed_rows(spark):
    hits = spark.createDataFrame([(1, "a", 2), (1, "a", 1), (1, None, 3), (1, "", 4), (1, None, 5)], "query_id bigint, chunk_id string, hybrid_rank int")
    assert sorted(r["hybrid_rank"] for r in hybrid.dedupe_hits(hits).collect()) == [1, 3, 4, 5]


def cited(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, index int, document_name string, kb_name string, content string")


def test_context_block(spark):
    requests = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    rows = [(1, 1, "A.md", "KB", " first "), (1, 2, "", None, "second"), (1, 3, "C", "KB", "  ")]
    out = {r["query_id"]: r["context"] for r in chat.context_block(cited(spark, rows), requests).collect()}
    assert out[1] == "[1] 来源：A.md（KB）\nfirst\n\n---\n\n[2] 来源：未命名文档\nsecond"
    assert out[2] == "（本轮没有检索到任何可用片段）"
    cut = {r["query_id"]: r["context"] for r in chat.context_block(cited(spark, rows), requests, budget=7).collect()}
    assert cut[1].endswith("未命名文档\nse")
    exact = {r["query_id"]: r["context"] for r in chat.context_block(cited(spark, rows), requests, budget=5).collect()}
    assert exact[1] == "[1] 来源：A.md（KB）\nfirst"


def test_prompt_messages(spark):
    requests = spark.createDataFrame([(1, "问题", 9), (2, "", 8)], "query_id bigint, question string, session_id bigint")
    contexts = spark.createDataFrame([(1, "CTX")], "query_id bigint, context string")
    messages = spark.createDataFrame([(i, 9, "user" if i % 2 else "system", f" m{i} " if i != 4 else " ") for i in range(1, 20)], "message_id bigint, session_id bigint, role string, content string")
    history = chat.history_window(messages, rounds=2)
    files = spark.createDataFrame([(2, 1, "file", "a.txt", "x" * 9000), (2, 2, "image", "i.png", None)], "query_id bigint, seq int, type string, name string, text string")
    images = spark.createDataFrame([(2, 1, "data:1")], "query_id bigint, seq int, uri string")
    rows = {r["query_id"]: r for r in chat.prompt_messages(requests, contexts, history, files, images, system="SYS", attachment_note="NOTE").collect()}
    assert [(m["role"], m["content"]) for m in rows[1]["messages"]] == [
        ("system", "SYS"), ("assistant", "m16"), ("user", "m17"), ("assistant", "m18"), ("user", "m19"),
        ("user", "【参考片段】\nCTX\n\n【用户问题】\n问题")]
    last = rows[2]["messages"][-1]["content"]
    assert rows[2]["messages"][0]["content"] == "SYS\nNOTE"
    assert last.startswith("【用户附加内容】\n[附件] a.txt\n" + "x" * 8000 + "\n\n【参考片段】") and chat.IMAGE_NOTE in last
    seen = chat.prompt_messages(requests, contexts, images=images, supports_vision=True).where("query_id = 2").first()
    assert seen["image_uris"] == ["data:1"] and chat.IMAGE_NOTE not in seen["messages"][-1]["content"]


def test_history_counts_empty_messages_before_dropping_them(spark):
    rows = [(i, 1, "user", "" if i > 2 else f"m{i}") for i in range(1, 5)]
    messages = spark.createDataFrame(rows, "message_id bigint, session_id bigint, role string, content string")
    assert chat.history_window(messages, rounds=1).count() == 0


def test_two_users_see_different_answers(spark):
    """A public and a confidential document, two users, one question."""
    make = embedding.hashing_encoder()
    texts = {"pub": "travel refund rules for all staff", "sec": "travel refund rules secret budget"}
    rows = [(f"{d}-0000", d, t, embedding.unit_rows(make([t]))[0].tolist()) for d, t in texts.items()]
    chunks = lexical.with_tokens(spark.createDataFrame(rows, "chunk_id string, document_id string, content string, embedding array<float>"))
    from tests.test_permissions import catalogue
    cat = catalogue(spark, [(1, "a", "user", [], True), (2, "b", "user", ["hr"], True), (3, "c", "user", [], True)], [(1, "ds1", "KB", True)],
                    [(1, 1, True, False, False), (2, 1, True, False, False)], [],
                    [("pub", 1, None, "public", "Pub"), ("sec", 1, None, "restricted", "Sec")], [(1, 1, "tag", "hr", "sec", None, None, "allow")])
    vec = embedding.unit_rows(make(["travel refund rules"]))[0].tolist()
    requests = spark.createDataFrame([(u, u, "travel refund rules", vec) for u in (1, 2, 3)] + [(4, 1, " ", vec)], "query_id bigint, user_id bigint, question string, qvec array<float>")
    answer = retrieval.retrieval_preview(requests, cat, chunks, lexical.build_postings(chunks), lexical.corpus_stats(chunks))
    rows = {r["query_id"]: r for r in answer.collect()}
    assert [c["document_name"] for c in rows[1]["citations"]] == ["Pub"]
    assert {c["document_name"] for c in rows[2]["citations"]} == {"Pub", "Sec"}
    assert rows[3]["reason"] == retrieval.NO_KB and rows[3]["citations"] is None
    assert rows[4]["reason"] == retrieval.NO_QUESTION


def test_answers_longer_than_a_task_holds(spark, monkeypatch):
    """Rows beyond ``WIDE`` are sent on as they come; the answer is the same."""
    rng = np.random.default_rng(3)
    chunks = spark.createDataFrame([(f"c{i}", f"d{i}", rng.normal(size=4).tolist()) for i in range(90)], "chunk_id string, document_id string, embedding array<double>")
    asked = spark.createDataFrame([(q, rng.normal(size=4).tolist()) for q in range(3)], "query_id long, qvec array<double>")
    rows = lambda k: sorted(tuple(r) for r in embedding.vector_topk(chunks, asked, k).collect())
    want = {k: rows(k) for k in (7, 90)}
    monkeypatch.setattr(embedding, "WIDE", 20)
    assert rows(7) == want[7]
    monkeypatch.setattr(embedding, "WIDE", 2)
    assert rows(7) == want[7] and rows(90) == want[90] and len(want[90]) == 270
