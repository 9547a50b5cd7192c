"""Operator 12: the transform against plain convolution, runs against every period at every place."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grantseek.llm import periodic, queries
from tests.llm.helpers import documents, hostile


def brute(words):
    """Every run (start, length, period) by comparing words at every distance."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j + q), q)  # periods ascend: the first is the smallest
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(words):
    runs = brute(words)
    keep = [True] * len(words)
    for s, n, q in runs:
        keep[s + q: s + n] = [False] * (n - q)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for w, k in zip(words, keep, strict=True) if k).encode()).hexdigest())


def runs_of(texts):
    number, codes = {}, []
    for words in texts:
        codes += [number.setdefault(w, len(number) + 1) for w in words]
    out = [[] for _ in texts]
    for t, s, n, q in periodic.find_runs(np.array(codes, np.int64), np.cumsum([0, *map(len, texts)])).tolist():
        out[t].append((s, n, q))
    return out


def test_transform_is_a_convolution():
    rng = np.random.default_rng(3)
    for size in (2, 8, 64, 1024):
        a, b = rng.integers(0, periodic.PRIME, (2, 3, size)).astype(np.uint64)
        assert (periodic.inverse_transform(periodic.transform(a)) == a).all()
        got = periodic.inverse_transform(periodic.transform(a) * periodic.transform(b) % np.uint64(periodic.PRIME))
        if size <= 64:
            want = [[sum(int(x[i]) * int(y[(k - i) % size]) for i in range(size)) % periodic.PRIME for k in range(size)] for x, y in zip(a, b, strict=True)]
            assert got.tolist() == want


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=4))
def test_runs_of_few_different_words(texts):
    assert runs_of(texts) == [brute(words) for words in texts]


@pytest.mark.parametrize("seed", range(60))
def test_planted_periods(seed):
    rnd = random.Random(seed)
    texts = []
    for _ in range(6):
        words = [rnd.randrange(1 << 20) if rnd.random() < 0.7 else rnd.randrange(4) for _ in range(rnd.randrange(20, 400))]
        for _ in range(rnd.randrange(3)):
            root = [rnd.randrange(rnd.choice([2, 1000])) for _ in range(rnd.randrange(1, 60))]
            at, n = rnd.randrange(len(words)), rnd.randrange(1, 200)
            words[at: at + n // 3] = (root * n)[:n]
        texts.append(words)
    assert runs_of(texts) == [brute(words) for words in texts]


def test_every_short_text_over_two_words():
    texts = [[k >> b & 1 for b in range(14)] for k in range(1 << 14)]
    assert runs_of(texts) == [brute(words) for words in texts]


def test_equal_neighbouring_texts_are_not_one():
    text = list(range(20))
    assert runs_of([text, text, text, text]) == [[], [], [], []]


def test_long_texts_of_one_period():
    for period, n in ((1, 300_000), (7, 200_001), (4099, 150_000), (70_000, 140_000)):
        words = list(range(period)) * (n // period + 1)
        assert runs_of([words[:n]]) == [[(0, n, period)]]


def test_digests_of_hostile_rows(spark):
    rows = [(20 + k, " ".join(random.Random(k).choice("ab") for _ in range(k * 3))) for k in range(30)]
    docs = hostile(spark).unionByName(documents(spark, rows)).repartition(3)
    want = sorted(str((r.doc_id, *expected([w.decode() for w in (r.text or "").encode().split()]))) for r in docs.collect())
    got = periodic.run_digests(docs).collect()
    assert sorted(str((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)) for r in got) == want
    full = {r.doc_id: r for r in periodic.periodic_runs(docs.where("doc_id >= 20")).collect()}
    for r in got:
        if r.doc_id in full:
            f = full[r.doc_id]
            assert len(f.runs) == r.n_runs and hashlib.sha256(f.collapsed.encode()).hexdigest() == r.collapsed_sha256
    assert periodic.run_digests(docs.limit(0)).count() == 0


def test_one_hash_for_all_words(monkeypatch):
    monkeypatch.setattr(periodic, "mix", np.zeros_like)
    rnd = random.Random(2)
    texts = [[rnd.randrange(2) for _ in range(60)] + [5, 6, 7] * 9 + [rnd.randrange(50) for _ in range(30)] for _ in range(5)]
    assert runs_of(texts) == [brute(words) for words in texts]


def test_the_query_plants_what_it_says(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(k, " ".join(f"w{rnd.randrange(3 + k % 50)}" for _ in range(k % 90))) for k in range(300)] + [(None, "a " * 40), (300, None), (301, " \n")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, str(tmp_path)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
    for doc_id, text in rows:
        words = (text or "").split()
        assert got[doc_id] == expected(planted(doc_id, words) if doc_id is not None else words), doc_id
    assert sum(v[0] > 0 for v in got.values()) > 10


def test_one_text_of_30_mb():
    text = ("one two three four five six seven eight nine ten eleven " * 550_000).encode()
    assert len(text) > 30_000_000
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text.decode()])], ["id", "text"])
    (name, words, runs), = periodic._texts(iter([batch]))
    assert runs.tolist() == [[0, len(words), 11]]
