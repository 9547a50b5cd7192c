"""Operators 3, 6 and 8 against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from grantseek.llm import exact_dedup, mixing, ngram_join, repeats
from grantseek.llm.bitmap import Bitmap
from grantseek.llm.graph import components
from grantseek.llm.scratch import Scratch
from tests.llm.helpers import documents, hostile

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i: i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, percent, k):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed, groups=4, copies=14):
    """Groups around a base at all distances, so that copies link with the base, with each other or with nobody."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(900)]
    rows, at = [], 0
    for g in range(groups):
        base = [rnd.choice(vocabulary) for _ in range((12, 40, 150, 420)[g % 4])]
        edits = [rnd.choice(vocabulary) for _ in range(6)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5, 9])):
                p = rnd.randrange(len(w))
                w[p: p + 1] = rnd.choice([[], [rnd.choice(edits)], [rnd.choice(vocabulary)], [w[p], rnd.choice(edits)]])
            rows.append((at, " ".join(w)))
            at += rnd.randrange(1, 4)
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("percent", "k", "seed"), [(90, 3, 1), (80, 5, 2), (80, 1, 3)])
def test_components_are_exact(spark, percent, k, seed):
    rows = near_copies(seed)
    got = ngram_join.jaccard_components(documents(spark, rows), percent, k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, percent, k)


@pytest.mark.parametrize(("percent", "k", "seed", "block"), [(90, 3, 4, 256), (80, 5, 5, 4), (80, 1, 6, 3)])
def test_all_links_are_counted(spark, monkeypatch, percent, k, seed, block):
    """Links between two sets that both link with their pivot too, over several blocks; copies of a set are one."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = near_copies(seed, copies=20)
    rows += [(10 ** 6 + i, t) for i, (_, t) in enumerate(rows[:9])] + rows[:3]
    sets = {i: frozenset(shingles(t, k)) for i, t in rows}
    other = {s: sum(100 * len(s & o) >= percent * len(s | o) for o in set(sets.values()) if o != s) for s in set(sets.values())}
    assert max(other.values()) > 5
    got = ngram_join.jaccard_components(documents(spark, rows), percent, k).collect()
    assert {r.doc_id: r.links for r in got} == {i: other[s] if s else 0 for i, s in sets.items()}


def test_every_link_shares_a_key():
    """Pigeonhole: sets that link always meet, in exact and in deep plans."""
    rng = np.random.default_rng(5)
    for percent, corpus in ((90, 10), (80, 10 ** 9), (50, 10 ** 6)):
        plan = ngram_join.Plan(percent, corpus, 400)
        for _ in range(300):
            x = rng.integers(1, 1 << 62, rng.integers(1, 120), dtype=np.uint64)
            y = np.concatenate([rng.permutation(x)[: max(1, len(x) - rng.integers(0, 8))], rng.integers(1, 1 << 62, rng.integers(0, 6), dtype=np.uint64)])
            x, y = np.unique(x), np.unique(y)
            both = len(np.intersect1d(x, y))
            if 100 * both >= percent * (len(x) + len(y) - both) and not np.array_equal(x, y):
                doc = np.repeat([0, 1], [len(x), len(y)])
                row, key = plan.keys(doc, np.array([len(x), len(y)]), np.concatenate([x, y]))
                assert np.intersect1d(key[row == 0], key[row == 1]).size


def test_sets_that_share_a_passage_move_no_shingles(spark, monkeypatch):
    """Sets that meet a pivot for a passage leave the group before their shingles are shuffled; what links among them is still found."""
    rnd = random.Random(7)

    def text(n):
        return " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = text(150)
    rows = [(i, f"{text(150)} {passage} {text(150)}") for i in range(1, 25)]
    rows += [(100 + i, rows[5][1] + " " + text(3 * i)) for i in range(4)]
    moved = []

    def write(self, df, *args, plain=Scratch.write):
        out = plain(self, df, *args)
        if {"t", "often"} <= set(df.columns):
            moved.append({r.id for r in out.select("id").distinct().collect()})
        return out
    monkeypatch.setattr(ngram_join.Scratch, "write", write)
    got = ngram_join.jaccard_components(documents(spark, rows), 80, 5, count_links=False).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 80, 5)
    assert {r.component_id for r in got if r.doc_id >= 100} == {6}
    assert moved and moved[0] <= {6, 100, 101, 102, 103}


def test_sets_that_share_a_passage_meet_no_pivot(spark, monkeypatch):
    """Texts with more words of their own than a link allows leave before pairs are made, whichever of them would be the pivot."""
    rnd = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(120))
    rows = [(i, passage + "".join(f" own{i}w{j}" for j in range(60))) for i in range(40)]
    base = [f"near{j}" for j in range(60)]
    for i in range(40, 46):
        base[rnd.randrange(60)] = f"edit{i}"
        rows.append((i, passage + " " + " ".join(base)))
    moved, before = [], ngram_join.star_deltas

    def spy(pairs, *args):
        moved.extend(i for row in pairs.collect() for i in row)
        return before(pairs, *args)
    monkeypatch.setattr(ngram_join, "star_deltas", spy)
    found = {r[0]: (r[1], r[2]) for r in ngram_join.jaccard_components(documents(spark, rows), 90, 3).select("doc_id", "n_shingles", "component_id").collect()}
    assert found == brute_components(rows, 90, 3)
    assert moved and min(moved) >= 40


def test_join_bears_anything(spark):
    docs = hostile(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    got = ngram_join.jaccard_components(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 90, 3)
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0
    left = ngram_join.drop_near_duplicates(docs, 80, 5)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["-11", "1", "2", "3", "4", "5", "8", "10", "None"])


def test_near_copies_are_dropped_by_row(spark):
    words = [f"word{i}" for i in range(60)]
    t, near, u, v = " ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"u{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = [(3, t), (7, t), (7, u), (None, near), (None, v), (None, v), (9, u + " end"), (5, "a b"), (5, "a b"), (5, None), (6, None), (2, near)]
    left = ngram_join.drop_near_duplicates(documents(spark, rows).repartition(3), 80, 5)
    want = [(2, near), (7, u), (None, v), (5, "a b"), (5, None), (6, None)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, want))


def test_stages_bear_any_column_name(spark):
    rows = spark.createDataFrame([(1, "a b c", "s", 1, 2, 3, 4, 5, 6), (2, "a b c", "s", 1, 2, 3, 4, 5, 6), (3, "x y z", "s", 1, 2, 3, 4, 5, 6)],
                                 "doc_id long, text string, source string, `a.b` int, node int, hash int, __hash int, `q``r` int, row int")
    for stage in (exact_dedup.drop_exact_duplicates, lambda d: ngram_join.drop_near_duplicates(d, 80, 5), mixing.mixed_documents):
        out = stage(rows)
        assert out.columns == rows.columns and {tuple(r)[3:] for r in out.collect()} == {(1, 2, 3, 4, 5, 6)}


def test_star_rounds_find_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000 + rnd.randrange(40), 1000 + rnd.randrange(40)) for _ in range(30)] + [(7, 7)]
    parent = {}
    for a, b in edges:
        if a != b:
            parent.setdefault(a, a), parent.setdefault(b, b)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()
    assert {r.node: r.component for r in got} == {i: root(i) for i in parent} and len(got) == len(parent)


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p: p + length]
            if s in seen:
                gone[p: p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for p in range(len(raw)) if gone[p] and not (p and gone[p - 1]))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("length", "gram", "seed"), [(100, 32, 1), (20, 8, 2), (6, 6, 3)])
def test_repeats_are_exact(spark, length, gram, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 7))) for _ in range(60)]
    passages = [" ".join(rnd.choice(words) for _ in range(n)) for n in (12, 25, 40, 90)]
    rows = [(i * 3, " ".join(rnd.choice([rnd.choice(words), rnd.choice(passages)]) if rnd.random() < 0.2 else rnd.choice(words)
                             for _ in range(rnd.randrange(0, 120)))) for i in range(40)]
    rows += [(500, "ab" * 400), (501, "x" + "ab" * 300), (502, "a" * 500), (503, rows[7][1]), (504, rows[7][1] + "!"), (505, None), (506, ""), (507, "é" * 99)]
    got = repeats.remove_repeats(documents(spark, rows), length, gram).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(rows, length)
    assert all(sum(s.high - s.low for s in r.spans) == r.n_removed for r in got)


def test_texts_are_hashed_in_small_parts(monkeypatch):
    """What is made of the texts at once stays small, and no anchor is lost by the cuts."""
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(9000)) for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array(texts)], ["id", "text"])
    sizes = []

    class Measured(repeats.SpanHash):
        def __init__(self, data, *args, **named):
            sizes.append(len(data))
            super().__init__(data, *args, **named)
    monkeypatch.setattr(repeats, "SpanHash", Measured)

    def found():
        return sorted((g, n) for b in repeats._grams(100, 32)(iter([batch])) for g, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    parts = found()
    assert len(sizes) > 1 and max(sizes) <= 1 << 18
    monkeypatch.setattr(repeats, "PART", 1 << 30)
    assert dict(parts).keys() == dict(found()).keys()


def test_copies_in_a_batch_are_those_after_the_first():
    rng = np.random.default_rng(1)
    core, hull, doc, at = (rng.integers(0, top, 400) for top in (6, 3, 9, 5))
    got = repeats._copies(core.astype(np.uint64), hull.astype(np.uint64), doc, at)
    rows, kept = list(zip(core.tolist(), hull.tolist(), doc.tolist(), at.tolist(), strict=True)), got.tolist()
    first = {}
    for c, h, d, a in rows:
        first[c, h] = min(first.get((c, h), (d, a)), (d, a))
    assert all(not k for (c, h, d, a), k in zip(rows, kept, strict=True) if (d, a) == first[c, h])
    assert {(r, k) for r, k in zip(rows, kept, strict=True) if not k} >= {((c, h, *place), False) for (c, h), place in first.items()}
    for (c, h, d, a), k in zip(rows, kept, strict=True):  # every other place is marked at least once
        if (d, a) != first[c, h]:
            assert any(k2 for r2, k2 in zip(rows, kept, strict=True) if r2 == (c, h, d, a))
    assert not len(repeats._copies(*(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))))


def test_repeats_bear_anything(spark):
    docs = hostile(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    got = repeats.remove_repeats(docs).collect()
    assert len(got) == 13
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id is not None} == brute_repeats(set(rows), 100)
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_exact_groups(spark):
    docs = hostile(spark)
    got = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(docs).collect())
    groups = {}
    for r in docs.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), []).append(r.doc_id)
    want = sorted((str(i), min((d for d in ids if d is not None), default=None), len(ids), i is not None and i == min(d for d in ids if d is not None),
                   hashlib.sha256(body.encode()).hexdigest()) for body, ids in groups.items() for i in ids)
    assert got == want
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["-11", "1", "3", "4", "5", "7", "8", "9", "10", "None"])


def test_exact_copies_go_by_row(spark):
    docs = documents(spark, [(1, "a copy"), (2, "a  copy"), (2, "a text of its own"), (2, "a text of its own", None, "s"), (3, "three"), (3, "three"), (3, "other"),
                             (None, "none"), (None, "none"), (None, "three"), (None, "alone"), (None, None), (9, "")])
    want = [(1, "a copy"), (2, "a text of its own"), (3, "other"), (3, "three"), (9, ""), (None, "alone"), (None, "none")]
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.dtypes == docs.dtypes
    got = left.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1])) == want
    assert sorted(map(str, got)) == sorted(map(str, exact_dedup.drop_exact_duplicates(docs.repartition(7)).collect()))
    assert exact_dedup.drop_exact_duplicates(docs.limit(0)).count() == 0


def test_exact_groups_need_no_python(spark):
    plan = exact_dedup.exact_duplicates(hostile(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_bitmap_lets_few_others_through(spark):
    rng = np.random.default_rng(7)
    members, others = rng.integers(0, 2 ** 64, 400, np.uint64), rng.integers(0, 2 ** 64, 20000, np.uint64)
    held = Bitmap(spark.createDataFrame([(int(h),) for h in members.view(np.int64)], "h long"), bits=14)
    assert held.hits(members).all()
    assert held.hits(others).mean() < 0.01  # 2.4 % with one bit a member
    held.close()
