"""Operator 7 against plain versions of its two rules."""

import random
import re
from fractions import Fraction

from pyspark.sql import functions as F

from grantseek.llm import mixing
from tests.llm.helpers import documents, hostile


def plain_targets(sizes):
    """Share by weight; what lies above twice a size is shared again among the others until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    whole, full = Fraction(3, 2) * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = whole - sum(2 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if share[s] > 2 * sizes[s]}
        if not above:
            return {s: float(share.get(s, 2 * sizes[s])) for s in names}
        full |= above


def corpus(spark, seed=1, docs=600):
    rnd = random.Random(seed)
    rows = []
    for i in range(docs):
        source = rnd.choice(["a", "a", "a", "b", "é", "Z", None, "tiny"] if i % 50 == 0 else ["a", "a", "a", "b", "é", "Z", None])
        rows.append((i, " ".join("w" for _ in range(rnd.choice([0, 1, 5, 40, 200]))), None, source))
    return documents(spark, rows)


def test_targets_and_taken(spark):
    docs = corpus(spark)
    rows = mixing.mix_sources(docs).collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = plain_targets(sizes)
    taken = {}
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r["size"]
        assert r.taken == r.copies * r["size"] + sum(s["to"] - s["from"] for s in r.spans)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= max(2, 0.02 * want[s]) for s in sizes)


def test_same_mix_whatever_the_partitions(spark):
    docs = corpus(spark)
    one = {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect()}
    assert one == {r.doc_id: r.taken for r in mixing.mix_sources(docs.repartition(5, "doc_id")).collect()}
    assert one != {r.doc_id: r.taken for r in mixing.mix_sources(docs, seed=9).collect()}


def test_seats_go_to_the_highest_quotients(spark):
    rnd = random.Random(4)
    votes = [(g, k, float(rnd.choice([0, 1, 1, 7, 50, 333, 1000]))) for g in range(6) for k in range(rnd.randrange(1, 9))]
    seats = {g: rnd.randrange(0, 60) for g in range(6)}
    rows = spark.createDataFrame([(g, k, v, seats[g]) for g, k, v in votes], "g int, k int, votes double, seats long")
    got = {(r.g, r.k): r.seats for r in mixing.apportion(rows.withColumnRenamed("seats", "q"), ["g"], "k", "votes", "q").collect()}
    for g in range(6):
        mine = {k: v for h, k, v in votes if h == g}
        won = dict.fromkeys(mine, 0)
        if sum(mine.values()):
            for _ in range(seats[g]):
                best = min(mine, key=lambda k: (-mine[k] / (2 * won[k] + 1), k))
                won[best] += 1
        assert {k: got[g, k] for k in mine} == won


def test_mixed_texts_are_the_words_taken(spark):
    docs = corpus(spark, seed=2, docs=150)
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect()}
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    words = {}
    for r in got.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert words == {i: n for i, n in taken.items() if n}


def test_mixing_bears_anything(spark):
    docs = hostile(spark)
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == 13 and all(r.taken <= 2 * r["size"] for r in rows)
    assert {r.doc_id: r["size"] for r in rows if r.doc_id in (1, 2, 3, 5)} == {1: 0, 2: 0, 3: 0, 5: 2}
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    blank = docs.withColumn("text", F.lit(None).cast("string"))
    assert {(r["size"], r.taken, r.target) for r in mixing.mix_sources(blank).collect()} == {(0, 0, 0.0)}
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_rows_without_or_with_the_same_id_are_mixed_by_row(spark):
    text = [" ".join(f"{name}{i}" for i in range(n)) for name, n in (("a", 900), ("b", 700), ("c", 400), ("d", 300))]
    rows = [(None, text[0], None, "s"), (None, text[1], None, "t"), (7, text[2], None, "s"), (7, text[2], None, "s"), (7, text[3], None, "t"), (8, text[1], None, None)]
    rows += [(None, f"only {i} of these", None, "u") for i in range(40)]
    for docs in (documents(spark, rows), hostile(spark).withColumn("source", F.when(F.col("doc_id") == 9, "z"))):
        taken, sizes, got, seen = {}, {}, {}, {}
        for r in mixing.mix_sources(docs).collect():
            taken[r.source] = taken.get(r.source, 0) + r.taken
        for r in docs.collect():
            for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or ""):
                sizes[r.source, r.doc_id, w] = sizes.get((r.source, r.doc_id, w), 0) + 1
        for r in mixing.mixed_documents(docs).collect():
            for w in re.findall(r"[^\x20\x09-\x0D]+", r.text):
                got[r.source] = got.get(r.source, 0) + 1
                seen[r.source, r.doc_id, w] = seen.get((r.source, r.doc_id, w), 0) + 1
        assert got == {s: n for s, n in taken.items() if n}
        assert all(n <= 2 * sizes[k] for k, n in seen.items())
        assert any(i is None for _, i, _ in seen)
