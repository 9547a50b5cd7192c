"""Operator 1 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grantseek.llm import neighbours


def brute(ids, vectors, k, every):
    out = {}
    for q in ids[ids % every == 0]:
        far = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        keep = ids != q
        order = np.lexsort((ids[keep], far[keep]))[:k]
        out[int(q)] = [(int(i), float(d)) for i, d in zip(ids[keep][order], far[keep][order], strict=True)]
    return out


@pytest.mark.parametrize("block", [8192, 64])
def test_recall(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    plain = rows.collect()
    want = brute(np.array([r.vec_id for r in plain]), np.array([r.embedding for r in plain], float), 10, 20)
    got = {}
    for r in neighbours.nearest(rows, every=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(got[q]) == 10 for q in want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    exact = {(q, i): d for q in want for i, d in want[q]}
    assert all(abs(exact[q, i] - d) < 1e-12 for q in got for i, d in got[q] if (q, i) in exact)


def test_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(0, 40)] + [(100, [1.0, 2.0, 3.0, 5.0]), (100, [1.0, 2.0, 3.0, 5.0])]
    rows += [(200, None), (300, []), (400, [0.0] * 4), (500, [1.0, None, 1.0, 1.0]), (600, [1.0, float("nan"), 1.0, 1.0]), (700, [float("inf")] * 4), (800, [1.0, 2.0]), (None, [1.0] * 4)]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, id double")
    got = neighbours.nearest(table).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got if r.query_id == 0] == [(0, k, k, 0.0) for k in range(1, 11)]
    assert [(r.vec_id, r.score) for r in got if r.query_id == 100] == [(k, 1.0) for k in range(10)]
    assert {r.query_id for r in got} == {0, 100}
    assert neighbours.nearest(table.limit(0)).count() == 0
    few = neighbours.nearest(table.where(F.col("vec_id").isin(0, 1, 2))).collect()
    assert [(r.query_id, r.vec_id) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1), (0, 2)]


def test_chi_square():
    assert neighbours.chi_square_quantile(0.95, 2) == pytest.approx(5.991464547, abs=1e-6)
    assert neighbours.chi_square_quantile(0.95, 10) == pytest.approx(18.307038053, abs=1e-6)
