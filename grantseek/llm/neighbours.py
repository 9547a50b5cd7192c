"""Approximate nearest neighbours: low-dimensional stable projections indexed by kd-tree, with a chi-square stopping test.

Vectors are projected to ``DIMS`` dimensions by a Gaussian (2-stable) matrix: the squared projected distance of two vectors over
their squared true distance follows chi-square with ``DIMS`` degrees of freedom. A kd-tree over the projections hands out
neighbours by growing projected distance; each is verified by its true distance. The search stops at projected distance r once
``chi2(r^2 / d_k^2) >= confidence``, d_k being the k-th best true distance so far: a nearer vector would
have shown up by now with that probability.

The upper levels of the tree are fitted on a bounded sample and cut the table into cells, whose boxes (at most
``CELLS``) go to the driver; the rows of a cell fall into blocks of about ``BLOCK``, however many vectors are alike, and
every block has the lower levels of its own. A query visits its nearest cells first; what it finds there says, by the same test, which other
cells it has to visit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantseek.common import top_k
from grantseek.llm.scratch import Scratch

DIMS = 12
CONFIDENCE = 0.97
CELLS = 1024
SAMPLE = 50_000  # projections that the upper levels of the tree are fitted on
BLOCK = 8192
LEAF = 32
FIRST = 4  # cells that a query visits first
QUERIES = 2048  # of one cell that are answered together


def chi_square_quantile(p: float, dims: int) -> float:
    """Of even ``dims``, by bisection: P(X <= x) = 1 - exp(-x / 2) * sum of (x / 2)^i / i! for i < dims / 2."""
    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - np.exp(-x / 2) * total
    low, high = 0.0, 50.0 * dims
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def _split(points: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """Leaves of a kd-tree: halves at the median of the widest dimension, down to ``size`` rows. Alike points are not split."""
    todo, leaves = [rows], []
    while todo:
        rows = todo.pop()
        spread = np.ptp(points[rows], axis=0) if len(rows) else np.zeros(1)
        if len(rows) <= size or not spread.any():
            leaves.append(rows)
            continue
        order = rows[np.argsort(points[rows, int(spread.argmax())], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2:]]
    return leaves


class Tree:
    """Leaves with their boxes; ``nearest`` hands them out by growing projected distance."""

    def __init__(self, points: np.ndarray, size: int = LEAF):
        leaves = _split(points, np.arange(len(points)), size)
        self.leaves = leaves
        self.low = np.array([points[x].min(axis=0) for x in leaves])
        self.high = np.array([points[x].max(axis=0) for x in leaves])


def _box_gap(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for j in range(low.shape[1]):
        p = points[:, j: j + 1]
        out += np.maximum(np.maximum(low[:, j] - p, p - high[:, j]), 0) ** 2
    return out


def _distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - query) ** 2).sum(axis=1))


def search_block(ids: np.ndarray, vectors: np.ndarray, points: np.ndarray, queries: list[tuple[int, np.ndarray, np.ndarray, float]],
                 k: int, limit: float) -> Iterator[tuple[int, int, float]]:
    """(query, id, distance): up to k of each query (id, vector, projection, k-th distance known so far)."""
    tree = Tree(points)
    for qid, vector, point, best in queries:
        gap = _box_gap(point[None], tree.low, tree.high)[0]
        found_ids, found = np.zeros(0, np.int64), np.zeros(0)
        for leaf in np.argsort(gap, kind="stable"):
            if gap[leaf] > limit * best * best:
                break  # the stopping test holds for this box and all that follow
            rows = tree.leaves[leaf]
            rows = rows[ids[rows] != qid]
            if not len(rows):
                continue
            near = ((points[rows] - point) ** 2).sum(axis=1) <= limit * best * best
            rows = rows[near]
            found_ids, found = np.concatenate([found_ids, ids[rows]]), np.concatenate([found, _distances(vectors[rows], vector)])
            if len(found) > k:
                order = np.lexsort((found_ids, found))[:k]
                found_ids, found = found_ids[order], found[order]
            if len(found) >= k:
                best = min(best, float(found.max()))
        for i in np.lexsort((found_ids, found)):
            yield qid, int(found_ids[i]), float(found[i])


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v as doubles) of rows with an id and a vector that is neither null, empty nor zero and has finite components only."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def nearest(rows: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS,
            confidence: float = CONFIDENCE, seed: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row whose id is divisible by ``every``.

    score is the Euclidean distance of the original vectors in double precision; ties go to the smaller id. A row is not
    its own neighbour; an id on several rows is one vector (the first in the order of its components). Rows whose vector is null, zero
    or has a null or non-finite component take no part, nor do vectors of another length than the most frequent one (ties: the longer).
    With fewer than k candidates all are returned; an empty table gives no rows. Other columns are not read.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    valid = usable(rows, id_col, vector_col)
    sizes = valid.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    width = sizes[0]["n"]
    matrix = np.random.default_rng(seed).standard_normal((width, dims))
    limit = chi_square_quantile(confidence, dims)

    def project(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            v = np.array(part["v"].tolist()).reshape(-1, width)
            # row by row, so that alike vectors have alike projections whatever their batch
            yield pd.DataFrame({"id": part["id"], "v": part["v"], "p": [x @ matrix for x in v]})
    one = valid.where(F.size("v") == width).groupBy("id").agg(F.min("v").alias("v"))
    projected = scratch.write(one.mapInPandas(project, "id long, v array<double>, p array<double>"))
    total = projected.count()

    sample = projected.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("p").toPandas()
    fitted = np.array(sample["p"].tolist()).reshape(-1, dims)
    cells = int(min(CELLS, max(1, 2 ** np.floor(np.log2(max(1, total / BLOCK))))))
    cuts = _cuts(fitted, cells)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(cell=_cell(np.array(part["p"].tolist()).reshape(-1, dims), cuts))
    placed = projected.mapInPandas(place, "id long, v array<double>, p array<double>, cell int")
    counts = scratch.write(placed.groupBy("cell").agg(
        F.count("*").alias("n"), *[F.min(F.col("p")[i]).alias(f"low{i}") for i in range(dims)], *[F.max(F.col("p")[i]).alias(f"high{i}") for i in range(dims)]))
    boxes = counts.toPandas().sort_values("cell")  # at most CELLS rows
    low, high = (boxes[[f"{side}{i}" for i in range(dims)]].to_numpy() for side in ("low", "high"))
    names, blocks = boxes["cell"].to_numpy(), -(-boxes["n"].to_numpy() // BLOCK)
    many = F.broadcast(spark.createDataFrame(pd.DataFrame({"cell": names, "blocks": blocks})))
    table = scratch.write(placed.join(many, "cell").select("id", "v", "p", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")))
    queries = table.where(F.col("id") % every == 0).select(F.col("id").alias("q"), "v", "p")

    def route(step: int):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                gap = _box_gap(np.array(part["p"].tolist()).reshape(-1, dims), low, high)
                order = np.argsort(gap, axis=1, kind="stable")
                best = part["best"].fillna(np.inf).to_numpy()
                for i in range(len(part)):
                    visit = order[i, :FIRST] if step == 0 else order[i, FIRST:]
                    visit = visit[gap[i, visit] <= limit * best[i] * best[i]]
                    reach = np.repeat(names[visit], blocks[visit])
                    inner = np.concatenate([np.arange(b) for b in blocks[visit]]) if len(visit) else np.zeros(0, int)
                    row = part.iloc[i]
                    if len(reach):
                        yield pd.DataFrame({"q": row["q"], "v": [row["v"]] * len(reach), "p": [row["p"]] * len(reach), "best": best[i], "cell": reach, "block": inner})
        return run

    def answer(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"q": [], "id": [], "score": []})
        vectors, points = (np.array(held[c].tolist()) for c in ("v", "p"))
        todo = [(q, np.array(v), np.array(p), b) for q, v, p, b in zip(asked["q"], asked["v"], asked["p"], asked["best"], strict=True)]
        return pd.DataFrame(list(search_block(held["id"].to_numpy(), vectors, points, todo, k, limit)), columns=["q", "id", "score"])

    found = None
    for step in (0, 1):
        known = queries.withColumn("best", F.lit(None).cast("double"))
        if found is not None:
            kth = found.where(F.col("rank") == k).select("q", F.col("score").alias("best"))
            known = queries.join(kth, "q", "left")
        asked = scratch.write(known.mapInPandas(route(step), "q long, v array<double>, p array<double>, best double, cell int, block int"))
        groups = scratch.write(asked.groupBy("cell", "block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")))
        # a block with very many queries is read once for every QUERIES of them
        asked = asked.join(groups, ["cell", "block"]).select(
            "q", "v", "p", "best", F.struct("cell", "block", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int").alias("part")).alias("to"))
        copies = groups.select("cell", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        held = table.join(copies, ["cell", "block"]).select("id", "v", "p", F.struct("cell", "block", "part").alias("at"))
        got = asked.groupBy("to").cogroup(held.groupBy("at")).applyInPandas(answer, "q long, id long, score double")
        if found is not None:
            got = found.select("q", "id", "score").unionByName(got)
        found = scratch.write(top_k(got, ["q"], [F.col("score"), F.col("id")], k, salts=8))
    return found.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def _cuts(points: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and value of each inner node of a balanced kd-tree with ``cells`` leaves, as a heap."""
    dim, value = np.zeros(max(1, cells), int), np.full(max(1, cells), np.inf)
    held = {1: np.arange(len(points))}
    for node in range(1, cells):
        rows = held.pop(node)
        if len(rows):
            dim[node] = int(np.ptp(points[rows], axis=0).argmax())
            value[node] = np.median(points[rows, dim[node]])
        left = points[rows, dim[node]] < value[node] if len(rows) else np.zeros(0, bool)
        held[2 * node], held[2 * node + 1] = rows[left], rows[~left]
    return dim, value


def _cell(points: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    dim, value = cuts
    node = np.ones(len(points), int)
    for _ in range(len(dim).bit_length() - 1):
        node = 2 * node + (points[np.arange(len(points)), dim[node]] >= value[node])
    return (node - len(dim)).astype(np.int32)
