"""Helpers shared by the operators: lineage cuts, skew-safe joins, per-key top-k."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Defaults of the retrieval system (fixed values).
CHUNK_SIZE = 400
CHUNK_OVERLAP = 80
CHUNK_MIN = 24
TOP_K = 30
TOP_N = 8
THRESHOLD = 0.4
VECTOR_WEIGHT = 0.6
KEYWORD_LIMIT = 200
HISTORY_ROUNDS = 6

# Requests answered by one pass over the index. The request side of every
# broadcast in the search is bounded by this number, never by the data.
PASS_QUERIES = 512


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a private one is set only on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="grantseek-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


@contextmanager
def shuffles_freed(spark: SparkSession, batch_rows: int | None = None) -> Iterator[None]:
    """Shuffle files of what is written, or defined and run, in this block go as soon as it has run; its rows are elsewhere by then.

    ``batch_rows`` bounds the rows that an Arrow batch of it takes to Python.
    """
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if batch_rows:
        wanted["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(batch_rows)
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def cut_lineage(df: DataFrame, ordered: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Later stages survive a lost executor and never repeat the work. A written
    table also has a known size, so joins with it are planned by that size. With
    ``ordered`` partitions and the order of their rows are kept as they are.
    """
    spark = df.sparkSession
    folder = ensure_checkpoint_dir(spark)
    if ordered:
        return df.checkpoint(eager=True)
    path = f"{folder}/grantseek/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], by: str, salts: int = 8, how: str = "inner"
) -> DataFrame:
    """Equi-join whose hot keys are split ``salts`` ways on the big side.

    ``by`` is a high-cardinality column of ``big``; the small side is replicated
    once per salt, so a key holding a third of ``big`` never lands in one task.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"spread_join keeps the big side on the left, not {how}")
    left = big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, *,
    rank: str = "rank", salts: int = 1,
) -> DataFrame:
    """First ``k`` rows of every key, numbered from 1 in column ``rank``.

    Spark cuts each input partition to ``k`` rows per key before the shuffle.
    With ``salts`` > 1 the survivors of groups of input partitions are cut once
    more in parallel, so the last step reads at most salts * k rows of a key.
    """
    if salts > 1:
        salted = df.withColumn("_salt", F.spark_partition_id() % salts)
        inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn(rank, F.row_number().over(inner)).where(F.col(rank) <= k).drop(rank, "_salt")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def split_passes(queries: DataFrame, key: str, limit: int = PASS_QUERIES) -> list[DataFrame]:
    """Split a request batch into slices of about ``limit`` rows, by hash of the key."""
    n = -(-queries.count() // limit)
    if n <= 1:
        return [queries]
    part = F.pmod(F.xxhash64(key), F.lit(n))
    return [queries.where(part == i) for i in range(n)]
