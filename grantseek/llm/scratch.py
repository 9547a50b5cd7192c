"""Written intermediate tables in the shared checkpoint folder; dropped as soon as nothing reads them."""

from __future__ import annotations

import uuid

from collections.abc import Iterable
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantseek.common import ensure_checkpoint_dir, shuffles_freed


class Scratch:
    """Tables of one call. ``write`` cuts the lineage; ``drop`` frees the space of what is read no more.

    With ``lean`` the shuffle files behind a table go as soon as it is written.
    """

    def __init__(self, spark: SparkSession, lean: bool = False):
        self.spark = spark
        self.lean = lean
        self.folder = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}

    def write(self, df: DataFrame, batch_rows: int | None = None) -> DataFrame:
        path = f"{self.folder}/{len(self._paths)}-{uuid.uuid4().hex[:8]}"
        with shuffles_freed(self.spark, batch_rows) if self.lean else nullcontext():
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._scratch_path = path  # keeps the id from being used again
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def named(column: str) -> Column:
    """A column of exactly this name, whatever marks it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted``, or a longer name that no column has."""
    held = {name.lower() for name in taken}
    while wanted.lower() in held:
        wanted += "_"
    return wanted
