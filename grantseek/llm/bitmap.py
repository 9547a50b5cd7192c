"""A bitmap of fixed size as a filter before a shuffle: it may let rows through that are not meant, never the other way."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantseek.llm.textbytes import U64

BITS = 27  # log2 of its size: 16 MB at most, whatever the data
SHIFTS = (1, 7)  # where a hash holds the numbers of its bits in a word; all are set, so fewer others hit


class Bitmap:
    """Set of 64-bit hashes. Its bytes go to the tasks as a Spark broadcast of a size that never changes."""

    def __init__(self, hashes: DataFrame, bits: int = BITS):
        """``hashes``: one long column. Tasks combine what they have to words of 64 bits; the driver gets each word once."""
        self.bits = bits
        column = hashes.columns[0]
        h = F.col(column)
        word = F.shiftrightunsigned(h, 64 - bits + 6)
        bit = F.expr(" | ".join(f"shiftleft(1L, cast(shiftright({column}, {shift}) & 63 as int))" for shift in SHIFTS))
        words = hashes.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        index = words.column("word").to_numpy().astype(np.uint32)
        values = words.column("bits").to_numpy().view(U64)
        sparse = 12 * len(index) < 8 << (bits - 6)  # whichever is smaller is sent
        self._held = hashes.sparkSession.sparkContext.broadcast((index, values) if sparse else (None, self._filled(index, values)))
        self._table = None

    def _filled(self, index: np.ndarray, values: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << (self.bits - 6), U64)
        table[index] = values
        return table

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        if self._table is None:
            index, values = self._held.value
            self._table = values if index is None else self._filled(index, values)
        word = (hashes >> U64(64 - self.bits + 6)).astype(np.int64)
        held = self._table[word]
        return np.logical_and.reduce([(held >> ((hashes >> U64(shift)) & U64(63))) & U64(1) == 1 for shift in SHIFTS])

    def close(self) -> None:
        """Free it everywhere; for bitmaps that no lazy table reads any more."""
        self._held.destroy()

    def __getstate__(self):
        return {"bits": self.bits, "_held": self._held, "_table": None}


def likely(rows: DataFrame, column: str, members: Bitmap, wanted: bool = True) -> DataFrame:
    """``rows`` whose ``column`` may be a member (or, not ``wanted``, surely is none); members are ``xxhash64`` of the values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = members.hits(batch.column(batch.num_columns - 1).to_numpy().view(U64))
            yield batch.filter(pa.array(hit == wanted)).select(range(batch.num_columns - 1))
    names = rows.columns
    flat = rows.toDF(*(f"c{i}" for i in range(len(names))))  # a task takes no names with dots or quotes
    key = F.xxhash64(f"c{names.index(column)}").alias("hash")
    return flat.select("*", key).mapInArrow(run, flat.schema).toDF(*names)


def hashed(rows: DataFrame, make, schema: str) -> DataFrame:
    """The hashes that ``make(batch)`` gives for Arrow batches of ``rows``, as one long column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(make(batch).view(np.int64))], ["h"])
    return rows.mapInArrow(run, schema)
