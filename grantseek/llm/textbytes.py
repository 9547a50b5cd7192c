"""Whole texts of an Arrow batch as one byte buffer, and 64-bit hashes of any span of it in constant time.

A span's hash is a polynomial over random 64-bit byte codes, read off prefix sums, so all spans of a buffer
cost a few vector operations. Memory is about 100 times the slab that is hashed at once (``SLAB`` bytes, or
one longer text).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLAB = 1 << 20  # bytes of text that are worked on at once
WORD_BREAKS = b" \t\n\x0b\x0c\r"  # every other byte belongs to a word (fixed rule)

U64 = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # of two independent hashes
_CODES = np.random.default_rng(20240917).integers(0, 1 << 64, (2, 256), dtype=U64, endpoint=False)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[list(WORD_BREAKS)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the splitmix64 finisher)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=2)
def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(n, base & ((1 << 64) - 1), U64)
        out[0] = 1
        return np.cumprod(out, dtype=U64)
    return run(_BASES[which]), run(pow(_BASES[which], -1, 1 << 64))


class SpanHash:
    """Hashes of spans of ``data``; with ``fold`` A-Z count as a-z. ``which`` (0, 1) picks one of two independent hashes."""

    def __init__(self, data: np.ndarray, fold: bool = False, which: int = 0):
        size = SLAB
        while size < len(data) + 1:
            size *= 2
        up, self._down = _powers(size, which)
        codes = _CODES[which][_LOWER] if fold else _CODES[which]
        self._sums = np.zeros(len(data) + 1, U64)
        np.cumsum(codes[data] * up[: len(data)], out=self._sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sums[end] - self._sums[start]) * self._down[start]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows behind each other and the n + 1 row bounds; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[bounds[0]: bounds[-1]], bounds - bounds[0]


@lru_cache(maxsize=1)
def _trim():
    """What gives freed memory back to the system; nothing where the C library has no such call."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def freed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each, what it took goes back to the system, so that a worker waiting for its next task holds little."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        _trim()(0)


def slabs(bounds: np.ndarray, limit: int = SLAB) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    row, n = 0, len(bounds) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        yield row, min(end, n)
        row = end


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word, in order."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_BREAK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.empty(len(data), bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    start = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    return start, end, np.searchsorted(bounds, start, "right") - 1


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
