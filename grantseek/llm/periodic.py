"""Runs of words that repeat periodically, found by block convolution.

The words of many texts stand behind each other as integers. At scale B = 2, 4, 8 ... they are cut into blocks of B. The sum of
squared differences between a block and every stretch of B words that begins 2 B - 1 to 4 B - 2 words after it is three
sums, two of squares and one of products; the last is a convolution, taken by a number-theoretic transform of
length 4 B. Where the sum is zero the block occurs again, and the distance is a candidate for a period. Neighbouring blocks with one
distance are joined and extended to both sides as far as words at that distance are equal.

A run of period q and length max(12, 2 q) or more holds, before its last q words, max(12 - q, q) positions in a row,
so it holds a whole block of the scale whose distances include q: no run is missed. Of stretches with the same ends the
least distance is the run's period; every multiple of it ends at the same words.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantseek.llm.textbytes import U64, mix, slabs, text_bytes

PRIME = 998_244_353  # 119 * 2**23 + 1, with the root 3
LEAST = 12  # words of a run
SLAB = 2 << 20  # bytes of text that are searched at once, or one longer text
BATCH = 1 << 17  # numbers transformed at once
NEVER = np.int64(1) << 62
_P, _HALF = U64(PRIME), U64(32)


@lru_cache(maxsize=64)
def _twiddles(size: int, inverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a root of unity of order ``size`` and, for products without division, their quotients by the prime."""
    root = pow(3, (PRIME - 1) // size, PRIME)
    if inverse:
        root = pow(root, PRIME - 2, PRIME)
    powers = np.ones(1, U64)
    while len(powers) < size // 2:
        powers = np.concatenate([powers, powers * U64(pow(root, len(powers), PRIME)) % _P])
    return powers, (powers << _HALF) // _P


def _times(x: np.ndarray, w: np.ndarray, quotient: np.ndarray) -> np.ndarray:
    """x * w modulo the prime, for x < 2**32 and a fixed w with its quotient."""
    out = x * w - (x * quotient >> _HALF) * _P
    return np.minimum(out, out - _P)


def transform(x: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row, in bit-reversed order. Rows are as long as a power of two; values below the prime."""
    rows, size = x.shape
    half = size // 2
    while half:
        w, q = _twiddles(2 * half, False)
        pair = x.reshape(rows, -1, 2, half)
        a, b = pair[:, :, 0], pair[:, :, 1]
        out = np.empty_like(pair)
        total = a + b
        np.minimum(total, total - _P, out=out[:, :, 0])
        out[:, :, 1] = _times(a + (_P - b), w, q)
        x, half = out, half // 2
    return x.reshape(rows, size)


def inverse_transform(x: np.ndarray) -> np.ndarray:
    """Back from the bit-reversed order."""
    rows, size = x.shape
    half = 1
    while half < size:
        w, q = _twiddles(2 * half, True)
        pair = x.reshape(rows, -1, 2, half)
        a, b = pair[:, :, 0], _times(pair[:, :, 1], w, q)
        out = np.empty_like(pair)
        total, rest = a + b, a + (_P - b)
        np.minimum(total, total - _P, out=out[:, :, 0])
        np.minimum(rest, rest - _P, out=out[:, :, 1])
        x, half = out, half * 2
    return x.reshape(rows, size) * U64(pow(size, PRIME - 2, PRIME)) % _P


def zero_distances(codes: np.ndarray, blocks: np.ndarray, width: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) for each block of ``width`` codes and distance from ``least`` to ``most`` at which it occurs again.

    The sums are exact integers modulo the prime; a sum that is a multiple of it without being zero is left to the extension,
    which compares the words. ``codes`` are positive; what lies behind their end counts as 0 and equals no word.
    """
    shifts = most - least + 1
    size = 4 * width
    padded = np.concatenate([codes, np.zeros(most + width, np.int64)]).astype(U64)
    starts, distances = [], []
    for k in range(0, len(blocks), max(1, BATCH // size)):
        at = blocks[k: k + max(1, BATCH // size)]
        block = padded[at[:, None] + np.arange(width)]
        window = padded[at[:, None] + np.arange(least, most + width)]
        left, right = np.zeros((len(at), size), U64), np.zeros((len(at), size), U64)
        left[:, :width] = block[:, ::-1]
        right[:, : window.shape[1]] = window
        both = inverse_transform(transform(left) * transform(right) % _P)[:, width - 1: width - 1 + shifts]
        squares = np.zeros((len(at), window.shape[1] + 1), U64)
        np.cumsum(window * window % _P, axis=1, out=squares[:, 1:])
        apart = squares[:, width:] - squares[:, :shifts] + (block * block % _P).sum(axis=1)[:, None]
        row, shift = np.nonzero((apart % _P) == (both + both) % _P)
        starts.append(at[row])
        distances.append(shift + least)
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none
    return np.concatenate(starts), np.concatenate(distances)


class _Same:
    """How far words at two places stay equal, to the right or to the left: bisection over hashes of prefixes."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        base = 0x9E3779B97F4A7C15
        up = np.full(self.n + 1, base, U64)
        up[0] = 1
        self._up = np.cumprod(up, dtype=U64)
        self._sums = np.zeros(self.n + 1, U64)
        np.cumsum(mix(codes.astype(U64) * U64(0xD6E8FEB86659FD93)) * self._up[:-1], out=self._sums[1:])

    def _equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """a < b: the sum from a, moved up by b - a places, is that from b."""
        return (self._sums[a + length] - self._sums[a]) * self._up[b - a] == self._sums[b + length] - self._sums[b]

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._reach(self.n - b, lambda length: self._equal(a, b, length))

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._reach(a, lambda length: self._equal(a - length, b - length, length))

    @staticmethod
    def _reach(limit: np.ndarray, equal) -> np.ndarray:
        """The greatest length up to ``limit`` that is equal: doubled until it is not, then bisected."""
        got = np.zeros_like(limit)
        step = 1
        open_ = limit > 0
        while open_.any():  # got words are equal; try got + step
            length = np.minimum(got + step, limit)
            hit = open_ & equal(length)
            got = np.where(hit, length, got)
            open_ = hit & (got < limit)
            step *= 2
        while step > 1:
            step //= 2
            length = np.minimum(got + step, limit)
            got = np.where(equal(length), length, got)
        return got


class _Compared(_Same):
    """The same word by word, for texts in which two stretches have one hash."""

    def __init__(self, codes: np.ndarray):
        self.n, self._codes = len(codes), codes

    def _equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        codes = self._codes
        return np.array([np.array_equal(codes[i: i + k], codes[j: j + k]) for i, j, k in zip(a.tolist(), b.tolist(), length.tolist(), strict=True)], bool)


class _Collision(Exception):
    """Two stretches of words have one 64-bit hash."""


def find_runs(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All runs of several texts: rows (text, start, length, period) by text, start and period.

    ``codes`` are positive integers, equal for equal words, behind each other; text i is ``codes[bounds[i]: bounds[i + 1]]``.
    """
    try:
        return _find_runs(codes, bounds, _Same)
    except _Collision:
        return _find_runs(codes, bounds, _Compared)


def _find_runs(codes: np.ndarray, bounds: np.ndarray, compare: type[_Same]) -> np.ndarray:
    sizes = np.diff(bounds)
    texts = np.flatnonzero(sizes >= LEAST)
    if not len(texts):
        return np.zeros((0, 4), np.int64)
    kept = sizes[texts]
    begin = np.concatenate([[0], np.cumsum(kept + 1)[:-1]])  # with one separator behind each text
    line = np.zeros(int((kept + 1).sum()), np.int64)
    place = np.repeat(begin - bounds[texts], kept)
    inside = np.concatenate([np.arange(bounds[t], bounds[t + 1]) for t in texts])
    line[inside + place] = np.unique(codes[inside], return_inverse=True)[1] + 1
    line[begin + kept] = int(line.max()) + 1 + np.arange(len(texts))  # each separator is a word of its own
    n = len(line)

    # Distance to the next occurrence of the same word within the text; a block can occur again only if all its words do.
    order = np.argsort(line, kind="stable")
    after = np.full(n, NEVER)
    same = line[order[1:]] == line[order[:-1]]
    after[order[:-1][same]] = (order[1:] - order[:-1])[same]
    end = np.repeat(begin + kept, kept + 1)
    after[np.arange(n) + after.clip(max=n) >= end] = NEVER

    known = compare(line)
    found_start, found_end, found_period = [], [], []
    seen = np.zeros(0, np.int64)  # keys of found ends
    covered = np.zeros(n, np.int64)  # end of a run around a word whose period is at most the width of the blocks
    waiting: list[tuple[int, int, int]] = []
    width, farthest = 2, after
    longest = int(kept.max())
    while True:
        least, most = (1 if width == 2 else 2 * width - 1), 4 * width - 2
        if 2 * least > longest:
            break
        farthest = farthest[: len(farthest) // 2 * 2].reshape(-1, 2).max(axis=1)
        blocks = np.flatnonzero(farthest <= most) * width
        for s, e, q in [w for w in waiting if w[2] <= width]:
            np.maximum(covered[s:e], e, out=covered[s:e])
        waiting = [w for w in waiting if w[2] > width]
        # Inside a run of period q <= width a block occurs at multiples of q only.
        blocks = blocks[covered[blocks] < blocks + most + width]
        if len(blocks):
            start, distance = zero_distances(line, blocks, width, least, most)
            for s, e, q in zip(*_extended(line, known, start, distance, width, seen), strict=True):
                found_start.append(s)
                found_end.append(e)
                found_period.append(q)
                waiting.append((s, e, q))
            seen = np.sort(np.array(found_start, np.int64) * (n + 1) + np.array(found_end, np.int64))
        width *= 2
    start, end, period = (np.array(x, np.int64) for x in (found_start, found_end, found_period))
    text = np.searchsorted(begin, start, "right") - 1
    rows = np.stack([texts[text], start - begin[text], end - start, period], axis=1) if len(start) else np.zeros((0, 4), np.int64)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _extended(line: np.ndarray, known: _Same, start: np.ndarray, distance: np.ndarray, width: int, seen: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """New runs around the seeds: their starts, ends and periods."""
    order = np.lexsort((start, distance))
    start, distance = start[order], distance[order]
    if not len(start):
        return [], [], []
    # Neighbouring blocks of one distance are one seed.
    head = np.ones(len(start), bool)
    head[1:] = (distance[1:] != distance[:-1]) | (start[1:] != start[:-1] + width)
    first = np.flatnonzero(head)
    last = start[np.append(first[1:], len(start)) - 1] + width
    start, distance = start[first], distance[first]
    real = known._equal(start, start + distance, last - start)  # a sum may be a multiple of the prime
    start, distance, last = start[real], distance[real], last[real]
    begin = start - known.left(start, start + distance)
    end = last + known.right(last, last + distance) + distance
    long = end - begin >= np.maximum(LEAST, 2 * distance)
    begin, end, distance = begin[long], end[long], distance[long]
    # Of one pair of ends the least distance is the period.
    key = begin * (len(line) + 1) + end
    order = np.lexsort((distance, key))
    key, begin, end, distance = key[order], begin[order], end[order], distance[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    new &= ~np.isin(key, seen)
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    for s, e, q in zip(begin[new].tolist(), end[new].tolist(), distance[new].tolist(), strict=True):
        if not np.array_equal(line[s: e - q], line[s + q: e]):
            raise _Collision
        for column, value in zip(out, (s, e, q), strict=True):
            column.append(value)
    return out


def kept_words(size: int, runs: np.ndarray) -> np.ndarray:
    """Places of the words that stay when of each run (start, length, period) only the first period is kept."""
    drop = np.zeros(size + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(drop[:size]) == 0)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[bytes], np.ndarray]]:
    """(id, words, runs as rows of start, length and period) of each row."""
    for batch in batches:
        names, column = batch.column(0), batch.column(1)
        data, rows = text_bytes(column)
        for a, b in slabs(rows, SLAB):
            number: dict[bytes, int] = defaultdict(count(1).__next__)
            words, codes = [], []
            for k in range(a, b):
                found = data[rows[k]: rows[k + 1]].tobytes().split()  # at the six bytes of ASCII white space
                words.append(found)
                codes.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
            bounds = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
            runs = find_runs(np.concatenate(codes), bounds)
            parts = np.searchsorted(runs[:, 0], np.arange(b - a + 1))
            for k in range(b - a):
                yield names[a + k].as_py(), words[k], runs[parts[k]: parts[k + 1], 1:]


def _batches(rows: Iterator[tuple], schema: pa.Schema, weigh) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += weigh(row)
        if weight >= 4 << 20 or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, runs (start, length, period; counted in words, by start and period) and the collapsed text.

    Words are what ASCII white space separates. A run is a stretch of at least twice its smallest period and 12 words that no
    neighbouring word extends. ``collapsed`` are the words outside of runs and the first period of each run, unless another
    run drops them, joined by one space. Null and blank texts have no words, no runs and an empty collapsed text. Every
    row gives a row, also rows without an id or with one that came before. Other columns are not read.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])

    def rows(batches):
        for name, words, runs in _texts(batches):
            text = b" ".join([words[i] for i in kept_words(len(words), runs)] if len(runs) else words)
            yield name, len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()], text.decode()
    out = _input(docs, id_col, text_col).mapInArrow(
        lambda batches: _batches(rows(batches), schema, lambda r: len(r[3]) + 24 * len(r[2])),
        "id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_runs, the longest run and digests of what ``periodic_runs`` gives, taken inside the same tasks.

    ``start, length, period, exponent_milli`` are of the run of greatest length, ties to the smallest start, then period; null
    without runs. ``runs_sha256`` is of a line ``start,length,period`` for each run, ``collapsed_sha256`` of the collapsed text.
    """
    names = ("n_runs", "start", "length", "period", "exponent_milli")
    schema = pa.schema([("id", pa.int64()), *((c, pa.int64()) for c in names), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])

    def rows(batches):
        for name, words, runs in _texts(batches):
            lines, first = b"", (None, None, None, None)
            if len(runs):
                listed = runs.tolist()
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in listed).encode()
                start, length, period = min(listed, key=lambda r: (-r[1], r[0], r[2]))
                first = (start, length, period, 1000 * length // period)
                words = [words[i] for i in kept_words(len(words), runs)]
            yield name, len(runs), *first, hashlib.sha256(lines).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()
    out = _input(docs, id_col, text_col).mapInArrow(
        lambda batches: _batches(rows(batches), schema, lambda r: 200),
        f"id long, {', '.join(f'{c} long' for c in names)}, runs_sha256 string, collapsed_sha256 string")
    return out.withColumnRenamed("id", id_col)
