"""Byte-level BPE encoding and decoding by monoid tree reduction.

Encodings of neighbouring byte strings are joined, not encoded anew: a token sequence is *the* encoding of its bytes exactly
if each two neighbours are the encoding of their own bytes. So a join encodes a small window around the boundary again and
doubles it until the tokens at its ends fit what lies outside; from there on nothing can change. Halves are
encoded recursively and joined, which keeps a match of any length near linear. Decoding concatenates halves up the tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 12  # bytes that are merged directly
NEVER = 1 << 60
REMEMBER = 500_000  # matches, and pairs of tokens, whose encoding a task keeps
# What \s means in the pattern of the rank files: Unicode White_Space (fixed list).
SPACES = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of every line of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Bpe:
    """Encoder and decoder for one set of ranks. Not for sharing between threads."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        spaces = pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"(?!\S)", f"(?![^{SPACES}])").replace(r"\s", f"[{SPACES}]")
        self.split = regex.compile(spaces).findall
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self.packed = _Packed(self)
        self.words = _Words(self)

    def _merge(self, data: bytes) -> list[bytes]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        parts, ranks = [data[i: i + 1] for i in range(len(data))], self.ranks
        if len(parts) > 4 * LEAF:
            return self._merge_long(parts)
        costs = [ranks.get(data[i: i + 2], NEVER) for i in range(len(parts) - 1)]
        while costs and (least := min(costs)) < NEVER:
            i = costs.index(least)
            parts[i: i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
        return parts

    def _merge_long(self, parts: list[bytes | None]) -> list[bytes]:
        """The same for long windows: a heap of pairs over a linked list."""
        n, ranks = len(parts), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, p) for i in range(n - 1) if (p := parts[i] + parts[i + 1]) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] + parts[j] != pair:
                continue  # one of the two has been merged since
            parts[i], parts[j] = pair, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (p := parts[left] + parts[right]) in ranks:
                    heapq.heappush(heap, (ranks[p], left, p))
        return [p for p in parts if p is not None]

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens are the encoding of their bytes."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= REMEMBER:
                self._pairs.clear()
            known = self._pairs[left, right] = self._merge(left + right) == [left, right]
        return known

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of the concatenation, from the encodings of both parts."""
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(width, len(right))
            window = self._merge(b"".join(left[a:] + right[:b]))
            if (a == 0 or self.fits(left[a - 1], window[0])) and (b == len(right) or self.fits(window[-1], right[b])):
                return left[:a] + window + right[b:]
            if a == 0 and b == len(right):
                return window
            width *= 2

    def tokens(self, data: bytes) -> list[bytes]:
        """Encoding of one match as token bytes."""
        if len(data) <= LEAF:
            return self._merge(data)
        half = len(data) // 2
        return self.join(self.tokens(data[:half]), self.tokens(data[half:]))

    def encode_match(self, match: str) -> list[int]:
        data = match.encode()
        rank = self.ranks.get(data)
        return [rank] if rank is not None else [self.ranks[t] for t in self.tokens(data)]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, as little-endian unsigned 32-bit integers.

        A single space between two characters that aren't white space always begins a match, so texts are cut
        there first and the words looked up; a text with other spaces is split by the pattern as a whole.
        """
        first, *rest = text.split(" ")
        try:
            packed = b"".join(map(self.words.__getitem__, rest))
            if rest and first and _EDGE(first[-1]):
                raise _Unclean
            packed = b"".join(map(self.packed.__getitem__, self.split(first))) + packed
        except _Unclean:
            packed = b"".join(map(self.packed.__getitem__, self.split(text)))
        return np.frombuffer(packed, "<u4")

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 1 << 16:
            return b"".join(map(self.bytes.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class _Packed(dict):
    """Ids of a match as bytes; encoded when first asked for, forgotten when there are too many."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self._bpe = bpe

    def __missing__(self, match: str) -> bytes:
        packed = np.array(self._bpe.encode_match(match), "<u4").tobytes()
        if len(match) <= 64:
            if len(self) >= REMEMBER:
                self.clear()
            self[match] = packed
        return packed


class _Unclean(Exception):
    """A word that white space touches."""


_EDGE = regex.compile(f"[{SPACES}]").match


class _Words(dict):
    """Ids of a word and the space before it."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self._bpe = bpe

    def __missing__(self, word: str) -> bytes:
        if not word or _EDGE(word[0]) or _EDGE(word[-1]):
            raise _Unclean
        packed = b"".join(map(self._bpe.packed.__getitem__, self._bpe.split(f" {word}")))
        if len(word) <= 64:
            if len(self) >= REMEMBER:
                self.clear()
            self[word] = packed
        return packed


@lru_cache(maxsize=2)
def loaded(path: str, pattern: str) -> Bpe:
    return Bpe(read_ranks(path), pattern)


ENCODED = "id long, ids array<long>, decoded binary"
DIGESTS = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _rows(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[tuple[int, np.ndarray, bytes]]:
    bpe = loaded(path, pattern)
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):  # one text at a time in memory
            ids = bpe.encode(text.as_py() or "")
            yield key.as_py(), ids, bpe.decode(ids.tolist())


def _flush(rows: Iterator[tuple], types: list[pa.DataType], names: list[str], size) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if weight >= 4 << 20 or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array<long>), decoded (binary) of every whole text; null text is empty and has no ids.

    Every row gives a row, also rows without an id or with one that came before. Other columns are not read.
    """
    def run(batches):
        rows = ((k, ids.tolist(), out) for k, ids, out in _rows(batches, path, pattern))
        yield from _flush(rows, [pa.int64(), pa.list_(pa.int64()), pa.binary()], ["id", "ids", "decoded"], lambda r: 8 * len(r[1]))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, ENCODED).withColumnRenamed("id", id_col)


def encoding_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of what ``encoded`` gives, taken inside the same tasks."""
    def run(batches):
        rows = ((k, len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(out).hexdigest()) for k, ids, out in _rows(batches, path, pattern))
        yield from _flush(rows, [pa.int64(), pa.int64(), pa.string(), pa.string()], ["id", "n_tokens", "ids_sha256", "decoded_sha256"], lambda r: 200)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, DIGESTS).withColumnRenamed("id", id_col)
