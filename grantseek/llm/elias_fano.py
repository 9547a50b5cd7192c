"""Elias-Fano code of a non-decreasing sequence, with a select structure to reach any entry.

Of n values up to u the lower l = log2(u / n) bits lie packed side by side and the rest is a bit vector in which value i sets
bit (value >> l) + i: about 2 + l bits a value. The place of every 64th set bit is kept in 32 bits, so the i-th
value is found by counting the bits of a few words from there on. There is no table of 64-bit offsets.
"""

from __future__ import annotations

import struct

import numpy as np

EVERY = 64  # set bits from one kept place to the next
_HEAD = struct.Struct("<QQI4x")  # values, greatest value, lower bits
_U = np.uint64


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits, lowest first, as 64-bit words; one word of zeros follows, so that a pair of words can be read anywhere."""
    out = np.zeros((len(bits) + 127) // 64 * 8, np.uint8)
    packed = np.packbits(bits, bitorder="little")
    out[: len(packed)] = packed
    return out.view("<u8")


class EliasFano:
    """``size`` non-decreasing integers from 0 on. ``self[i]`` for one or an array of places, ``values()`` for all."""

    def __init__(self, size: int, most: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.size, self.most, self._low, self._high, self._places = size, most, low, high, places
        self.low_bits = self._width(size, most)

    @staticmethod
    def _width(size: int, most: int) -> int:
        return max(0, (most // size).bit_length() - 1) if size else 0

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        if len(values) and (values[0] < 0 or (np.diff(values) < 0).any()):
            raise ValueError("values have to be non-negative and in ascending order")
        size, most = len(values), int(values[-1]) if len(values) else 0
        width = cls._width(size, most)
        low = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8)
        ones = (values >> width) + np.arange(size)
        bits = np.zeros(int(ones[-1]) + 1 if size else 0, np.uint8)
        bits[ones] = 1
        if len(bits) >= 1 << 32:
            raise ValueError("more than 2**32 bits: cut the sequence")
        return cls(size, most, _words(low.ravel()), _words(bits), ones[::EVERY].astype("<u4"))

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.size, self.most, len(self._high)) + self._low.tobytes() + self._high.tobytes() + self._places.tobytes()

    @classmethod
    def from_buffer(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The sequence that ``data`` begins with and the number of bytes that it takes."""
        size, most, high = _HEAD.unpack_from(data)
        low = (size * cls._width(size, most) + 127) // 64
        at = _HEAD.size
        parts = []
        for count, kind in ((low, "<u8"), (high, "<u8"), (-(-size // EVERY), "<u4")):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        return cls(size, most, *parts), at

    def _select(self, i: np.ndarray) -> np.ndarray:
        """Place of the i-th set bit, counted from 0."""
        begin = self._places[i // EVERY].astype(np.int64)
        left = i % EVERY  # set bits still to pass
        word = begin >> 6
        rest = self._high[word] >> (begin & 63).astype(_U) << (begin & 63).astype(_U)
        while (far := left >= (held := np.bitwise_count(rest))).any():
            left = np.where(far, left - held, left)
            word = word + far
            rest = np.where(far, self._high[np.minimum(word, len(self._high) - 1)], rest)
        bits = np.unpackbits(np.ascontiguousarray(rest, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return (word << 6) + (np.cumsum(bits, axis=1) > left[:, None]).argmax(axis=1)

    def __getitem__(self, places):
        i = np.atleast_1d(np.asarray(places, np.int64))
        if len(i) and (i.min() < 0 or i.max() >= self.size):
            raise IndexError(f"{self.size} values")
        value = self._select(i) - i if len(i) else i
        if self.low_bits:
            at = i * self.low_bits
            word, shift = at >> 6, (at & 63).astype(_U)
            pair = self._low[word] >> shift | np.where(shift > 0, self._low[word + 1] << (_U(63) - shift + _U(1) & _U(63)), _U(0))
            value = value << self.low_bits | (pair & _U((1 << self.low_bits) - 1)).astype(np.int64)
        return value if np.ndim(places) else int(value[0])

    def values(self) -> np.ndarray:
        """All of them, without the select structure."""
        ones = np.flatnonzero(np.unpackbits(self._high.view(np.uint8), bitorder="little"))
        values = ones - np.arange(self.size)
        if self.low_bits:
            bits = np.unpackbits(self._low.view(np.uint8), bitorder="little", count=self.size * self.low_bits)
            low = bits.reshape(self.size, self.low_bits).astype(np.int64) << np.arange(self.low_bits)
            values = values << self.low_bits | low.sum(axis=1)
        return values

    def last_at_most(self, value: int) -> int:
        """The last place whose entry is at most ``value``, by bisection over ``select``; -1 if there is none."""
        least, most = 0, self.size
        while least < most:
            half = (least + most) // 2
            if self[half] <= value:
                least = half + 1
            else:
                most = half
        return least - 1
