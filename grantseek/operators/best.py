"""The best rows of every request inside one task, held in a few arrays."""

from __future__ import annotations

import numpy as np

HELD = 200_000  # rows between two cuts


class Floor:
    """For a stream of score matrices (rows x requests): the score that a row needs to be among the best ``k`` so far."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least = max(k, 1), np.array(least, float)
        self._top = np.full((0, len(self.least)), -np.inf)

    def fits(self, scores: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
        """Which scores may still count; those not allowed never do."""
        open_ = scores >= self.least if allowed is None else allowed & (scores >= self.least)
        held = np.concatenate([self._top, np.where(open_, scores, -np.inf)])
        if len(held) > self.k:
            held = np.partition(held, len(held) - self.k, axis=0)[len(held) - self.k:]
            self.least = np.maximum(self.least, held.min(axis=0))
        self._top = held
        return open_ & (scores >= self.least)


class Best:
    """Running best ``k`` rows of each request: by greatest score and then smallest id, or by id alone.

    Memory is bounded by k rows a request and ``HELD`` more, whatever passes through.
    """

    def __init__(self, k: int, by_id: bool = False):
        self.k, self.by_id = k, by_id
        self._parts: list[tuple[np.ndarray, ...]] = []
        self._size, self._kept = 0, 0

    def add(self, query: np.ndarray, chunk: np.ndarray, document: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        self._parts.append((query, chunk, document, score))
        self._size += len(query)
        if self._size > HELD + 2 * self._kept:
            self._parts = [self.rows()]
            self._size = self._kept = len(self._parts[0][0])

    def rows(self) -> tuple[np.ndarray, ...]:
        """(query, chunk, document, score), ordered by request and rank."""
        if not self._parts:
            none = np.zeros(0, object)
            return np.zeros(0, np.int64), none, none, np.zeros(0)
        query, chunk, document, score = (np.concatenate(c) for c in zip(*self._parts, strict=True))
        if not self.by_id:  # rows that k better ones precede cannot stay, however their ids compare
            rough = np.lexsort((-score, query))
            begin = np.flatnonzero(np.diff(query[rough], prepend=query[rough[0]] - 1))
            place = np.arange(len(rough)) - np.repeat(begin, np.diff(np.append(begin, len(rough))))
            last = np.minimum(begin + self.k, np.append(begin[1:], len(rough))) - 1
            least = np.repeat(score[rough[last]], np.diff(np.append(begin, len(rough))))
            keep = rough[(place < self.k) | (score[rough] >= least)]
            query, chunk, document, score = query[keep], chunk[keep], document[keep], score[keep]
        ids = np.unique(chunk, return_inverse=True)[1]  # numbers sort faster than text
        order = np.lexsort((ids, query)) if self.by_id else np.lexsort((ids, -score, query))
        query, chunk, document, score = query[order], chunk[order], document[order], score[order]
        begin = np.flatnonzero(np.diff(query, prepend=query[0] - 1))
        place = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
        keep = place < self.k
        return query[keep], chunk[keep], document[keep], score[keep]
