"""Exact token counts by dynamic programming over prefixes.

For every prefix of a text the table holds the number of tokens of *its* encoding and the last of them. The last token of a
prefix is the one piece t that ends it and fits the last token before it: two neighbours fit if they are the
encoding of their own characters, and a sequence whose neighbours all fit is the encoding. So each entry follows from
earlier entries, and questions about truncation and budgets are lookups.

No piece of the vocabulary reaches over the start of a run of spaces, so a text falls into words
(a run of spaces and what follows) whose tables are independent: the count of a whole text is a sum, the
prefix table of a text is made of those of its words, and counts of frequent words are kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantseek.llm.textbytes import slabs, text_bytes

SPACE = "▁"  # what a space is in the vocabulary (fixed)
NEVER = float("-inf")
_ONE = (1,)
REMEMBER = 1_200_000  # words, and pairs of pieces, that a task keeps


class PrefixCounter:
    """Token counts under one vocabulary of scored pieces with bytes for unknown characters. Not for sharing between threads."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(model.get_piece_size())
                  if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in usable}
        sizes: dict[str, set[int]] = {}
        for piece in self.score:
            if len(piece) > 1:
                sizes.setdefault(piece[-2:], {1}).add(len(piece))
        self.lengths = {tail: tuple(sorted(found, reverse=True)) for tail, found in sizes.items()}  # of pieces, by their last two characters
        self.touching = {piece[i: i + 2] for piece in self.score for i in range(len(piece) - 1)}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.score):
            raise ValueError("a piece reaches over the start of a word: words are not independent under this vocabulary")
        if model.encode(" ᄀ a") != model.encode(" ᄀ a") or model.normalize("ﬁ å  b ") != f"{SPACE}ﬁ{SPACE}å{SPACE}{SPACE}b{SPACE}":
            raise ValueError("the vocabulary normalises texts; only plain ones are supported")
        self._pairs: dict[tuple[str, str], bool] = {}
        self._runs: dict[int, int] = {}
        self.words = _WordCounts(self)

    def merge(self, text: str) -> list[str]:
        """Pieces of ``text``: the adjacent pair of the best score is merged first, leftmost first."""
        if len(text) > 40:
            return self._merge_long(text)
        parts, score = list(text), self.score
        gains = [score.get(text[i: i + 2], NEVER) for i in range(len(parts) - 1)]
        while gains and (best := max(gains)) > NEVER:
            i = gains.index(best)
            parts[i: i + 2] = [parts[i] + parts[i + 1]]
            del gains[i]
            if i < len(gains):
                gains[i] = score.get(parts[i] + parts[i + 1], NEVER)
            if i:
                gains[i - 1] = score.get(parts[i - 1] + parts[i], NEVER)
        return parts

    def _merge_long(self, text: str) -> list[str]:
        """The same for long texts: a heap of pairs over a linked list."""
        parts: list[str | None] = list(text)
        n, score = len(parts), self.score
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-score[p], i, p) for i in range(n - 1) if (p := text[i: i + 2]) in score]
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
                if left >= 0 and right < n and (p := parts[left] + parts[right]) in score:
                    heapq.heappush(heap, (-score[p], left, p))
        return [p for p in parts if p is not None]

    def fits(self, left: str, right: str) -> bool:
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= REMEMBER:
                self._pairs.clear()
            known = self._pairs[left, right] = self.merge(left + right) == ([left, right] if right else [left])
        return known

    def weight(self, piece: str) -> int:
        """Tokens of a piece: a character without a piece is given as its bytes."""
        return 1 if piece in self.score else len(piece.encode())

    def table(self, word: str) -> tuple[list[int], list[bool]]:
        """Of every prefix of a word (one SPACE, then none): its tokens, and whether they begin with the SPACE alone."""
        counts, last, alone = [0], [""], [False]
        self._extend(word, counts, last, alone)
        return counts, alone

    def _extend(self, word: str, counts: list[int], last: list[str], alone: list[bool]) -> None:
        """Continue tables that hold the first prefixes of ``word`` to its end."""
        score, fits, lengths, pairs = self.score, self.fits, self.lengths, self._pairs
        for end in range(len(counts), len(word) + 1):
            for size in lengths.get(word[end - 2: end] if end > 1 else word[0], _ONE):
                begin = end - size
                if begin < 0:
                    continue
                piece = word[begin:end]
                if size > 1 and piece not in score:
                    continue
                if begin:
                    known = pairs.get((last[begin], piece))
                    if not (fits(last[begin], piece) if known is None else known):
                        continue
                elif size > 1 and not fits(piece, ""):
                    continue
                counts.append(counts[begin] + (1 if piece in score else self.weight(piece)))
                last.append(piece)
                alone.append(alone[begin] if begin else size == 1)
                break
            else:
                raise AssertionError(f"no last piece for a prefix of {word[:40]!r}")

    def learn(self, words: set[str]) -> None:
        """Keep the counts of ``words``. In sorted order each begins with a prefix whose table is there already."""
        if len(self.words) + len(words) > REMEMBER:
            self.words.clear()
        counts, last, alone, before, extend = [0], [""], [False], "", self._extend
        ordered = sorted([(self._core(word), word) for word in words])
        for core, whole in ordered:
            word = SPACE + core
            if word != before:
                shared, most = 0, min(len(word), len(before))
                while shared < most and word[shared] == before[shared]:
                    shared += 1
                del counts[shared + 1:], last[shared + 1:], alone[shared + 1:]
                extend(word, counts, last, alone)
                before = word
            self.words[whole] = counts[-1] if whole == core else counts[-1] + sum(map(self.weight, whole[len(core):]))

    def _core(self, word: str) -> str:
        """``word`` without the characters at its end that no piece holds together with the one before: they stand alone."""
        end = len(word)
        while end > 1 and word[end - 2: end] not in self.touching:
            end -= 1
        return word[:end]

    def run(self, spaces: int) -> int:
        """Tokens of spaces alone. Their pieces have one score, the least, so they merge after all others, leftmost first."""
        if spaces not in self._runs:
            if len(self._runs) >= 10_000:
                self._runs.clear()
            self._runs[spaces] = len(self.merge(SPACE * spaces))
        return self._runs[spaces]

    def _spaced(self, spaces: int, count: int, alone: bool) -> int:
        """Tokens of a word of that count whose run of spaces is longer than one."""
        return count - 1 + self.run(spaces) if alone else count + self.run(spaces - 1)

    def count(self, text: str) -> int:
        if not text:
            return 0
        parts = text.replace(SPACE, " ").split(" ") if SPACE in text else text.split(" ")
        if "" not in parts:
            return sum(map(self.words.__getitem__, parts))
        total, spaces = 0, 0
        for part in parts:
            spaces += 1
            if part:
                if spaces == 1:
                    total += self.words[part]
                else:
                    counts, alone = self.table(SPACE + part)
                    total += self._spaced(spaces, counts[-1], alone[-1])
                spaces = 0
        return total + (self.run(spaces) if spaces else 0)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Exact number of tokens of ``text[:i]`` for every i from 0 to its length."""
        out = np.zeros(len(text) + 1, np.int64)
        spaces, at, total = 0, 0, 0  # total: tokens of the words that have ended
        for k, part in enumerate(text.replace(SPACE, " ").split(" ")):
            spaces += 1
            if k:
                at += 1
                out[at] = total + self.run(spaces)
            if part:
                counts, alone = self.table(SPACE + part)
                for j in range(1, len(part) + 1):
                    out[at + j] = total + (counts[j + 1] if spaces == 1 else self._spaced(spaces, counts[j + 1], alone[j + 1]))
                at += len(part)
                total, spaces = int(out[at]), 0
        return out


class _WordCounts(dict):
    """Tokens of a word and the one space before it; forgotten when there are too many."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self._counter = counter

    def __missing__(self, word: str) -> int:
        counter, core = self._counter, self._counter._core(word)
        count = counter.table(SPACE + core)[0][-1] + sum(map(counter.weight, word[len(core):]))
        if len(word) <= 64:
            if len(self) >= REMEMBER:
                self.clear()
            self[word] = count
        return count


@lru_cache(maxsize=2)
def loaded(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every whole text; null text is empty.

    Every row gives a row, also rows without an id or with one that came before. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path)
        for batch in batches:
            column, counts = batch.column(1), []
            for a, b in slabs(text_bytes(column)[1], 4 << 20):
                texts = [text or "" for text in column.slice(a, b - a).to_pylist()]
                new = {word for word in set().union(*(text.split(" ") for text in texts)) if word and len(word) <= 64 and SPACE not in word}
                counter.learn(new.difference(counter.words))
                counts.extend(map(counter.count, texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["id", "n_tokens"])
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = docs.select(F.struct(F.col(id_col).alias("id"), size.alias("n_bytes")).alias("id"), F.col(text_col))
    counted = rows.mapInArrow(run, f"id struct<id:{docs.schema[id_col].dataType.simpleString()},n_bytes:bigint>, n_tokens long")
    return counted.select(F.col("id.id").alias(id_col), "id.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def truncated(docs: DataFrame, path: str, budgets: tuple[int, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, budget, n_chars, n_tokens: the longest prefix whose encoding has at most ``budget`` tokens, for each budget.

    Answered from the prefix table of the text, which is computed once for all budgets. Null text is empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path)
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                counts = counter.prefix_counts(text.as_py() or "")
                cuts = [int(np.flatnonzero(counts <= budget)[-1]) for budget in budgets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * len(cuts), pa.int64()), pa.array(budgets, pa.int64()), pa.array(cuts, pa.int64()),
                     pa.array([int(counts[c]) for c in cuts], pa.int64())], ["id", "budget", "n_chars", "n_tokens"])
    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col))
    return wanted.mapInArrow(run, "id long, budget long, n_chars long, n_tokens long").withColumnRenamed("id", id_col)
