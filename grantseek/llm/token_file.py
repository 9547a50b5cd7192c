"""Token ids of a corpus as binary files: one concatenated id array, document bounds in Elias-Fano code.

A file is a row of segments; a segment holds some ten million ids and is read on its own::

    64 bytes   head: magic, version, bytes of an id, part, number in the file, documents, rows without an id, ids, least id
    ids        of all documents behind each other, little-endian, 2 or 4 bytes each
    bounds     Elias-Fano: 0 and the end of each document, counted from the segment's first id
    doc ids    Elias-Fano: document ids less the least one, in ascending order; rows without an id come before them
    1 byte     a line feed, put there by the writer

Documents lie in ascending order of their id over all segments, ordered by (part, number). Part is the number of the
range of ids that one task writes. Spark's writer moves the bytes and commits a file as a whole, so a lost
task leaves nothing behind, whatever store holds the files.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grantseek.llm.elias_fano import EliasFano
from grantseek.llm.scratch import Scratch
from grantseek.llm.textbytes import slabs, text_bytes

MAGIC, VERSION = b"TOKENIDS", 1
HEAD = struct.Struct("<8sHHIIIQQQq")
SEGMENT = 8 << 20  # ids from which on a segment ends, after a whole document
RANGE_BYTES = 12 << 20  # of text in a file
WORDS, LETTERS = 200_000, 500_000  # words as they stand, and runs of letters, that a task keeps


class WordEncoder:
    """Ids of whole texts under a ``tokenizers`` file that drops white space and joins nothing across it.

    Each word between spaces or line feeds goes through the library once; its ids are kept packed. A word of plain letters,
    with or without marks behind them, is what the library's normaliser and splitter leave as it is, but for its case: its
    letters go to the library's model directly.
    """

    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self._library = Tokenizer.from_file(path)
        self.width = 2 if max(self._library.get_vocab_size(True), (end_id or 0) + 1) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.end = b"" if end_id is None else self.pack([end_id])
        for probe in ("ab cd", "'s 's", "x\u0301 \u0301y", "1 2", "<|endoftext|> <|end", " a\n\nb ", "ff e. \n'T"):
            if self._ids(probe) != [i for word in probe.replace("\n", " ").split(" ") for i in self._ids(word)]:
                raise ValueError("the vocabulary joins characters across white space; words have no ids of their own")
        self._direct = all(self._ids(w) == self._model_ids(w.lower()) for w in _PROBES) and all(
            self._ids(w + t) == self._ids(w) + self._ids(t) for w in _PROBES for t in _MARKS)
        self._words, self._letters = _Known(self._word, WORDS), _Known(self._model_packed, LETTERS)

    def _ids(self, text: str) -> list[int]:
        return self._library.encode(text, add_special_tokens=False).ids

    def _model_ids(self, letters: str) -> list[int]:
        return [token.id for token in self._library.model.tokenize(letters.encode().decode("latin-1").translate(_VISIBLE))]

    def _model_packed(self, letters: str) -> bytes:
        return self.pack(self._model_ids(letters))

    def _word(self, word: str) -> bytes:
        if self._direct and (plain := _PLAIN(word)):
            letters, marks = plain.groups()
            return (self._letters[letters.lower()] if letters else b"") + (self._words[marks] if letters and marks else self.pack(self._ids(marks)) if marks else b"")
        return self.pack(self._ids(word))

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text, the end id behind them."""
        return b"".join(map(self._words.__getitem__, text.replace("\n", " ").split(" "))) + self.end


class _Known(dict):
    """What ``make`` gives for a word; made when first asked for, forgotten when there are too many."""

    def __init__(self, make, most: int):
        super().__init__()
        self._make, self._most = make, most

    def __missing__(self, word: str) -> bytes:
        packed = self._make(word)
        if len(word) <= 64:
            if len(self) >= self._most:
                self.clear()
            self[word] = packed
        return packed


# Letters of Latin-1, which are in normal form alone and beside each other, then ASCII marks and digits.
_PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*)([!-@\[-`{-~]*)").fullmatch
_PROBES = ("a", "The", "straße", "ÀÉÿþ", "Æther", "xylophonically", "é", "QQQQ")
_MARKS = (",", "'", "...", "!?", "1", "'12", "$$$", "</", "<|")


def _visible_bytes() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is visible, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_VISIBLE = _visible_bytes()


@lru_cache(maxsize=2)
def loaded(path: str, end_id: int | None) -> WordEncoder:
    return WordEncoder(path, end_id)


def pack_segment(doc_ids: list[int | None], packed: list[bytes], width: int, part: int = 0, number: int = 0) -> bytes:
    """One segment without the last line feed. ``doc_ids`` ascend; missing ones come first."""
    named = np.array([i for i in doc_ids if i is not None], np.int64)
    least = int(named[0]) if len(named) else 0
    bounds = np.cumsum([0, *map(len, packed)]) // width
    head = HEAD.pack(MAGIC, VERSION, width, part, number, 0, len(doc_ids), len(doc_ids) - len(named), int(bounds[-1]), least)
    return b"".join([head.ljust(64, b"\0"), *packed, EliasFano.of(bounds).to_bytes(), EliasFano.of(named - least).to_bytes()])


class Segment:
    """One segment in a buffer. ``ids(i)`` are those of its i-th document; nothing else is decoded for it."""

    def __init__(self, data: memoryview):
        magic, version, width, self.part, self.number, _, self.documents, self.unnamed, self.size, self._least = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a file of token ids")
        self.array = np.frombuffer(data, f"<u{width}", self.size, 64)
        at = 64 + self.array.nbytes
        self.bounds, used = EliasFano.from_buffer(data[at:])
        self._names, more = EliasFano.from_buffer(data[at + used:])
        self.length = at + used + more + 1

    def ids(self, i: int) -> np.ndarray:
        begin, end = self.bounds[[i, i + 1]]
        return self.array[begin: end]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.unnamed else self._names[i - self.unnamed] + self._least

    def doc_ids(self) -> list[int | None]:
        return [None] * self.unnamed + (self._names.values() + self._least).tolist()

    def document_at(self, place: int) -> int:
        """The document that holds the id at ``place`` of the segment."""
        return min(self.bounds.last_at_most(place), self.documents - 1)


def segments(data: bytes | memoryview) -> Iterator[Segment]:
    """The segments of a whole file."""
    data = memoryview(data)
    while len(data):
        found = Segment(data)
        yield found
        data = data[found.length:]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write files of ids below ``path``, in ascending order of id over all files.

    Null and blank texts have no ids but the end id. Rows without an id come first, rows of one id in the order of a hash of
    their text; every row is a document. An empty table gives files without segments. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    whole = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.asc_nulls_first("id"), F.xxhash64("text")]
    ranged = rows.repartitionByRange(max(1, -(-whole // RANGE_BYTES)), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number = loaded(tokenizer, end_id), TaskContext.get().partitionId(), 0
        names, packed, held = [], [], 0
        for batch in batches:
            column = batch.column(1)
            for a, b in slabs(text_bytes(column)[1], 4 << 20):
                for name, text in zip(batch.column(0).slice(a, b - a).to_pylist(), column.slice(a, b - a).to_pylist(), strict=True):
                    ids = coder.encode(text or "")
                    names.append(name)
                    packed.append(ids)
                    held += len(ids)
                    if held >= SEGMENT * coder.width:
                        yield pa.RecordBatch.from_arrays([pa.array([pack_segment(names, packed, coder.width, part, number)], pa.binary())], ["segment"])
                        names, packed, held, number = [], [], 0, number + 1
        if names:
            yield pa.RecordBatch.from_arrays([pa.array([pack_segment(names, packed, coder.width, part, number)], pa.binary())], ["segment"])
    # The text writer copies the bytes of a string as they are and ends each with a line feed.
    ranged.mapInArrow(run, "segment binary").select(F.col("segment").cast("string").alias("value")).write.text(path)


READ = "part int, number int, place int, id long, begin long, n_tokens long"


def _read(spark: SparkSession, path: str, extra: str, column) -> DataFrame:
    """READ and one more column, ``column(segment, bounds)``, for every document of the files below ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for seg in segments(content.as_buffer()):
                    bounds, n = seg.bounds.values(), seg.documents
                    more, kind = column(seg, bounds)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, seg.part, np.int32)), pa.array(np.full(n, seg.number, np.int32)), pa.array(np.arange(n, dtype=np.int32)),
                         pa.array(seg.doc_ids(), pa.int64()), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(more, kind)],
                        ["part", "number", "place", "id", "begin", "n_tokens", "more"])
    files = spark.read.format("binaryFile").load(path).select("content").where(F.length("content") > 0)
    return files.mapInArrow(run, f"{READ}, more {extra}")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """part, number, place, id, begin, n_tokens and ids (array<int>, unsigned) of every document in the files."""
    def ids(seg: Segment, bounds: np.ndarray):
        kind = pa.list_(pa.int64())
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(seg.array.astype(np.int64))), kind
    return _read(spark, path, "array<bigint>", ids).withColumnRenamed("more", "ids")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every document, from the files: ``start`` ids come before it in all of them.

    ``ids_crc32`` is that of the ids as little-endian unsigned 32-bit integers.
    """
    def sums(seg: Segment, bounds: np.ndarray):
        raw, at = memoryview(seg.array.astype("<u4").tobytes()), (4 * bounds).tolist()
        return [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.int64()
    found = Scratch(spark).write(_read(spark, path, "bigint", sums))
    # One row for each segment of some million ids is ranked here.
    whole = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return found.join(whole, ["part", "number"]).select("id", (F.col("begin") + F.col("before")).alias("start"), "n_tokens", F.col("more").alias("ids_crc32"))


def file_digests(docs: DataFrame, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, n_tokens, ids_crc32: files are written in the checkpoint folder, read back, and dropped."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    path = f"{scratch.folder}/tokens"
    write_token_files(docs, path, tokenizer, end_id, id_col, text_col)
    digests = token_digests(spark, path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return digests.withColumnRenamed("id", id_col)
