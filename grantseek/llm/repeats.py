"""Suffix-array dedup: prefix doubling over sampled suffixes, in Spark rounds.

A byte goes if a string of ``length`` bytes that covers it also starts earlier. Plain prefix doubling ranks
every byte position in every round. Here a round ranks *anchors*: of each string of ``length`` bytes the start of its
``gram`` bytes of least hash. Equal strings have their anchors at equal offsets, so anchors are enough (about 3 % of all positions).

An anchor stands for a run of strings, those that begin ``first`` to ``last`` bytes before it. All of them share a core,
and all lie in a hull. A round ranks (core, hull, document, position):

* a core that occurs once is unique: its strings are settled and stay;
* of anchors with equal core and hull all but the first are copies: their whole hull goes;
* if the anchors of a core have different hulls, the first of each hull goes on: its run is cut into
  shorter ones with longer cores (32, 85, 97, then 100 bytes), until cores and hulls are the strings themselves.

Text moves once, to remove what was found. Between rounds, bitmaps of fixed size tell the tasks which anchors go on;
a bit set by chance only makes an anchor be ranked that is settled already, and the ranks say so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantseek.llm.bitmap import Bitmap, hashed
from grantseek.llm.scratch import Scratch, shuffles_freed
from grantseek.llm.textbytes import U64, SpanHash, freed, mix, signed, slabs, text_bytes

LENGTH = 100
GRAM = 32
SPLIT = 4  # parts into which a run is cut from round to round
TEXT_ROWS = 1000  # rows whose texts a task holds at once
PART = 1 << 18  # bytes of text that are hashed at once (or one longer text): what is made of them stays in the processor's cache


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best() of x[i: i + width] for every i."""
    step = 1
    while step * 2 <= width:
        x = best(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return best(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """(row, position in data, first, last, hash of its gram) of every anchor, in order."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, U64)
    start = np.arange(len(data) - gram + 1)
    h = SpanHash(data)(start, start + gram) | U64(1)
    width = length - gram + 1
    low = _sliding(h, width, np.minimum)  # least hash in the string from each position
    valid = np.zeros(len(data) + 1, np.int64)
    fits = np.diff(bounds) >= length
    np.add.at(valid, bounds[:-1][fits], 1)
    np.add.at(valid, bounds[1:][fits] - length + 1, -1)
    low = np.where(np.cumsum(valid)[: len(low)] > 0, low, U64(0))  # 0: reaches over the end of its row
    around = np.zeros(width - 1, U64)
    at = np.flatnonzero(h == _sliding(np.concatenate([around, low, around]), width, np.maximum))
    edge = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    run = np.searchsorted(edge, np.maximum(at - width + 1, 0), "right") - 1
    todo = np.flatnonzero(low[edge[run]] != h[at])
    while len(todo):
        run[todo] += 1
        todo = todo[low[edge[run[todo]]] != h[at[todo]]]
    ends = np.append(edge[1:], len(low)) - 1
    begin, end = np.maximum(edge[run], at - width + 1), np.minimum(ends[run], at)
    return np.searchsorted(bounds, at, "right") - 1, at, at - end, at - begin, h[at]


def _texts(batches: Iterator[pa.RecordBatch]):
    for batch in freed(batches):
        data, bounds = text_bytes(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b in slabs(bounds, PART):
            yield ids[a:b], data[bounds[a]: bounds[b]], bounds[a: b + 1] - bounds[a]


def _grams(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, bounds in _texts(batches):
            h, times = np.unique(anchors(data, bounds, length, gram)[4], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(np.minimum(times, 2).astype(np.int8))], ["gram", "n"])
    return run


REGION = "doc long, base long, size long, body binary, at array<int>, first array<short>, last array<short>"


def _regions(repeated: Bitmap, length: int, gram: int):
    """Stretches of text around anchors whose gram occurs again, with these anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, bounds in _texts(batches):
            row, at, first, last, h = anchors(data, bounds, length, gram)
            keep = repeated.hits(h)
            row, at, first, last = row[keep], at[keep], first[keep], last[keep]
            if not len(at):
                continue
            low, high = np.maximum(at - (length - gram), bounds[row]), np.minimum(at + length, bounds[row + 1])
            new = np.ones(len(at), bool)
            new[1:] = (row[1:] != row[:-1]) | (low[1:] > high[:-1])
            begin = np.flatnonzero(new)
            cut = np.append(begin, len(at))
            base, top = low[begin], high[cut[1:] - 1]
            owner = row[begin]
            offsets = np.concatenate([[0], np.cumsum(top - base)]).astype(np.int32)
            body = np.empty(offsets[-1], np.uint8)
            for i in range(len(begin)):
                body[offsets[i]: offsets[i + 1]] = data[base[i]: top[i]]
            lists = pa.array(cut.astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[owner]), pa.array(base - bounds[owner]), pa.array(bounds[owner + 1] - bounds[owner]),
                pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(body)]),
                pa.ListArray.from_arrays(lists, pa.array((at - bounds[row]).astype(np.int32))),
                pa.ListArray.from_arrays(lists, pa.array(first.astype(np.int16))),
                pa.ListArray.from_arrays(lists, pa.array(last.astype(np.int16)))],
                ["doc", "base", "size", "body", "at", "first", "last"])
    return run


def node_hash(doc: np.ndarray, at: np.ndarray, node: np.ndarray) -> np.ndarray:
    return mix(mix(doc.astype(U64) + U64(0x1234567)) ^ (at.astype(U64) * U64(0x9E3779B97F4A7C15)) ^ (node.astype(U64) << U64(48)))


def _copies(core: np.ndarray, hull: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which runs have the core and the hull of one at an earlier place; of a place given twice neither is a copy of the other."""
    again = np.zeros(len(core), bool)
    both = mix(core) ^ hull
    order = np.argsort(both)
    equal = both[order][1:] == both[order][:-1]
    some = order[np.concatenate([equal, [False]]) | np.concatenate([[False], equal])] if len(order) else order  # nearly all stand alone
    some = some[np.lexsort((at[some], doc[some], hull[some], core[some]))]
    same = (core[some][1:] == core[some][:-1]) & (hull[some][1:] == hull[some][:-1])
    same &= (doc[some][1:] != doc[some][:-1]) | (at[some][1:] != at[some][:-1])
    again[some[1:][same]] = True
    return again


NODE = "core long, hull long, doc long, at int, node short"


def _nodes(width: int, parent: int, active: Bitmap | None, length: int, gram: int):
    """Runs of at most ``width`` strings of the anchors whose run of at most ``parent`` is active.

    Of equal runs in one batch only the first is to be ranked; the others are copies already, and get no core.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            data, bounds = text_bytes(batch.column(3))
            doc, base, size = (batch.column(i).to_numpy() for i in range(3))
            flat = [batch.column(i).flatten().to_numpy().astype(np.int64) for i in (4, 5, 6)]
            counts = np.diff(batch.column(4).offsets.to_numpy())
            cut = np.concatenate([[0], np.cumsum(counts)])
            for a, b in slabs(bounds, PART):
                part = slice(cut[a], cut[b])
                row = np.repeat(np.arange(a, b), counts[a:b])
                at, first, last = (x[part] for x in flat)
                one = first // width
                many = last // width - one + 1
                pick = np.repeat(np.arange(len(at)), many)
                node = one[pick] + np.arange(len(pick)) - np.repeat(np.cumsum(many) - many, many)
                row, at = row[pick], at[pick]
                if active is not None:
                    go = active.hits(node_hash(doc[row], at, node * width // parent))
                    row, at, node = row[go], at[go], node[go]
                    if not len(row):
                        continue
                d1 = node * width
                d2 = np.minimum(d1 + width, length - gram + 1) - 1
                text = data[bounds[a]: bounds[b]]
                shift = bounds[row] - bounds[a] - base[row]
                core = SpanHash(text)(at - d1 + shift, at - d2 + length + shift)
                low, high = np.maximum(at - d2, 0), np.minimum(at - d1 + length, size[row])
                hull = SpanHash(text, which=1)(low + shift, high + shift) ^ mix((at - d2 - low).astype(U64) + ((at - d1 + length - high) << 16).astype(U64))
                core = mix(core ^ mix((node << 8).astype(U64) + U64(width)))
                again = _copies(core, hull, doc[row], at)
                yield pa.RecordBatch.from_arrays([
                    pa.array(signed(core), mask=again), pa.array(signed(hull), mask=again), pa.array(doc[row]),
                    pa.array(at.astype(np.int32)), pa.array(node.astype(np.int16))], ["core", "hull", "doc", "at", "node"])
    return run


def repeated_spans(texts: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, low, high): stretches of bytes that go, overlapping, from (id, text). Rows without an id are not read."""
    grams = texts.mapInArrow(_grams(length, gram), "gram long, n byte").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    with shuffles_freed(texts.sparkSession, TEXT_ROWS):
        repeated = Bitmap(grams.select("gram"))
        regions = scratch.write(texts.mapInArrow(_regions(repeated, length, gram), REGION))
    repeated.close()
    strings = length - gram + 1  # that hold a gram
    widths = [SPLIT ** k for k in range(30, -1, -1) if 3 * SPLIT ** k <= strings]  # each a part of the one before
    parent, active, found = 0, None, []
    for width in [strings, *(widths or [1])]:
        nodes = scratch.write(regions.mapInArrow(_nodes(width, parent, active, length, gram), NODE))
        if active is not None:
            active.close()
        by_core, by_hull = Window.partitionBy("core"), Window.partitionBy("core", "hull").orderBy("doc", "at")
        ranked = (nodes.where("core is not null").withColumn("place", F.rank().over(by_hull))
                  .withColumn("mixed", F.min("hull").over(by_core) < F.max("hull").over(by_core)))
        ranked = scratch.write(ranked.where("place > 1 or mixed").select("doc", "at", "node", (F.col("place") > 1).alias("copy")))
        d1 = F.col("node") * width
        d2 = F.least(d1 + width, F.lit(strings)) - 1
        gone = ranked.where("copy").select("doc", "at", "node").unionByName(nodes.where("core is null").select("doc", "at", "node"))
        found.append(scratch.write(gone.select("doc", F.greatest(F.col("at") - d2, F.lit(0)).cast("int").alias("low"),
                                               (F.col("at") - d1 + length).cast("int").alias("high"))))
        if width == 1:
            scratch.drop(nodes, ranked, regions)
            break  # cores and hulls are the strings themselves
        on = ranked.where("not copy")
        active = Bitmap(hashed(on, lambda b: node_hash(*(b.column(i).to_numpy().astype(np.int64) for i in range(3))), "h long"))
        scratch.drop(nodes, ranked)
        parent = width
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<low:int,high:int>>"


def _kept(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str, list]:
    """Removed bytes, removed runs, digest of what stays, the runs."""
    merged: list[list[int]] = []
    for low, high in sorted(spans):
        high = min(high, len(text))
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    digest, at = hashlib.sha256(), 0
    for low, high in merged:
        digest.update(text[at:low])
        at = high
    digest.update(text[at:])
    return sum(h - low for low, h in merged), len(merged), digest.hexdigest(), [{"low": low, "high": high} for low, high in merged]


_CODEC = "zstd"
MOVED = "id long, size long, body binary"


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Ids and texts, the texts compressed: they are moved once, as few bytes as can be."""
    raw = [(t.as_py() or "").encode() for t in batch.column(1)]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()),
                                       pa.array([pa.compress(r, _CODEC, asbytes=True) for r in raw], pa.binary())], ["id", "size", "body"])


def _whole(key: int | None, raw: bytes) -> tuple:
    """What comes out of a text of which nothing goes."""
    return key, len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), []


def _results(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))]
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out
                                      else [pa.array([], t) for t in kinds], names)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in freed(batches):
        out = []
        for key, size, body, spans in zip(*(batch.column(i) for i in range(4)), strict=True):
            raw = pa.decompress(body.as_py(), size.as_py(), _CODEC, asbytes=True) if size.as_py() else b""
            pairs = spans.as_py()
            packed = np.array(pairs or [], np.int64)
            removed, runs, digest, kept = _kept(raw, list(zip((packed >> 32).tolist(), (packed & 0xFFFFFFFF).tolist(), strict=True)))
            out.append((key.as_py(), len(raw), removed, runs, digest, kept))
        yield _results(out)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, spans (low, high) of bytes that go.

    Strings are compared within and across documents as the input has them; matches never cross documents. Null text is
    empty; texts shorter than ``length`` stay whole. Rows without an id stay whole and remove nothing. Two rows of one id count
    as one document: what goes in one goes in both. Other columns are not read. A text may have up to 2 GB.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spans = repeated_spans(rows.where("id is not null"), scratch, length, gram)
    packed = (F.col("low").cast("long") * (1 << 32) + F.col("high")).alias("span")
    lists = scratch.write(spans.select("doc", packed).groupBy("doc").agg(F.collect_set("span").alias("spans")))  # bounded by the document
    touched = Bitmap(hashed(lists.select("doc"), lambda b: mix(b.column(0).to_numpy().astype(U64) + U64(5)), "h long"))

    def having(batch: pa.RecordBatch) -> np.ndarray:
        ids = batch.column(0)
        hit = touched.hits(mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(U64) + U64(5)))
        return hit & ids.is_valid().to_numpy(zero_copy_only=False)

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            yield _packed(batch.filter(pa.array(having(batch))))

    def unchanged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            rest = batch.filter(pa.array(~having(batch)))
            yield _results([_whole(key.as_py(), (t.as_py() or "").encode()) for key, t in zip(rest.column(0), rest.column(1), strict=True)])
    moved = rows.mapInArrow(changed, MOVED).join(lists.withColumnRenamed("doc", "id").hint("merge"), "id", "left")
    out = moved.mapInArrow(_apply, RESULT).unionByName(rows.mapInArrow(unchanged, RESULT))
    return out.withColumnRenamed("id", id_col)
