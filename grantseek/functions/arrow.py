"""The few Python helpers, all Arrow-batched: normal forms, entities, decoding, splitting."""

from __future__ import annotations

import csv
import html
import io
import json
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Cut points from strong to weak, and the encodings tried in order.
SEPARATORS = (
    "\n\n", "\n",
    "。", "！", "？", "；", "……", "’", "”",
    ". ", "! ", "? ", "; ",
    "，", "、", ", ",
    " ",
)
ENCODINGS = ("utf-8", "gb18030", "utf-16", "big5", "latin-1")
ATTACHMENT_ENCODINGS = ("utf-8", "gb18030", "latin-1")


def _each(fn):
    """Lift a scalar function over a nullable Series."""
    def apply(s: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else fn(v) for v in s], dtype=object)
    return apply


def _udf(fn, returns: str = "string"):
    def apply(s: pd.Series) -> pd.Series:
        return _each(fn)(s)
    return F.pandas_udf(apply, returns)


def nfkc(c: Column) -> Column:
    """Only texts with other than ASCII characters go to Python; ASCII is its own normal form."""
    ascii_only = F.octet_length(c) == F.char_length(c)
    other = F.when(~ascii_only, c)
    return F.coalesce(F.when(ascii_only, c), _udf(lambda v: unicodedata.normalize("NFKC", v))(other))


def unescape(c: Column) -> Column:
    return _udf(html.unescape)(c)


def _first_decoding(raw: bytes, encodings) -> str:
    for name in encodings:
        try:
            return bytes(raw).decode(name)
        except UnicodeDecodeError:
            pass
    return ""


def decode_bytes(c: Column) -> Column:
    """Text of a file. Valid UTF-8 is read in the JVM; only other bytes go to Python."""
    as_text = F.try_validate_utf8(c.cast("string"))
    other = F.when(as_text.isNull(), c)
    return F.coalesce(as_text, _udf(lambda v: _first_decoding(v, ENCODINGS))(other))


def decode_attachment(c: Column) -> Column:
    as_text = F.try_validate_utf8(c.cast("string"))
    other = F.when(as_text.isNull(), c)
    return F.coalesce(as_text, _udf(lambda v: _first_decoding(v, ATTACHMENT_ENCODINGS))(other))


def _csv_lines(raw: str) -> str:
    try:
        rows = [[cell.strip() for cell in row] for row in csv.reader(io.StringIO(raw))]
    except csv.Error:
        return raw
    return "\n".join(" | ".join(row) for row in rows if any(row))


def csv_text(c: Column) -> Column:
    return _udf(_csv_lines)(c)


def _json_text(raw: str) -> str:
    try:
        return json.dumps(json.loads(raw), ensure_ascii=False, indent=2)
    except (ValueError, RecursionError):  # no JSON, or nested deeper than the parser goes
        return raw


def json_text(c: Column) -> Column:
    return _udf(_json_text)(c)


DETAIL_CHARS = 2000


def _shortened(text: str) -> str:
    return text if len(text) <= DETAIL_CHARS else text[:DETAIL_CHARS] + "…"


def _sanitized(raw: str) -> str:
    """JSON detail with sensitive values masked and long texts cut, at any depth of objects.

    What is no JSON at all is kept as text of the same length limit: a bad detail must not cost the row.
    """
    from grantseek.functions.text import SENSITIVE_KEYS
    try:
        value = json.loads(raw)
        if not isinstance(value, dict):
            return raw
        open_objects = [value]
        while open_objects:
            fields = open_objects.pop()
            fields.update({k: "***" for k in fields if k.lower() in SENSITIVE_KEYS})
            fields.update({k: _shortened(v) for k, v in fields.items() if isinstance(v, str)})
            open_objects += [v for v in fields.values() if isinstance(v, dict)]
        return json.dumps(value, ensure_ascii=False)
    except (ValueError, RecursionError):
        return raw[:DETAIL_CHARS]


def sanitize_json(c: Column) -> Column:
    return _udf(_sanitized)(c)


def cut_pieces(text: str, size: int):
    """Yield parts of ``text`` no longer than ``size``, cut at the strongest separator present.

    A separator stays with the part on its left. Parts still too long are
    stripped and cut again with weaker separators, at last by length alone.
    """
    todo = [(text, 0)]
    while todo:
        part, level = todo.pop()
        if level < 0:
            yield part
            continue
        part = part.strip()
        if len(part) <= size:
            if part:
                yield part
            continue
        while level < len(SEPARATORS) and SEPARATORS[level] not in part:
            level += 1
        if level == len(SEPARATORS):
            yield from (part[at:at + size] for at in range(0, len(part), size))
            continue
        sep = SEPARATORS[level]
        fields = part.split(sep)
        segments = [f + sep for f in fields[:-1]] + ([fields[-1]] if fields[-1] else [])
        todo.extend((s, -1 if len(s) <= size else level + 1) for s in reversed(segments))


def pack(lengths: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans (from, to) over the concatenated pieces, of at most ``size``; each but the first reaches back ``overlap``.

    A span never reaches back beyond the start of the one before, and not at all if its first piece would not fit then.
    """
    spans: list[tuple[int, int]] = []
    start = end = 0
    for length in lengths:
        if end + length - start > size:
            spans.append((start, end))
            back = max(start, end - max(overlap, 0))
            start = back if end + length - back <= size else end
        end += length
    return [*spans, (start, end)] if end else []


def split_text(text: str, size: int, overlap: int, min_size: int) -> list[str]:
    """Chunks of one section. A last chunk of fewer than ``min_size`` characters goes to the one before."""
    pieces = list(cut_pieces(text, size))
    whole = "".join(pieces)
    chunks = [whole[a:b] for a, b in pack([len(p) for p in pieces], size, overlap)]
    if len(chunks) > 1 and len(chunks[-1]) < min_size:
        chunks[-2:] = ["".join(chunks[-2:])]
    return [kept for chunk in chunks if (kept := chunk.strip())]


SLAB = 64  # rows whose texts and pieces are Python objects at once, whatever the size of an Arrow batch


def _by_slab(rows: pa.Array, kind: pa.DataType, fn) -> pa.Array:
    """``fn`` of a slab of rows after the other, as one array."""
    parts = [fn(rows.slice(at, SLAB)) for at in range(0, len(rows), SLAB)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def pieces_of(c: Column, size: int) -> Column:
    kind = pa.list_(pa.string())

    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([None if v is None else list(cut_pieces(v, size)) for v in texts.to_pylist()], kind)
    return F.arrow_udf(lambda texts: _by_slab(texts, kind, cut), "array<string>")(c)


def split_sections(sections: Column, size: int, overlap: int, min_size: int) -> Column:
    """Chunks (content, page) of a document's sections (text, page), in order.

    Marked non-deterministic so that no filter above makes Spark evaluate it twice.
    """
    kind = pa.list_(pa.struct([("content", pa.string()), ("page", pa.int32())]))

    def split(documents: pa.Array) -> pa.Array:
        content: list[str] = []
        page: list[int | None] = []
        ends = [0]
        for parts in documents.to_pylist():
            for section in parts or ():
                cut = split_text(section["text"] or "", size, overlap, min_size)
                content.extend(cut)
                page.extend([section["page"]] * len(cut))
            ends.append(len(content))
        chunks = pa.StructArray.from_arrays(
            [pa.array(content, pa.string()), pa.array(page, pa.int32())], names=["content", "page"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), chunks)
    return F.arrow_udf(lambda documents: _by_slab(documents, kind, split),
                       "array<struct<content:string,page:int>>").asNondeterministic()(sections)
