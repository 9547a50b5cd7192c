"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of its byte 3-grams and 4-grams (ASCII in lower case, all that is neither letter nor
beyond ASCII read as a space), hashed into ``BUCKETS`` rows; a linear layer and softmax give the languages. As
both are linear, the tasks only need the product of the two tables: one row of logits for each bucket.

Part of the sample is not trained on. A temperature fitted there makes the scores probabilities, and the rejection
threshold is the least score from which on at most ``ERRORS`` of the predictions are wrong.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantseek.common import top_k
from grantseek.llm.textbytes import slabs, text_bytes

SAMPLE = 2400  # labelled documents that the model is fitted on, as many of each language as there are
LANGUAGES = 400  # most frequent values of the label that are learned
BUCKETS = 1 << 15
WIDTH = 16  # of an embedding
EPOCHS = 8
ERRORS = 0.01
FOLDS = 5
UNKNOWN = "und"

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def fold(column):
    """Remainder that sets held-out rows apart: they are those with 0."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(FOLDS))


def grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every subword: all 3-grams, then all 4-grams, of a text framed in spaces."""
    n = len(bounds) - 1
    framed = np.full(len(data) + 5 * n, 32, np.uint8)  # two spaces before a text and three behind
    row = np.repeat(np.arange(n), np.diff(bounds))
    framed[np.arange(len(data)) + 5 * row + 2] = _PLAIN[data]
    code = framed.astype(np.uint32)
    owner = np.repeat(np.arange(n), np.diff(bounds) + 5)
    three = code[:-3] | code[1:-2] << np.uint32(8) | code[2:-1] << np.uint32(16)
    four = three | code[3:] << np.uint32(24)
    last = (bounds[1:] + 5 * np.arange(1, n + 1))[owner[:-3]]
    inside = np.arange(len(framed) - 3) + 3 < last
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    with np.errstate(over="ignore"):
        h3 = (three * np.uint32(2654435761)) >> shift
        four ^= four >> np.uint32(15)
        h4 = (four * np.uint32(2246822519)) >> shift
    return np.concatenate([h3[inside], h4[inside]]), np.concatenate([owner[:-3][inside]] * 2)


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # buckets x languages, float32
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Calibrated probability of each language for each row."""
        n = len(bounds) - 1
        if not self.languages:
            return np.zeros((n, 1))
        total, count = np.zeros((n, len(self.languages))), np.zeros(n)
        for a, b in slabs(bounds, 1 << 19):
            bucket, row = grams(data[bounds[a]: bounds[b]], bounds[a: b + 1] - bounds[a])
            count[a:b] = np.bincount(row, minlength=b - a)
            half = len(bucket) // 2  # both halves are ordered by row
            for part in (slice(0, half), slice(half, None)):
                if len(bucket[part]):
                    rows, first = np.unique(row[part], return_index=True)
                    total[a + rows] += np.add.reduceat(self.logits[bucket[part]], first, axis=0, dtype=np.float64)
        return _softmax((total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], tune: np.ndarray, seed: int = 0) -> Model:
    """rows: (buckets, share of each, language). ``tune`` marks the rows that only calibrate."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    out, bias = np.zeros((WIDTH, k)), np.zeros(k)
    train = np.flatnonzero(~tune)
    steps, done = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            bucket, share, y = rows[i]
            rate = 1.0 * (1 - done / max(1, steps))
            done += 1
            hidden = share @ table[bucket]
            p = _softmax((hidden @ out + bias)[None])[0]
            p[y] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= 0.01 * rate * p
            table[bucket] -= (rate * len(bucket) ** 0.5) * share[:, None] * back
    logits = table @ out
    z = np.array([rows[i][1] @ logits[rows[i][0]] + bias for i in np.flatnonzero(tune)]).reshape(-1, k)
    y = np.array([rows[i][2] for i in np.flatnonzero(tune)], int)
    temperature, threshold = 1.0, 0.0
    if len(y):
        grid = np.geomspace(0.3, 5, 60)
        losses = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(losses))])
        p = _softmax(z / temperature)
        best, wrong = p.max(axis=1), p.argmax(axis=1) != y
        order = np.argsort(-best)
        allowed = np.flatnonzero(np.cumsum(wrong[order]) <= ERRORS * np.arange(1, len(y) + 1))
        threshold = float(best[order[allowed[-1]]]) if len(allowed) else 1.0
    return Model(languages, logits.astype(np.float32), bias, temperature, threshold)


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most ``sample`` documents outside the held-out fold, as many of each language as there are, smallest by hash of the id.

    Rows without text or language teach nothing. Without any labelled row the model knows no language.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).where(fold(F.col(id_col)) != 0)
    names = sorted(r[0] for r in known.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(LANGUAGES).collect())
    if not names:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 1.0)
    chosen = top_k(known.where(F.col(lang_col).isin(names)).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang")),
                   ["_lang"], [F.xxhash64("_id"), F.col("_id")], max(8, sample // len(names)), salts=16)
    chosen = chosen.select("_id").distinct()
    rows = docs.join(F.broadcast(chosen), docs[id_col] == chosen["_id"]).where(F.col(text_col).isNotNull() & F.col(lang_col).isin(names))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            for i in range(len(bounds) - 1):
                found, times = np.unique(grams(data[bounds[i]: bounds[i + 1]], np.array([0, bounds[i + 1] - bounds[i]]))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([found.astype("<u2").tobytes()]), pa.array([times.astype("<u4").tobytes()]), batch.column(2).slice(i, 1)],
                    ["lang", "found", "times", "tune"])
    tune = (F.pmod(F.xxhash64(F.lit(1), F.col(id_col)), F.lit(5)) == 0).cast("int").alias("tune")
    counted = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), tune, F.xxhash64(id_col).alias("order")).select("lang", "text", "tune", "order")
    order_kept = counted.select(F.struct("lang", "order").alias("lang"), "text", "tune")
    got = order_kept.mapInArrow(count, "lang struct<lang:string,order:bigint>, found binary, times binary, tune int").collect()  # bounded by the sample
    got.sort(key=lambda r: (r["lang"]["order"], r["lang"]["lang"]))
    place = {name: i for i, name in enumerate(names)}
    data = []
    for r in got:
        times = np.frombuffer(r["times"], "<u4").astype(float)
        data.append((np.frombuffer(r["found"], "<u2").astype(np.int64), times / times.sum(), place[r["lang"]["lang"]]))
    return fit(data, names, np.array([r["tune"] == 1 for r in got], bool))


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score, accepted of every whole text.

    ``lang_pred`` is the likeliest learned language, ``und`` with score 0 if the text is null or has no letter or nothing was
    learned. ``accepted`` says whether the score reaches the calibrated threshold; callers that want rejection read
    ``und`` where it is false. Every row gives a row; without an id, held_out is null. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.languages or [UNKNOWN], object)
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            p = model.scores(data, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[p.argmax(axis=1)], pa.string()), pa.array(p.max(axis=1))], ["id", "lang", "p"])
    kind = docs.schema[id_col].dataType.simpleString()
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), letters.alias("letters")).alias("id"), F.col(text_col))
    out = keyed.mapInArrow(run, f"id struct<id:{kind},letters:boolean>, lang string, p double")
    some = F.col("id.letters") & F.lit(bool(model.languages))
    score = F.when(some, F.least(F.col("p"), F.lit(1.0))).otherwise(0.0)
    return out.select(F.col("id.id").alias(id_col), (fold(F.col("id.id")) == 0).alias("held_out"),
                      F.when(some, F.col("lang")).otherwise(UNKNOWN).alias("lang_pred"), score.alias("score"),
                      (some & (score >= model.threshold)).alias("accepted"))


def identify(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``predicted`` with a model that ``train`` fits on the rows of ``docs``."""
    return predicted(docs, train(docs, sample, id_col, text_col, lang_col), id_col, text_col)
