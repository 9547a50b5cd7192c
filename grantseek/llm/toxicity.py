"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

1. Lexicon: common insults, and the words and word beginnings that labelled toxic documents hold far more often than clean ones. They are
   found on one half of the sample; all else is fitted on the other, where a chance entry shows its true worth.
2. Voters: each lexicon entry votes toxic where it occurs; pattern voters (several entries, density of entries,
   capitals, exclamation marks) vote either way or abstain; the human label of a training row votes as well.
3. Label model: expectation maximisation of the voters' accuracies. Votes that go together beyond what the class
   explains are found from the residual correlations, and voters so correlated share one voice.
4. A logistic regression on counts, densities and patterns learns the model's posterior labels.

Only the model is fitted on a bounded sample (``sample`` documents of each label, by hash of the id); the lexicon
entries and weights that go to the tasks are bounded as well. Every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantseek.common import top_k
from grantseek.llm.textbytes import U64, SpanHash, freed, signed, slabs, text_bytes

SAMPLE = 3000  # labelled documents of each label that the model is fitted on
ENTRIES = 300  # lexicon entries
SURPRISE = 9.0  # log rate times root of toxic documents that an entry needs; chance terms of some thousand reach 7
STEMS = (4, 5, 6, 7)  # bytes of a word's beginning that may be an entry
FOLDS = 5
ROUNDS = 30
PART = 1 << 18  # bytes of text that a task of `without_toxic` scores at once (or one longer text)

# Common insults that vote from the start, whatever the sample holds (fixed list); their accuracy is estimated like any other's.
INSULTS = ("clown", "coward", "creep", "disgusting", "dumb", "fool", "freak", "garbage", "idiot", "imbecile", "jerk", "liar", "loser", "moron",
           "pathetic", "pig", "scum", "stupid", "trash", "ugly", "vermin", "worthless")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def fold(id_col: str = "doc_id") -> Column:
    """Remainder that sets held-out rows apart: they are those with 0."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))


def _lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the two-byte capitals of Western European languages in lower case."""
    out = data.copy()
    out[_UPPER[out]] += 32
    if len(out) > 1:
        tail = out[1:]
        tail[(data[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] += 32
    return out


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of letters."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    start = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1] | edge[1:-1])))
    end = np.flatnonzero(inside & np.concatenate((~inside[1:] | edge[1:-1], [True]))) + 1
    return start, end, np.searchsorted(bounds, start, "right") - 1


def _terms(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, hash, start, end) of all words, then of all word beginnings of each length in STEMS."""
    start, end, row = _words(data, bounds)
    spans = SpanHash(_lowered(data))
    yield row, spans(start, end), start, end
    for size in STEMS:
        longer = end - start > size
        s, r = start[longer], row[longer]
        yield r, spans(s, s + size) ^ U64(0x57E4), s, s + size


def _shape(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each row: words, share of capitals among ASCII letters, exclamation marks a word."""
    rows = len(bounds) - 1
    start, _, row = _words(data, bounds)
    words = np.bincount(row, minlength=rows).astype(float)

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask)))
        return (sums[bounds[1:]] - sums[bounds[:-1]]).astype(float)
    capitals = count(_UPPER[data])
    letters = count(_LETTER[data] & (data < 128))
    return np.stack([words, capitals / np.maximum(letters, 1), count(data == 33) / np.maximum(words, 1)], axis=1)


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of each document with their spelling."""
    for batch in batches:
        data, bounds = text_bytes(batch.column(1))
        for a, b in slabs(bounds):
            part = bounds[a: b + 1] - bounds[a]
            text = data[bounds[a]: bounds[b]]
            low = _lowered(text).tobytes()
            for row, h, start, end in _terms(text, part):
                _, at = np.unique(h ^ (row.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)
                stem = [1 if end[i] < len(low) and _LETTER[low[end[i]]] else 0 for i in at]
                spelled = [low[start[i]: end[i]].decode("utf-8", "replace") for i in at]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[at] + a)), pa.array(signed(h[at])), pa.array(spelled, pa.string()), pa.array(stem, pa.int32())],
                    ["toxic", "term", "spelled", "stem"])


def lexicon(rows: DataFrame, entries: int = ENTRIES) -> list[tuple[int, str, bool]]:
    """(hash, spelling, is a beginning) of the terms that tell toxic rows (toxic, text) best; at most ``entries``."""
    totals = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    bad, good = totals["t"] or 0, (totals["n"] or 0) - (totals["t"] or 0)
    if not bad or not good:
        return []
    terms = rows.select(F.col("toxic").cast("int"), "text").mapInArrow(_document_terms, "toxic int, term long, spelled string, stem int")
    counted = terms.groupBy("term").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"), F.min("spelled").alias("spelled"), F.max("stem").alias("stem"))
    rate = ((F.col("t") + 0.5) / (bad + 1)) / ((F.col("n") - F.col("t") + 0.5) / (good + 1))
    surprise = F.log(rate) * F.sqrt("t")
    kept = counted.where((F.col("t") >= max(3, bad // 50)) & (rate >= 8) & (surprise >= SURPRISE)).orderBy(F.desc(surprise), "term").limit(entries)
    return [(r["term"], r["spelled"], bool(r["stem"])) for r in kept.collect()]


def _entry(word: str) -> tuple[int, str, bool]:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(signed(SpanHash(data)(np.array([0]), np.array([len(data)])))[0]), word, False


def _features(entries: np.ndarray):
    """Task function: (key..., text) to (key..., hits by entry as a list of positions and counts, shape)."""
    order = np.argsort(entries)
    ranked = entries[order]

    def rows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """hits (rows x entries), how many words hold an entry, shape."""
        n = len(bounds) - 1
        hits = np.zeros((n, len(entries)), np.float32)
        touched = np.zeros(n)
        if len(entries):
            marks = []
            for row, h, start, _ in _terms(data, bounds):
                at = np.minimum(np.searchsorted(ranked, h), len(ranked) - 1)
                found = ranked[at] == h
                np.add.at(hits, (row[found], order[at[found]]), 1)
                marks.append(np.stack([row[found], start[found]]))
            marks = np.unique(np.concatenate(marks, axis=1), axis=1)  # a word and its beginnings are one word
            touched = np.bincount(marks[0].astype(np.int64), minlength=n).astype(float)
        return hits, touched, _shape(data, bounds)
    return rows


def _design(hits: np.ndarray, touched: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Inputs of the linear classifier."""
    words = np.maximum(shape[:, 0], 1)
    return np.column_stack([
        np.log1p(hits), np.log1p(touched), np.minimum(touched, 1), np.minimum(touched, 3) / 3, np.log1p(100 * touched / words),
        shape[:, 1], np.minimum(shape[:, 2], 3), np.log1p(words) / 10])


def _votes(hits: np.ndarray, touched: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """1 toxic, -1 clean, 0 abstains; a column for each voter."""
    def vote(yes: np.ndarray, no: np.ndarray | None = None) -> np.ndarray:
        return yes.astype(np.int8) - (np.zeros(len(yes), np.int8) if no is None else no.astype(np.int8))
    density = touched / np.maximum(shape[:, 0], 1)
    patterns = [vote(touched >= 1, touched == 0), vote(touched >= 2, touched == 0), vote(touched >= 4, touched == 0),
                vote(density > 0.005, density < 0.0005), vote(density > 0.02, density == 0),
                vote((shape[:, 1] > 0.5) & (touched > 0)), vote((shape[:, 2] > 0.3) & (touched > 0)),
                vote(np.zeros(len(hits), bool), (shape[:, 0] >= 30) & (touched == 0))]
    return np.column_stack([(hits > 0).astype(np.int8), *patterns])


@dataclass
class LabelModel:
    """Vote probabilities by class, and what share of a voice each voter keeps."""

    log_odds: np.ndarray  # voters x (clean, abstain, toxic): log P(vote | toxic) / P(vote | clean)
    voice: np.ndarray
    prior: float

    @classmethod
    def fit(cls, votes: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, trust: float = 0.95) -> LabelModel:
        """votes: rows x voters. labels: what people said; a voter that is right with probability ``trust``."""
        n, m = votes.shape
        said = np.where(labels == 1, 1, -1) * np.log(trust / (1 - trust))
        q = np.where(labels == 1, trust, 1 - trust)
        onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
        voice, prior = np.ones(m), 0.5
        for turn in range(rounds):
            p = [(np.einsum("n,nmv->mv", w, onehot) + 1) / (w.sum() + 3) for w in (q, 1 - q)]
            log_odds = np.log(p[0]) - np.log(p[1])
            prior = float(np.clip(q.mean(), 0.01, 0.99))
            if turn % 5 == 4 and m > 1:  # what goes together beyond the class shares a voice
                mean = [(w @ votes) / max(w.sum(), 1e-9) for w in (q, 1 - q)]
                rest = votes - q[:, None] * mean[0] - (1 - q)[:, None] * mean[1]
                norm = np.sqrt((rest ** 2).sum(axis=0)) + 1e-9
                together = np.clip((rest.T @ rest) / np.outer(norm, norm), 0, 1)
                np.fill_diagonal(together, 1)
                voice = 1 / together.sum(axis=1)
            model = cls(log_odds, voice, prior)
            now = _sigmoid(model.score(votes) + said)
            if np.abs(now - q).max() < 1e-4 and turn > 5:
                break
            q = now
        return model

    def score(self, votes: np.ndarray) -> np.ndarray:
        """Log odds of toxic."""
        picked = np.take_along_axis(self.log_odds[None], (votes.astype(np.int64) + 1)[:, :, None], axis=2)[:, :, 0]
        return picked @ self.voice + np.log(self.prior / (1 - self.prior))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Classifier:
    entries: list[tuple[int, str, bool]]
    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        hashes = np.array([e[0] for e in self.entries], np.int64).view(U64)
        return _sigmoid(_design(*_features(hashes)(data, bounds)).astype(float) @ self.weights + self.bias)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3, steps: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method; y are probabilities."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(z @ w)
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Classifier:
    """Fit on labelled rows outside the held-out fold: ``sample`` of label 1 and ``sample`` of label 0, the smallest by hash of the id.

    Rows are weighted back to the shares of the labels among all labelled rows outside the fold. With no
    label of a kind the score is constant.
    """
    known = (labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("toxic"))
             .where("_id is not null and toxic in (0, 1)").where(fold("_id") != 0).dropDuplicates(["_id"]))
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    constant = Classifier([], np.zeros(_design(np.zeros((1, 0)), np.zeros(1), np.zeros((1, 3))).shape[1]), 40.0 if shares.get(1) and not shares.get(0) else -40.0)
    if len(shares) < 2:
        return constant
    chosen = top_k(known, ["toxic"], [F.xxhash64("_id"), F.col("_id")], sample, salts=16).select("_id", "toxic")
    rows = (docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
            .select("toxic", "text", F.pmod(F.xxhash64(F.lit(1), "_id"), F.lit(2)).cast("int").alias("half")))  # chosen: at most 2 * sample rows
    entries = lexicon(rows.where("half = 0").select("toxic", "text"))
    known_words = {e[0] for e in entries}
    entries += [e for e in map(_entry, INSULTS) if e[0] not in known_words]
    hashes = np.array([e[0] for e in entries], np.int64).view(U64)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _features(hashes)
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            for a, b in slabs(bounds):
                hits, touched, shape = count(data[bounds[a]: bounds[b]], bounds[a: b + 1] - bounds[a])
                for i in range(b - a):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(a + i, 1), batch.column(2).slice(a + i, 1), pa.array([np.flatnonzero(hits[i]).tolist()], pa.list_(pa.int32())),
                         pa.array([hits[i][hits[i] > 0].tolist()], pa.list_(pa.float32())), pa.array([[touched[i], *shape[i]]], pa.list_(pa.float64()))],
                        ["toxic", "half", "at", "hits", "rest"])
    measured = rows.mapInArrow(measure, "toxic int, half int, at array<int>, hits array<float>, rest array<double>").collect()  # bounded by the sample
    if {r["toxic"] for r in measured} != {0, 1}:  # labels of documents that aren't there
        return constant
    other = [r for r in measured if r["half"] == 1]
    measured = other if {r["toxic"] for r in other} == {0, 1} else measured
    y = np.array([r["toxic"] for r in measured])
    hits = np.zeros((len(y), len(entries)), np.float32)
    for i, r in enumerate(measured):
        hits[i, r["at"]] = r["hits"]
    rest = np.array([r["rest"] for r in measured]).reshape(len(y), 4)
    touched, shape = rest[:, 0], rest[:, 1:]
    model = LabelModel.fit(_votes(hits, touched, shape), y)
    said = np.where(y == 1, 1, -1) * np.log(0.95 / 0.05)
    posterior = _sigmoid(model.score(_votes(hits, touched, shape)) + said)
    found = np.array([(y == v).sum() for v in (0, 1)])
    weight = np.array([shares[v] / total * len(y) / max(1, found[v]) for v in (0, 1)])[y]
    weights, bias = _logistic(_design(hits, touched, shape).astype(float), posterior, weight)
    return Classifier(entries, weights, bias)


def scored(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score (0 to 1), predicted of every whole text. Null and empty texts get the score of a text without words.

    Every row gives a row; without an id, held_out is null. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            for a, b in slabs(bounds):
                score = classifier.score(data[bounds[a]: bounds[b]], bounds[a: b + 1] - bounds[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score)], ["id", "score"])
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), (fold("id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``scored`` with a classifier that ``train`` fits on the labels."""
    return scored(docs, train(docs, labels, sample, id_col, text_col), id_col, text_col)


def without_toxic(docs: DataFrame, classifier: Classifier, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns. The decision is taken where a text is read, nothing is joined."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            data, bounds = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            for a, b in slabs(bounds, PART):
                score = classifier.score(data[bounds[a]: bounds[b]], bounds[a: b + 1] - bounds[a])
                yield batch.slice(a, b - a).filter(pa.array(score < threshold))
    return docs.mapInArrow(run, docs.schema)
