"""N-gram Jaccard join: universe-partition pigeonhole with cost-based allocation, verified exactly.

Two sets link when ``100 * |x & y| >= percent * |x | y|``; then their symmetric difference is at most
``(|x| + |y|) * (100 - percent) / (100 + percent)``. Sizes fall into bands. All sets that may link with a
smaller one of band b are cut, by hash of the shingle, into the same segments. With a difference of at
most H spread over the segments, some segment is

* equal in both sets, if there are H + 1 segments (plan ``exact``), or
* equal up to one shingle, if there are (H + 1) / 2 (plan ``deep``: the segment and its one-deletion neighbours).

A cost model picks the plan of a band: keys to shuffle plus collisions expected among all documents. A few
segments more than needed are made, so a set may leave out its segments of next to no shingles, whose
keys would collide most. The choice depends on the segment's content alone, so equal segments of two sets
are left out by both. (Deep plans leave nothing out: there a segment may meet one that is a shingle shorter.)

A key's sets are not paired with each other. Each is verified against a pivot of the key (its smallest id), and what it
differs in from the pivot is kept: its *delta*. Two sets of the key differ in exactly what their deltas differ in, and if
both link with the pivot they are in one component anyway. Sets that meet others for a passage only, and hold more shingles of their
own than any link allows, leave before pivots are chosen. So what is left to find are sets that do not link with the pivot but
with another set of its group. Shingles that only one delta of the group holds count as differences
with everybody: a set with more of them than a link allows leaves the group first. The others are looked up by the rarest shingles of their
deltas (enough of them that two sets that link share one), then verified on the deltas. No link is missed.

Links between two sets that both link with a pivot of theirs change no component. They are counted without a row for each: the
sets of a pivot are dealt into blocks, two blocks at a time are compared in a task, and only the count of each set leaves it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantseek.llm.bitmap import Bitmap, hashed, likely
from grantseek.llm.graph import components
from grantseek.llm.scratch import Scratch, free_name, named, shuffles_freed
from grantseek.llm.textbytes import U64, SpanHash, freed, mix, signed, slabs, text_bytes, words

BAND_RATIO = 1.2
PART = 1 << 18  # bytes of text whose shingles a task holds at once (or one longer text)
KEY_ROWS = 1000  # rows whose texts or keys a task holds at once
BLOCK = 256  # sets of a pivot that are compared with as many others at once, about
COLUMNS = 4096  # shingles a task compares them by at once
SHARED = 0.05  # chance that an unrelated set of the band shares a given shingle, in the cost model


class Plan:
    """Bands, segments and allocation for one threshold and number of documents."""

    def __init__(self, percent: int, documents: int, largest: int):
        low, rows = 1, []
        while low <= largest:
            high = max(low + 1, int(low * BAND_RATIO))  # sizes low .. high - 1
            reach = (high - 1) * 100 // percent  # the largest partner of such a set
            gap = (high - 1 + reach) * (100 - percent) // (100 + percent)
            deep = gap // 2 + 1
            skip, spare = self._spare(low, gap)

            def met(mean: float, skip: int) -> float:
                """Sets that share a key by chance: all shingles of a segment, whose number is Poisson and above ``skip``."""
                few = sum((mean * SHARED) ** x / math.factorial(x) for x in range(skip + 1)) * math.exp(-mean * SHARED)
                return documents * math.exp(-mean * (1 - SHARED)) * (1 - few)
            exact_cost = (gap + 1 + spare) * (1 + met(low / (gap + 1 + spare), skip))
            deep_cost = (deep + low) * (1 + (1 + low / deep) * met(low / deep, -1))
            if gap > 0 and deep_cost < exact_cost:
                rows.append((low, reach, gap, deep, True, -1, 0))
            else:
                rows.append((low, reach, gap, gap + 1 + spare, False, skip, spare))
            low = high
        self.low, self.reach, self.gap, self.segments, self.deep, self.skip, self.spare = (
            np.array(x) for x in zip(*(rows or [(1, 1, 0, 1, False, -1, 0)]), strict=True))
        self.steps = int((np.searchsorted(self.low, self.reach, "right") - 1 - np.arange(len(self.low))).max()) + 1

    @staticmethod
    def _spare(size: int, gap: int) -> tuple[int, int]:
        """Segments of up to so many shingles are left out, and so many more segments are made for it.

        Nearly every set shall have no more such segments than that; (-1, 0) if this would take too many.
        """
        for skip, most in ((2, 1 + gap // 16), (1, 1 + gap // 8), (0, 1 + gap // 3)):
            spare = 1
            while spare <= most:
                n = gap + 1 + spare
                mean, term, few = size / n, 1.0, 0.0
                for i in range(skip + 1):
                    few += n * np.exp(-mean) * term
                    term *= mean / (i + 1)
                if np.ceil(few + 3 * np.sqrt(few)) <= spare + 1:
                    return skip, spare
                spare += 1
        return -1, 0

    def keys(self, doc: np.ndarray, n: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of every signature. doc, h: row and hash of each distinct shingle; n: set sizes by row."""
        own = np.searchsorted(self.low, n, "right") - 1
        out = []
        for step in range(self.steps):  # as the smaller set, in its own band, and as a larger one, in those below
            band = own - step
            use = (n > 0) & (band >= 0)
            use &= (n <= self.reach[np.maximum(band, 0)]) & (self.gap[np.maximum(band, 0)] > 0)
            out.append(self._emit(doc, h, np.where(use, band, -1)))
        doc, key = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        first = np.ones(len(key), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
        return doc[first], key[first]

    def _emit(self, doc: np.ndarray, h: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = np.where(band >= 0, self.segments[np.maximum(band, 0)], 0)
        first = np.concatenate(([0], np.cumsum(count)))
        keep = band[doc] >= 0
        doc, h = doc[keep], h[keep]
        seg = first[doc] + (mix(h ^ U64(0x51ED)) % count[doc].astype(U64)).astype(np.int64)
        code = mix(h ^ U64(0xA11C))
        sums = np.zeros(first[-1], U64)
        np.add.at(sums, seg, code)
        size = np.bincount(seg, minlength=first[-1])
        row = np.repeat(np.arange(len(count)), count)
        tag = mix(band[row].astype(U64) * U64(1 << 20) + (np.arange(first[-1]) - first[row]).astype(U64))
        low = size <= np.where(band >= 0, self.skip[np.maximum(band, 0)], -1)[row]
        skip = np.bincount(row[low], minlength=len(count)) <= np.where(band >= 0, self.spare[np.maximum(band, 0)], 0)
        full = ~(low & skip[row])
        docs, keys = [row[full]], [mix(sums[full] ^ tag[full])]
        deep = self.deep[np.maximum(band, 0)][doc] & full[seg]
        docs.append(doc[deep])
        keys.append(mix((sums[seg[deep]] - code[deep]) ^ tag[seg[deep]]))
        return np.concatenate(docs), np.concatenate(keys)


def _shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, by row, then hash."""
    start, end, doc = words(data, bounds)
    if not len(start):
        return doc, np.zeros(0, U64)
    w = SpanHash(data, fold=True)(start, end)
    count = np.bincount(doc, minlength=len(bounds) - 1)
    size = np.minimum(count, k)  # a shorter text is one shingle
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    at = np.arange(len(w))
    whole = at + size[doc] <= first[doc] + count[doc]
    begin, owner = at[whole], doc[whole]
    h = size[owner].astype(U64)
    for j in range(k):
        part = np.where(j < size[owner], w[np.minimum(begin + j, len(w) - 1)], U64(0))
        h = mix(h * U64(0x9E3779B97F4A7C15) + part)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[new], h[new]


def _lists(doc: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
    offsets = np.searchsorted(doc, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(values)))


def _signatures(plan: Plan, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            data, bounds = text_bytes(batch.column(1))
            for a, b in slabs(bounds, PART):
                part = bounds[a: b + 1]
                doc, h = _shingle_sets(data[part[0]: part[-1]], part - part[0], k)
                n = np.bincount(doc, minlength=b - a)
                prints = []
                for salt in (0xF1, 0xF2):
                    total = np.zeros(b - a, U64)
                    np.add.at(total, doc, mix(h ^ U64(salt)))
                    prints.append(pa.array(signed(total)))
                key_doc, key = plan.keys(doc, n, h)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), *prints, _lists(key_doc, key, b - a)],
                    ["id", "n_shingles", "print1", "print2", "keys"])
    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            data, bounds = text_bytes(batch.column(1))
            for a, b in slabs(bounds, PART):
                part = bounds[a: b + 1]
                doc, h = _shingle_sets(data[part[0]: part[-1]], part - part[0], k)
                passed = [batch.column(c).slice(a, b - a) for c in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*passed, _lists(doc, h, b - a)], ["id", "pivots", "others", "items"])
    return run


def _shingles(k: int):
    """All shingles of the texts (id, text) of a batch, as hashes."""
    def run(batch: pa.RecordBatch) -> np.ndarray:
        data, bounds = text_bytes(batch.column(1))
        parts = [_shingle_sets(data[bounds[a]: bounds[b]], bounds[a: b + 1] - bounds[a], k)[1] for a, b in slabs(bounds, PART)]
        return np.concatenate([np.zeros(0, U64), *parts])
    return run


def _meeting(shared: Bitmap, percent: int, k: int):
    """Ids of the texts (id, text) with no more shingles of their own than a link allows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            data, bounds = text_bytes(batch.column(1))
            for a, b in slabs(bounds, PART):
                part = bounds[a: b + 1]
                doc, h = _shingle_sets(data[part[0]: part[-1]], part - part[0], k)
                n = np.bincount(doc, minlength=b - a)
                own = np.bincount(doc[~shared.hits(h)], minlength=b - a)
                reach = (n + n * 100 // percent) * (100 - percent) // (100 + percent)  # with the largest set that may link
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).filter(pa.array(own <= reach))], ["id"])
    return run


def may_link(pairs: DataFrame, texts: DataFrame, percent: int, k: int, scratch: Scratch) -> DataFrame:
    """The ids of the pairs (pivot, id) but for sets that can link with nobody: too many of their shingles are in no other set of a pair.

    Sets that share one passage meet under a key for it, in more and larger groups the more texts there are. Here they leave
    before they are compared; each set is read once, whatever the number of its pivots, and only hashes are shuffled.
    """
    wanted = scratch.write(pairs.select(F.explode(F.array("pivot", "id")).alias("id")).distinct())
    with shuffles_freed(pairs.sparkSession):
        members = Bitmap(wanted.select(F.xxhash64("id").alias("h")))
    found = likely(texts, "id", members)  # a few others besides: they can only keep a set
    with shuffles_freed(pairs.sparkSession, KEY_ROWS):
        hashes = hashed(found, _shingles(k), "h long")
        shared = Bitmap(hashes.groupBy("h").agg(F.count("*").alias("often")).where("often > 1").select("h"))
    kept = scratch.write(found.mapInArrow(_meeting(shared, percent, k), "id long"), KEY_ROWS)
    out = scratch.write(kept.join(wanted.hint("merge"), "id", "left_semi").distinct())
    shared.close()
    members.close()
    scratch.drop(wanted, kept)
    return out


def _gap(size, percent: int):
    """The largest symmetric difference of two sets that link, from the sum of their sizes."""
    return F.floor(size * (100 - percent) / (100 + percent))


def star_deltas(pairs: DataFrame, texts: DataFrame, percent: int, k: int, scratch: Scratch) -> DataFrame:
    """(pivot, id, n, delta, gone, linked) of the pairs (pivot, id); the first ``gone`` shingles of delta are the pivot's; null if the pivot has one pair only.

    Only texts of ids in a pair are moved: a bitmap keeps nearly all others back, the join the rest. A set carries
    its pivots along, so it is shuffled once for them. Neither side of the large joins is ever broadcast: both grow with the input.
    """
    of = pairs.groupBy("pivot").agg((F.count("*") > 1).alias("others"))  # a pivot with one other set has no pair to find
    marks = pairs.select("id", "pivot", F.lit(None).cast("boolean").alias("others")).unionByName(
        of.select(F.col("pivot").alias("id"), F.lit(None).cast("long").alias("pivot"), "others"))
    # a set has at most one pivot for each of its keys; others is null unless the set is a pivot itself
    wanted = scratch.write(marks.groupBy("id").agg(F.collect_list("pivot").alias("pivots"), F.max("others").alias("others")))
    with shuffles_freed(pairs.sparkSession):
        members = Bitmap(wanted.select(F.xxhash64("id").alias("h")))
    found = likely(texts, "id", members).join(wanted.hint("merge"), "id").select("id", "text", "pivots", "others")
    sets = scratch.write(found.mapInArrow(_sets(k), "id long, pivots array<long>, others boolean, items array<long>"), KEY_ROWS)
    members.close()
    stars = sets.where("others is not null").select(F.col("id").alias("pivot"), F.col("items").alias("x"), "others")
    both = sets.select("id", F.explode("pivots").alias("pivot"), F.col("items").alias("y")).join(stars.hint("merge"), "pivot")
    n, m = F.size("y").cast("long"), F.size("x").cast("long")
    linked = n + m - 2 * F.size(F.array_intersect("x", "y")) <= _gap(n + m, percent)
    delta = F.when(F.col("others"), F.concat(F.array_except("x", "y"), F.array_except("y", "x")))
    both = both.select("pivot", "id", n.alias("n"), m.alias("m"), delta.alias("delta"), linked.alias("linked"))
    gone = F.floor((F.size("delta") + F.col("m") - F.col("n")) / 2)
    out = scratch.write(both.select("pivot", "id", "n", "delta", gone.alias("gone"), "linked"))
    scratch.drop(sets, wanted)
    return out


def _kept_keys(met: Bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            keys = batch.column(1)
            values = keys.flatten().to_numpy()
            row = np.repeat(np.arange(len(keys)), np.diff(keys.offsets.to_numpy()))
            hit = met.hits(values.view(U64))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(row[hit], values[hit].view(U64), len(keys))], ["id", "keys"])
    return run


def _token_keys(batch: pa.RecordBatch, new: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Row, and hash with the pivot, of every shingle of the deltas (pivot, id, gone, delta ...), or of those only that the pivot lacks (``new``)."""
    lists = batch.column(3)
    sizes = lists.value_lengths().to_numpy()
    row = np.repeat(np.arange(batch.num_rows), sizes)
    shingles = lists.flatten().to_numpy().view(U64)
    if new:
        ours = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row] >= batch.column(2).to_numpy()[row]
        row, shingles = row[ours], shingles[ours]
    return row, mix(mix(batch.column(0).to_numpy().view(U64))[row] ^ shingles)


def _may_link(shared: Bitmap):
    """Deltas (pivot, id, gone, delta, reach ...) that hold no more than ``reach`` shingles that neither the pivot nor another delta of its group has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            row, key = _token_keys(batch, new=True)
            own = np.bincount(row[~shared.hits(key)], minlength=batch.num_rows)
            yield batch.filter(pa.array(own <= batch.column(4).to_numpy()))
    return run


def _met_tokens(met: Bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            row, key = _token_keys(batch)
            hit = np.flatnonzero(met.hits(key))
            place = hit - np.searchsorted(row, row[hit])
            row = row[hit]
            old = place < batch.column(2).to_numpy()[row]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), batch.column(3).flatten().take(pa.array(hit)),
                                              pa.array(old.astype(np.int64))], ["pivot", "id", "t", "old"])
    return run


def group_links(deltas: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): the links inside the pivots' groups of which one end does not link with the pivot."""
    n = F.col("n")
    reach = _gap(n + F.floor(n * 100 / percent), percent)  # with the largest set that may link
    deltas = deltas.where("delta is not null").select("pivot", "id", "gone", "delta", reach.alias("reach"), "n", "linked")
    lonely = scratch.write(deltas.where("not linked").select("pivot").distinct())
    lists = deltas.join(lonely, "pivot", "left_semi")

    def repeated(lists: DataFrame, new: bool) -> Bitmap:
        with shuffles_freed(lists.sparkSession, KEY_ROWS):
            keys = hashed(lists.select("pivot", "id", "gone", "delta"), lambda batch: _token_keys(batch, new)[1], "h long")
            return Bitmap(keys.groupBy("h").agg(F.count("*").alias("often")).where("often > 1").select("h"))
    # most sets meet a pivot for one passage that they share with it: what they hold besides stands alone and they leave here, before their shingles move
    met = repeated(lists, new=True)
    some = scratch.write(lists.mapInArrow(_may_link(met), lists.schema), KEY_ROWS)
    met.close()
    groups = scratch.write(some.groupBy("pivot").agg(F.count("*").alias("sets"), F.bool_and("linked").alias("linked")).where("sets > 1 and not linked").select("pivot"))
    scratch.drop(lonely)
    deltas = scratch.write(some.join(groups, "pivot", "left_semi"), KEY_ROWS)
    scratch.drop(some, groups)
    members = deltas.select("pivot", "id", "n", "linked", F.size("delta").cast("long").alias("d"), F.col("reach").alias("h"))
    lists = deltas.select("pivot", "id", "gone", "delta")
    # shingles that one delta of the group holds are kept back where they are; the bitmap lets few of them through
    met = repeated(lists, new=False)
    tokens = lists.mapInArrow(_met_tokens(met), "pivot long, id long, t long, old long")
    often = F.count("*").over(Window.partitionBy("pivot", "t"))
    common = scratch.write(tokens.withColumn("often", often).where("often > 1"), KEY_ROWS)
    met.close()
    held = common.groupBy("pivot", "id").agg(F.count("*").alias("c"), F.sum("old").alias("g"))
    viable = members.join(held, ["pivot", "id"]).where("d - c <= h").withColumn("need", F.greatest(F.lit(1), F.col("d") - F.col("h")))
    place = F.row_number().over(Window.partitionBy("pivot", "id").orderBy("often", "t"))
    prefix = (common.join(viable, ["pivot", "id"]).withColumn("place", place).where("place <= c - need + 1")
              .select("pivot", "t", "id", "n", "linked", "d", "c", "g", "place"))
    prefix = scratch.write(prefix)
    one, two = prefix.where("not linked").alias("x"), prefix.alias("y")
    apart = _gap(F.col("x.n") + F.col("y.n"), percent)
    least = F.expr("(x.d - x.c) + (y.d - y.c) + abs(x.g - y.g) + abs((x.c - x.g) - (y.c - y.g))")  # they differ in no fewer shingles
    most = F.expr("1 + least(x.c - x.place, y.c - y.place)")  # shared, if this is the first shared one in both orders
    found = one.join(two, (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.t") == F.col("y.t")) & F.expr("y.linked or x.id < y.id")
                   & (least <= apart) & (F.expr("x.d + y.d") - 2 * most <= apart))
    found = scratch.write(found.select(F.col("x.pivot").alias("pivot"), F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
    left = deltas.select("pivot", F.col("id").alias("a"), F.col("n").alias("n1"), F.col("delta").alias("x"))
    right = deltas.select("pivot", F.col("id").alias("b"), F.col("n").alias("n2"), F.col("delta").alias("y"))
    apart = F.size("x") + F.size("y") - 2 * F.size(F.array_intersect("x", "y"))
    out = found.join(left, ["pivot", "a"]).join(right, ["pivot", "b"]).where(apart <= _gap(F.col("n1") + F.col("n2"), percent)).select("a", "b")
    out = scratch.write(out)
    scratch.drop(deltas, common, prefix, found)
    return out


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values each of the sets ``x`` shares with each of the sets ``y``."""
    some, place = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    left, right = (np.repeat(np.arange(len(sets)), [len(v) for v in sets]) for sets in (x, y))
    here, there = place[: len(left)], place[len(left):]
    both = (np.bincount(here, minlength=len(some)) > 0) & (np.bincount(there, minlength=len(some)) > 0)
    column = np.cumsum(both) - 1
    out = np.zeros((len(x), len(y)), np.float32)
    left, here = left[both[here]], column[here[both[here]]]
    right, there = right[both[there]], column[there[both[there]]]
    for at in range(0, int(both.sum()), COLUMNS):
        parts = []
        for row, value, rows in ((left, here, len(x)), (right, there, len(y))):
            part = (value >= at) & (value < at + COLUMNS)
            parts.append(np.zeros((rows, COLUMNS), np.float32))
            parts[-1][row[part], value[part] - at] = 1
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _near(pivot: int, same: bool, first: np.ndarray, ids: np.ndarray, n: np.ndarray, deltas: list[np.ndarray], stars: list[np.ndarray],
          percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, links) of two blocks of a pivot's sets; ``first``: those of the first block. A pair counts with the smallest pivot that both link with."""
    x, y = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(first), np.flatnonzero(~first))
    d = np.array([len(v) for v in deltas])

    def pick(lists, rows):
        return [lists[i] for i in rows]
    apart = d[x][:, None] + d[y] - 2 * _shared(pick(deltas, x), pick(deltas, y))
    near = apart * (100 + percent) <= (n[x][:, None] + n[y]) * (100 - percent)
    near &= ids[x][:, None] < ids[y] if same else ids[x][:, None] != ids[y]
    if max(map(len, stars)) > 1:
        for rows, others, known in ((x, y, near), (y, x, near.T)):  # one is the other's pivot: that link is a row already
            row = np.repeat(np.arange(len(rows)), [len(stars[i]) for i in rows])
            value = np.concatenate(pick(stars, rows))
            place = np.minimum(np.searchsorted(ids[others], value), len(others) - 1)  # ids ascend
            hit = ids[others][place] == value
            known[row[hit], place[hit]] = False
        earlier = [v[v < pivot] for v in stars]
        near &= _shared(pick(earlier, x), pick(earlier, y)) == 0
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, x, near.sum(1))
    np.add.at(links, y, near.sum(0))
    return ids, links


def _block_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
            pivot, low, high, at, ids, n = (table.column(c).to_numpy() for c in range(6))
            lists = []
            for c in (6, 7):
                column = table.column(c).combine_chunks()
                flat, offsets = column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
                lists.append((flat, offsets))
            out_ids, out_links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                rows = a + np.unique(ids[a:b], return_index=True)[1]  # copies of a row are one set
                if len(rows) < 2 or (low[a] != high[a] and len(set(at[rows])) < 2):
                    continue
                deltas, stars = ([flat[o[i]: o[i + 1]] for i in rows] for flat, o in lists)
                found, links = _near(int(pivot[a]), bool(low[a] == high[a]), at[rows] == low[a], ids[rows], n[rows], deltas, stars, percent)
                out_ids.append(found[links > 0])
                out_links.append(links[links > 0])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_ids)), pa.array(np.concatenate(out_links))], ["id", "links"])

        held: pa.Table | None = None  # the last two blocks, until all their sets are here
        for batch in freed(batches):
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            keys = [table.column(c).to_numpy() for c in range(3)]
            new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            if len(new):
                yield counted(table.slice(0, new[-1]), np.concatenate(([0], new)))
            held = table.slice(new[-1] if len(new) else 0)
        if held is not None:
            yield counted(held, np.array([0, held.num_rows]))
    return run


def link_counts(deltas: DataFrame, inside: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(rep, links): how many other sets each set links with; ``inside``: what ``group_links`` found. Sets without a link have no row.

    Every pair that links shares a pivot or one is the other's. Pairs that both link with a pivot are counted in blocks, with the smallest
    such pivot only; all others are rows of ``inside`` or of the pivots.
    """
    linked = deltas.where("linked")
    own = scratch.write(linked.groupBy("id").agg(F.collect_set("pivot").alias("stars")))  # at most a pivot for each key of the set
    sizes = linked.where("delta is not null").groupBy("pivot").agg(F.count("*").alias("sets")).where("sets > 1")
    rows = linked.where("delta is not null").join(sizes.hint("merge"), "pivot").join(own.hint("merge"), "id")
    blocks = F.ceil(F.col("sets") / BLOCK)
    rows = rows.withColumn("at", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select("pivot", F.least("at", "other").alias("low"), F.greatest("at", "other").alias("high"), "at", "id", "n", "delta", "stars")
    rows = rows.repartition("pivot", "low", "high").sortWithinPartitions("pivot", "low", "high")
    near = scratch.write(rows.mapInArrow(_block_links(percent), "id long, links long"), KEY_ROWS)
    left, right = own.select(F.col("id").alias("a"), F.col("stars").alias("x")), own.select(F.col("id").alias("b"), F.col("stars").alias("y"))
    other = inside.join(left, "a", "left").join(right, "b", "left").where("not coalesce(arrays_overlap(x, y), false)").select("a", "b")
    rows = linked.select(F.col("pivot").alias("a"), F.col("id").alias("b")).unionByName(other)
    rows = rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = rows.select(F.explode(F.array("a", "b")).alias("rep"), F.lit(1).cast("long").alias("links"))
    out = scratch.write(ends.unionAll(near.select(F.col("id"), "links")).groupBy("rep").agg(F.sum("links").alias("links")))
    scratch.drop(own, near)
    return out


def jaccard_components(
    docs: DataFrame, percent: int = 90, k: int = 3, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True,
) -> DataFrame:
    """One row per document: ``id_col``, n_shingles (size of its set), component_id, links (unless not ``count_links``).

    component_id is the smallest id that can be reached over links; ``links`` counts all other sets that
    link with the document's (copies of one set count as one). Null or blank text: no shingles, its own component. Copies of a
    set are one set here (a 128-bit sum of its shingles tells them), however many there are. Rows without
    an id take no part; an id on several rows is one node. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, lean=True)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    facts = texts.agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("longest")).first()
    plan = Plan(percent, max(1, facts["n"]), (facts["longest"] or 0) // 2 + 1)
    signed_sets = scratch.write(texts.mapInArrow(
        _signatures(plan, k), "id long, n_shingles long, print1 long, print2 long, keys array<long>"), KEY_ROWS)
    members = scratch.write(signed_sets.drop("keys"))
    classes = scratch.write(members.where("n_shingles > 0").groupBy("print1", "print2").agg(F.min("id").alias("rep")))
    # keys that come once are kept back where they are; the bitmap lets few of them through
    often = signed_sets.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    with shuffles_freed(spark):
        repeated = Bitmap(often)
    shared = signed_sets.select("id", "keys").mapInArrow(_kept_keys(repeated), "id long, keys array<long>").where("size(keys) > 0")
    shared = scratch.write(shared.join(classes.select(F.col("rep").alias("id")).hint("merge"), "id", "left_semi"), KEY_ROWS)
    repeated.close()
    scratch.drop(signed_sets)

    def met(shared: DataFrame) -> DataFrame:
        """(pivot, id): every set with the smallest id of each of its keys."""
        keyed = shared.select(F.explode("keys").alias("key"), "id")
        pivots = keyed.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last")
        return scratch.write(keyed.join(pivots.select("key", "pivot").hint("merge"), "key").where("id <> pivot").select("pivot", "id").distinct())
    first = met(shared)
    able = may_link(first, texts, percent, k, scratch)
    pairs = met(shared.join(able.hint("merge"), "id", "left_semi"))  # pivots anew: those that link with nobody are none
    scratch.drop(shared, first, able)
    deltas = star_deltas(pairs, texts, percent, k, scratch)
    inside = group_links(deltas, percent, scratch)
    links = deltas.where("linked").select(F.col("pivot").alias("a"), F.col("id").alias("b")).unionByName(inside)
    links = scratch.write(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    parts = components(links, scratch).withColumnRenamed("node", "rep")
    placed = classes.join(parts, "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    if count_links:
        placed = placed.join(link_counts(deltas, inside, percent, scratch), "rep", "left").withColumn("links", F.coalesce("links", F.lit(0).cast("long")))
    counts = ["links"] if count_links else []
    scratch.drop(pairs, deltas, inside)
    out = members.join(placed.select("print1", "print2", "component_id", *counts), ["print1", "print2"], "left")
    return out.select(F.col("id").alias(id_col), "n_shingles",
                      F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
                      *[F.when(F.col("n_shingles") > 0, F.col(c)).otherwise(F.lit(0).cast("long")).alias(c) for c in counts])


def drop_near_duplicates(docs: DataFrame, percent: int, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, all columns: that of the smallest id, without an id only if none has one.

    Rows are decided on, not ids: each (id, text) is a node, so that a text of its own stays whatever else bears its id, and
    rows without an id are compared like others. Of repeated rows of one id and text one stays. Rows that a bitmap of the
    dropped and repeated nodes doesn't hold go straight through; the few others are joined. Two different (id, text) share a node
    with a chance of one in 2**64 a pair.
    """
    scratch = Scratch(docs.sparkSession, lean=True)
    column = free_name("node", docs.columns)
    node = F.xxhash64(named(id_col).cast("long"), named(text_col))
    parts = jaccard_components(docs.select(node.alias("id"), named(text_col).alias("text")), percent, k, "id", "text", count_links=False)
    parts = scratch.write(parts.select(F.col("id").alias("node"), F.col("component_id").alias("part")).distinct())
    shared = scratch.write(parts.where("node <> part").select("part").distinct())
    parts = parts.join(shared.hint("merge"), "part", "left_semi")
    rows = docs.select(node.alias("node"), named(id_col).cast("long").alias("id")).groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
    rows = scratch.write(rows.join(parts, "node", "left").where("part is not null or rows > 1"))
    first = rows.where("part is not null").groupBy("part").agg(F.min(F.struct(F.col("id").isNull().alias("without"), "id", "node")).alias("first"))
    dropped = scratch.write(rows.join(first, "part").where(F.col("node") != F.col("first.node")).select(F.col("node").alias("dropped")))
    doubt = dropped.select(F.col("dropped").alias("node")).unionByName(rows.where("rows > 1").select("node")).distinct()
    members = Bitmap(doubt.select(F.xxhash64("node").alias("h")))
    whole = docs.withColumn(column, node)
    doubtful = likely(whole, column, members).join(dropped.hint("merge"), F.col(column) == F.col("dropped"), "left_anti").dropDuplicates([column])
    return likely(whole, column, members, wanted=False).unionByName(doubtful).drop(column)
