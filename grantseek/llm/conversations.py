"""Repair of conversations by the cheapest edits of their turns.

What is left has to read as an optional system turn and then user and assistant in turn, ending with the assistant, or be empty:
initials ``(s?(ua)+)?``. Keep costs 0, Rerole to user or assistant 2, Delete 3, Insert of an empty user or assistant turn 2; a truncated
turn that stays costs 1 more; blank and repeated turns have to go. Of the cheapest edits those whose initials are least in ASCII are
taken.

The turns read so far matter by one of four states only, so the cost of the best end of a conversation is a vector of four.
These vectors are kept at checkpoints alone, about the square root of the conversation apart. Between two of
them stands a piece: a matrix of costs from state to state says what it adds, and matrices are folded from the end of the conversation
to its beginning. Then each piece computes its own vectors again from the checkpoint behind it and walks forward, from each of the
four states that it may be entered in; which one it is follows from the pieces before it. So a task holds one piece of a conversation, never
the whole, and the pieces of one conversation are worked on side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantseek.llm.scratch import Scratch

START, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, or what the last turn is
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = (USER, USER, ASSISTANT, USER)  # the state that an inserted or changed turn leads to
LETTER = ("", "s", "u", "a")
NAMES = {"u": "user", "a": "assistant"}
BLANK, REPEATED, TRUNCATED = 1, 2, 3
CLOSING = (0, 4, 2, 0)  # cost of the turns inserted at the end
TAILS = ("", "IuIa", "Ia", "")
FAR = 1 << 50
PIECE = 64  # turns of a piece at least
SPACE = " \t\n\x0b\x0c\r"

Vector = tuple[int, int, int, int]


def before(turn: tuple[str, int], v: Vector) -> Vector:
    """Least cost to the end from each state before a turn, given that after it. ``turn``: initial of the role, and fault."""
    initial, fault = turn
    b = [3 + x for x in v]
    if fault not in (BLANK, REPEATED):
        stays = 1 if fault == TRUNCATED else 0
        for q in range(4):
            b[q] = min(b[q], 2 + stays + v[NEXT[q]])
        for q, to in AFTER.get(initial, {}).items():
            b[q] = min(b[q], stays + v[to])
    user, assistant = min(b[USER], 2 + b[ASSISTANT]), min(b[ASSISTANT], 2 + b[USER])
    return min(b[START], 2 + user), min(b[SYSTEM], 2 + user), user, assistant


def matrix(turns: list[tuple[str, int]]) -> list[Vector]:
    """For each state after the last turn the least costs to reach it from each state before the first."""
    out = []
    for to in range(4):
        v: Vector = tuple(0 if q == to else FAR for q in range(4))
        for turn in reversed(turns):
            v = before(turn, v)
        out.append(v)
    return out


def fold(costs: list[Vector], v: Vector) -> Vector:
    """Least cost from each state before a piece, given that after it."""
    return tuple(min(costs[to][q] + v[to] for to in range(4)) for q in range(4))


def walk(turns: list[tuple[str, int]], v: Vector) -> list[tuple[list[str], int]]:
    """For each state before a piece: the edits of each turn and the state after the last, given the costs behind the piece.

    Edits are pairs of letters: Iu, Ia insert, Ru, Ra change the role, K- keeps, D- deletes; those inserted before a turn come first.
    """
    costs = [v]
    for turn in reversed(turns):
        costs.append(before(turn, costs[-1]))
    costs.reverse()
    out = []
    for q in range(4):
        edits = []
        for i, (initial, fault) in enumerate(turns):
            here, behind, done, stays = costs[i], costs[i + 1], "", 1 if fault == TRUNCATED else 0
            may_stay, kept = fault not in (BLANK, REPEATED), AFTER.get(initial, {})
            while True:  # the least letter first: D, I, K, R
                if here[q] == 3 + behind[q]:
                    done += "D-"
                    break
                if here[q] == 2 + here[NEXT[q]]:
                    q = NEXT[q]
                    done += f"I{LETTER[q]}"
                    continue
                if may_stay and q in kept and here[q] == stays + behind[kept[q]]:
                    q = kept[q]
                    done += "K-"
                    break
                q = NEXT[q]
                done += f"R{LETTER[q]}"
                break
            edits.append(done)
        out.append((edits, q))
    return out


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for a in range(0, batch.num_rows, 2000):
            yield from zip(*(c.to_pylist() for c in batch.slice(a, 2000).columns), strict=True)


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _in_order(rows: DataFrame, keys: list[str], order: list[Column], make, fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """``make`` over the rows of each task as one stream, sorted by ``keys`` and ``order``; rows of equal keys meet in a task."""
    schema = pa.schema([(name, kind) for name, _, kind in fields])
    ddl = ", ".join(f"`{name}` {sql}" for name, sql, _ in fields)
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInArrow(lambda batches: _batches(make(_stream(batches)), schema), ddl)


LONG, INT, TEXT = ("bigint", pa.int64()), ("int", pa.int32()), ("string", pa.string())
LONGS, TEXTS, INTS = ("array<bigint>", pa.list_(pa.int64())), ("array<string>", pa.list_(pa.string())), ("array<int>", pa.list_(pa.int32()))
KEY = ["turn", "role", "h1", "h2"]


def _turns(table: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, h1, h2 (print of role and text), text; missing roles and texts are one space."""
    named = table.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"),
                         F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    return named.select("conv", "turn", "role", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(20240917), "text", "role").alias("h2"), "text")


class Repair:
    """Cheapest edits of every conversation in a table; computed when made and kept in the checkpoint folder.

    Turns are taken by number, missing numbers first; turns of one number by role and then by a hash of role and text. A missing
    role or text counts as one space. Rows without a conversation are one conversation. A turn repeats another if an earlier one
    has the same role and text, up to 128 bits of hash. Extra columns are not read.
    """

    def __init__(self, table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece: int = PIECE):
        self.scratch = Scratch(table.sparkSession)
        self.turns = _turns(table, conv, turn, role, text)
        self._conv = conv
        marked = self._marked(piece)
        pieces = self._checkpoints(marked)
        walked = self._walked(marked, pieces)
        chained = self._entered(pieces, walked)
        entry = chained.select(F.col("conv").alias("c"), F.col("piece").alias("p"), "entry")
        #: conv, the key of a turn, its place in the table, its edits
        self.edits = self.scratch.write(
            walked.where("edits is not null").join(entry, F.col("conv").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p"))).select(
                "conv", *KEY, "at", F.element_at("edits", F.col("entry") + 1).alias("edits")))
        counts = ("blank", "duplicate", "truncated")
        totals = chained.groupBy("conv").agg(
            *[F.sum(c).alias(c) for c in counts], F.sum(F.col("illegal") + F.col("joint")).alias("illegal"),
            F.max("cost").alias("cost"), F.max("tail").alias("tail"))
        self.totals = self.scratch.write(totals)
        self.scratch.drop(marked, pieces, walked, chained)

    def _marked(self, piece: int) -> DataFrame:
        """Every turn without its text: place in the table, fault, piece."""
        bare = F.rtrim("text", F.lit(SPACE))
        facts = self.turns.select(
            "conv", *KEY, F.substring("role", 1, 1).alias("initial"),
            F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0).alias("fault"))
        order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("h1"), F.asc("h2")]
        # Ranges of (conversation, turn ...): a very long conversation lies in many of them.
        ordered = self.scratch.write(facts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
        by_number = ordered.groupBy("conv", "turn").agg(F.count("*").alias("n"))
        self.sizes = self.scratch.write(by_number.groupBy("conv").agg(
            F.sum("n").alias("n"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")))
        width = self.sizes.select(F.col("conv").alias("c"), F.greatest(F.lit(piece), F.ceil(F.sqrt("n"))).alias("width"))
        twice = ordered.groupBy("conv", "role", "h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
        twice = twice.select(F.col("conv").alias("c2"), F.col("role").alias("r2"), F.col("h1").alias("a2"), F.col("h2").alias("b2"), "first")
        rows = ordered.join(width, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
        rows = rows.join(twice, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("role") == F.col("r2")) & (F.col("h1") == F.col("a2")) & (F.col("h2") == F.col("b2")), "left")
        repeated = (F.col("fault") != BLANK) & F.col("first").isNotNull() & (F.col("at") != F.col("first"))
        marked = self.scratch.write(rows.select("conv", F.floor(F.col("at") / F.col("width")).alias("piece"), "at", *KEY, "initial",
                                                F.when(repeated, REPEATED).otherwise(F.col("fault")).alias("fault")))
        self.scratch.drop(ordered)
        return marked

    def _checkpoints(self, marked: DataFrame) -> DataFrame:
        """Each piece with its counts and the cost vector behind it."""
        def measure(rows):
            for (conv, piece), group in groupby(rows, itemgetter(0, 1)):
                turns = [(r[3], r[4]) for r in group]
                faults = [t[1] for t in turns]
                pairs = [a[0] + b[0] for a, b in zip(turns, turns[1:], strict=False)]
                yield (conv, piece, *map(faults.count, (BLANK, REPEATED, TRUNCATED)), sum(p not in ("su", "ua", "au") for p in pairs),
                       turns[0][0], turns[-1][0], [x for v in matrix(turns) for x in v])
        fields = [("conv", *LONG), ("piece", *LONG), ("blank", *LONG), ("duplicate", *LONG), ("truncated", *LONG), ("illegal", *LONG),
                  ("first", *TEXT), ("last", *TEXT)]
        rows = marked.select("conv", "piece", "at", "initial", "fault")
        measured = _in_order(rows, ["conv", "piece"], [F.asc("at")], measure, [*fields, ("costs", *LONGS)])

        def back(rows):
            conv, v = object(), CLOSING
            for row in rows:
                if row[0] != conv:
                    conv, v = row[0], CLOSING
                costs, behind = row[-1], v
                v = fold([tuple(costs[k: k + 4]) for k in range(0, 16, 4)], v)
                yield *row[:-1], list(behind), v[START]
        # From the last piece of a conversation to its first; one vector is held.
        return self.scratch.write(_in_order(measured, ["conv"], [F.desc("piece")], back, [*fields, ("behind", *LONGS), ("cost", *LONG)]))

    def _walked(self, marked: DataFrame, pieces: DataFrame) -> DataFrame:
        """Edits of each turn for every state that its piece may be entered in, and a row for each piece with the states behind it."""
        rows = marked.unionByName(pieces.select("conv", "piece", "behind"), allowMissingColumns=True)
        columns = ["conv", "piece", "at", *KEY, "initial", "fault", "behind"]

        def forward(rows):
            for (conv, piece), group in groupby(rows, itemgetter(0, 1)):
                checkpoint, *turns = group  # the row without a place comes first
                found = walk([(r[7], r[8]) for r in turns], tuple(checkpoint[9]))
                yield conv, piece, None, None, None, None, None, None, [q for _, q in found]
                for k, r in enumerate(turns):
                    yield *r[:7], [edits[k] for edits, _ in found], None
        fields = [("conv", *LONG), ("piece", *LONG), ("at", *LONG), ("turn", *LONG), ("role", *TEXT), ("h1", *LONG), ("h2", *LONG), ("edits", *TEXTS), ("states", *INTS)]
        return self.scratch.write(_in_order(rows.select(*columns), ["conv", "piece"], [F.asc_nulls_first("at")], forward, fields))

    def _entered(self, pieces: DataFrame, walked: DataFrame) -> DataFrame:
        """Each piece with the state it is entered in and what a conversation has once: its cost (first piece), its last edits."""
        states = walked.where("states is not null").select(F.col("conv").alias("c"), F.col("piece").alias("p"), "states")
        rows = pieces.join(states, F.col("conv").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")))
        rows = rows.select("conv", "piece", "blank", "duplicate", "truncated", "illegal", "first", "last", "cost", "states")

        def chain(rows):
            for conv, group in groupby(rows, itemgetter(0)):
                state, last, held = START, None, None
                for _, piece, blank, repeated, truncated, illegal, first, end, cost, states in group:
                    if held:
                        yield *held, None
                    joint = int(last is not None and last + first not in ("su", "ua", "au"))
                    held = conv, piece, state, blank, repeated, truncated, illegal, joint, cost if last is None else None
                    state, last = states[state], end
                yield *held, TAILS[state]
        fields = [("conv", *LONG), ("piece", *LONG), ("entry", *INT), ("blank", *LONG), ("duplicate", *LONG), ("truncated", *LONG), ("illegal", *LONG),
                  ("joint", *LONG), ("cost", *LONG), ("tail", *TEXT)]
        return self.scratch.write(_in_order(rows, ["conv"], [F.asc("piece")], chain, fields))

    def repaired(self) -> DataFrame:
        """conv_id, at, step, edit, role, text: the turns that are left, by (at, step) in each conversation. ``at`` of turns inserted at
        the end is null. Each turn is found by its own key, so no task holds a conversation."""
        left, right = self.edits.where("edits != 'D-'").alias("e"), self.turns.dropDuplicates(["conv", *KEY]).alias("t")
        same = [F.col(f"e.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("conv", *KEY)]
        rows = left.join(right, same).select("e.conv", "e.at", "e.edits", "t.role", "t.text")
        tails = self.totals.where("tail != ''").select("conv", F.lit(None).cast("long").alias("at"), F.col("tail").alias("edits"),
                                                       F.lit("").alias("role"), F.lit("").alias("text"))
        steps = rows.unionByName(tails).select("conv", "at", "role", "text", F.posexplode(F.regexp_extract_all("edits", F.lit("(..)"))).alias("step", "edit"))
        letter, kind = F.substring("edit", 2, 1), F.substring("edit", 1, 1)
        new = F.when(letter == "u", "user").when(letter == "a", "assistant").otherwise(F.col("role"))
        return steps.where(kind != "D").select(F.col("conv").alias(self._conv), "at", "step", kind.alias("edit"), new.alias("role"),
                                               F.when(kind == "I", "").otherwise(F.col("text")).alias("text"))

    def report(self, conversations: DataFrame) -> DataFrame:
        """One row for each of ``conversations``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

        ``gaps``: numbers without a turn between the least and the greatest. ``illegal``: neighbours whose initials aren't su, ua or
        au. ``audit``: initials of the edits. ``repaired_sha256``: of ``role:text`` of the turns left, joined by line feeds. A hash
        of a whole conversation is made turn by turn in one task; it holds one text and the audit.
        """
        texts = self.turns.select("conv", F.lit(0).alias("part"), *KEY, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), F.col("text").alias("value"))
        edits = self.edits.select("conv", F.lit(0).alias("part"), *KEY, F.lit(1).alias("kind"), "at", F.col("edits").alias("value"))
        none = [F.lit(None).cast(dict(self.turns.dtypes)[c]).alias(c) for c in KEY]
        tails = self.totals.select("conv", F.lit(1).alias("part"), *none, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("at"), F.col("tail").alias("value"))
        rows = texts.unionByName(edits).unionByName(tails)

        def digest(rows):
            for conv, group in groupby(rows, itemgetter(0)):
                hashed, audit, text, begun = hashlib.sha256(), [], "", False
                for _, _, _, role, _, _, kind, _, value in group:
                    if kind == 0:
                        text = value
                        continue
                    for edit, letter in zip(value[::2], value[1::2], strict=True):
                        audit.append(edit)
                        if edit != "D":
                            line = f"{NAMES.get(letter, role)}:{'' if edit == 'I' else text}"
                            hashed.update((f"\n{line}" if begun else line).encode())
                            begun = True
                yield conv, "".join(audit), hashed.hexdigest()
        order = [F.asc("part"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("h1"), F.asc("h2"), F.asc("kind"), F.asc("at")]
        digests = _in_order(rows, ["conv"], order, digest, [("conv", *LONG), ("audit", *TEXT), ("repaired_sha256", *TEXT)])
        out = conversations.select(F.col(self._conv).cast("long").alias(self._conv)).distinct()
        for table in (self.sizes.drop("n"), self.totals.drop("tail"), digests):
            side = table.withColumnRenamed("conv", "_conv")
            out = out.join(side, F.col(self._conv).eqNullSafe(F.col("_conv")), "left").drop("_conv")
        numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
        return out.select(self._conv, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
                          F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
