"""Operator 13: edits against every way to edit, tables against a plain version."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from grantseek.llm import conversations as repair
from grantseek.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, piece string, at int, edits double, c int"


def every_edit(turns):
    """(cost, audit) of all edits with at most two insertions at a place."""
    gaps = ["", "u", "a", "ua", "au"]
    choices = []
    for initial, fault in turns:
        own = [("D", "", 3)]
        if fault not in (1, 2):
            extra = fault == 3
            own += [("K", initial, extra), ("R", "u", 2 + extra), ("R", "a", 2 + extra)]
        choices += [[("I" * len(g), g, 2 * len(g)) for g in gaps], own]
    choices.append([("I" * len(g), g, 2 * len(g)) for g in gaps])
    return min((sum(c[2] for c in way), "".join(c[0] for c in way)) for way in itertools.product(*choices)
               if re.fullmatch("(s?(ua)+)?", "".join(c[1] for c in way)))


def in_pieces(turns, cuts):
    pieces = [turns[a:b] for a, b in zip([0, *cuts], [*cuts, len(turns)], strict=True)]
    behind = [repair.CLOSING]
    for piece in reversed(pieces):
        behind.append(repair.fold(repair.matrix(piece), behind[-1]))
    behind.reverse()
    state, out = 0, ""
    for piece, v in zip(pieces, behind[1:], strict=True):
        edits, state = repair.walk(piece, v)[state]
        out += "".join(edits)
    return behind[0][0], (out + repair.TAILS[state])[::2]


def test_edits_are_the_least_of_all():
    rnd = random.Random(4)
    for k in range(400):
        turns = [(rnd.choice("suuuaaax"), rnd.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(k % 4)]
        want = every_edit(turns)
        assert in_pieces(turns, []) == want
        assert in_pieces(turns, sorted(rnd.sample(range(len(turns) + 1), min(2, len(turns))))) == want


def test_pieces_do_not_matter():
    rnd = random.Random(5)
    for _ in range(100):
        turns = [(rnd.choice("suax"), rnd.choice([0, 0, 1, 3])) for _ in range(60)]
        whole = in_pieces(turns, [])
        assert in_pieces(turns, sorted(rnd.sample(range(61), 9))) == whole


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain(rows, conv):
    """The report of one conversation; rows of one number in any order must be copies of each other."""
    rows = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
    rows = [(r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows]
    seen, turns, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
        seen.add((role, text))
        if fault:
            counts[fault - 1] += 1
        turns.append((role[:1], fault))
    numbers = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    cost, audit = in_pieces(turns, []) if rows else (0, "")
    lines, state, left = [], 0, iter(rows)
    for edit in audit:
        if edit in "DKR":
            _, role, text = next(left)
        if edit == "K":
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
        elif edit in "IR":
            state = repair.NEXT[state]
            role, text = ("", "", "user", "assistant")[state], "" if edit == "I" else text
        if edit != "D":
            lines.append(f"{role}:{text}")
    return (conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def table(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 0.5, 2) for r in rows], SCHEMA)


def some_rows(seed, conversations=40, turns=12):
    rnd, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rnd.randrange(turns)):
            role = rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", None, ""])
            text = rnd.choice(["Yes.", "Yes.", "No!", "so", None, "", " \n\x0b", "Why? ", "日本。", "é.\t", f"Text {rnd.randrange(5)}."])
            rows.append((conv if conv else None, None if turn == 3 and conv % 3 == 0 else turn * (1 + conv % 2), role, text))
    return rows


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("piece", [1, 3, 64])
def test_reports_are_those_of_the_plain_version(spark, piece):
    rows = some_rows(piece)
    docs = table(spark, rows).repartition(3)
    got = repair.Repair(docs, piece=piece).report(docs.unionByName(table(spark, [(999, 0, "user", "gone")]))).select(*COLUMNS).collect()
    convs = {r[0] for r in rows} | {999}
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str(plain(rows, c)) for c in convs)


def test_query_on_damaged_rows(spark, tmp_path):
    rows = some_rows(9, 60) + [(70, k, "user" if k % 2 == 0 else "assistant", f"Line {k}.") for k in range(700)]
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_conversation_repair(spark, str(tmp_path)).select(*COLUMNS).collect()
    broken = damaged(rows)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str(plain(broken, c)) for c in {r[0] for r in rows})


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "More?"), (2, 5, "system", "Be kind."), (2, 6, "assistant", "Yes."),
            (3, 0, "tool", "x."), (4, 0, "user", "a."), (4, 1, "assistant", "b."), (5, 0, "user", " ")]
    done = repair.Repair(table(spark, rows), piece=1)
    by = {}
    for r in sorted(done.repaired().collect(), key=lambda r: (r.conv_id, r.at is None, r.at or 0, r.step)):
        by.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    report = {r.conv_id: r for r in done.report(table(spark, rows)).collect()}
    for conv, r in report.items():
        lines = "\n".join(f"{role}:{text}" for _, role, text in by.get(conv, []))
        assert hashlib.sha256(lines.encode()).hexdigest() == r.repaired_sha256
        assert "".join(e for e, _, _ in by.get(conv, [])) == r.audit.replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role, _ in by.get(conv, [])))
    assert by[4] == [("K", "user", "a."), ("K", "assistant", "b.")] and 5 not in by


def test_empty_table(spark):
    empty = table(spark, [(1, 1, "user", "x")]).limit(0)
    assert repair.Repair(empty).report(empty).count() == 0
    assert repair.Repair(empty).repaired().count() == 0
