import hashlib
import re
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import conversations as op

ORDER = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """Plain dynamic programming over whole conversations, from the last row back; cost and audit."""
    none = (10**9, "")

    def inserted(best):
        for _ in range(4):
            for s in range(4):
                cost, audit = best[op.NEXT[s, op.WANTED[s]]]
                best[s] = min(best[s], (cost + 3, "I" + audit)) if cost < 10**9 else best[s]
        return best

    best = inserted({s: (0, "") if s in (0, 3) else none for s in range(4)})
    for initial, fault in reversed(rows):
        new = {}
        for s in range(4):
            ways = [(4, "D", s)]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                ways.append((3 + more, "R", op.NEXT[s, op.WANTED[s]]))
                if (s, initial) in op.NEXT:
                    ways.append((more, "K", op.NEXT[s, initial]))
            new[s] = min((cost + best[to][0], letter + best[to][1]) for cost, letter, to in ways)
        best = inserted(new)
    return best[0]


def report(rows):
    """By the definition, of damaged rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\r\x0b\x0c")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit = cheapest([(r[1][:1], f) for r, f in zip(rows, faults)])
    out, order, at = [], "", iter(rows)
    for letter in audit:
        wanted = "assistant" if order[-1:] == "u" else "user"
        _, role, text = next(at) if letter != "I" else (None, wanted, "")
        if letter != "D":
            role = wanted if letter == "R" else role
            out.append(f"{role}:{text}")
            order += role[0]
    assert ORDER.fullmatch(order)
    turns = {t for t, *_ in rows if t is not None}
    initials = [r[1][:1] for r in rows]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(k) for k in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        blank = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", blank(text)) if kind == 2 else blank(text)
        row = (turn, "user" if kind == 4 else blank(role), text)
        kept += [] if kind == 0 else [row, row] if kind == 3 else [row]
    return out


ROWS = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, None, "x"), (1, None, "user", ""), (2, 0, "system", "Be. "),
        (3, 0, "tool", "x"), (3, 0, "assistant", "y?"), (3, 9, "user", "same."), (3, 10, "user", "same."), (4, 0, "", "no role."),
        *[(5, i, ("user", "assistant", "system")[i * 7919 % 3], f"t{i % 31}" + "." * (i % 5 > 0)) for i in range(60)],
        *[(6, 0, "user", "all one.")] * 25, *[(7, i, "user" if i % 2 == 0 else "assistant", "ok." + "x" * 5000 + "!") for i in range(20)]]


@pytest.mark.parametrize("limits", [(512, 16 << 20), (4, 16 << 20), (512, 3000)])
def test_matches_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(op, "ROWS", limits[0])
    monkeypatch.setattr(op, "BYTES", limits[1])
    monkeypatch.setattr(op, "FAN", 3)
    table = spark.createDataFrame([(*r, "p", 1) for r in ROWS], "conv_id long, turn long, role string, text string, pos string, cost int")
    broken = op.damage(table)
    got = {r.conv_id: tuple(r)[1:] for r in op.repair(broken).collect()}
    want = damaged(ROWS)
    assert set(got) == set(want)
    for conv, rows in want.items():
        assert got[conv] == report(rows), conv
    turns = {}
    for r in sorted(op.messages(broken).collect(), key=lambda r: r.place):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv in want:
        assert hashlib.sha256("\n".join(turns.get(conv, [])).encode()).hexdigest() == got[conv][-1]


def test_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op.repair(op.damage(empty)).count() == 0
    # all rows of a conversation dropped
    gone = spark.createDataFrame([(1, 1, "user", "a", False), (1, 2, "user", "b", None)], "conv_id long, turn long, role string, text string, present boolean")
    row = op.repair(gone).first()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


LATTICE = st.lists(st.tuples(st.sampled_from("suat "), st.sampled_from(["", "", "blank", "duplicate", "truncated"])), max_size=12)


@settings(max_examples=300, deadline=None)
@given(LATTICE)
def test_least_audit(rows):
    assert op.shortest(tuple(rows), 0, op.FINAL)[:2] == cheapest(rows)


@settings(max_examples=100, deadline=None)
@given(LATTICE, LATTICE)
def test_parts_join(left, right):
    """The best of a joined sequence is the best way through a state in the middle."""
    left, right = tuple(left), tuple(right)
    ways = []
    for middle in range(4):
        a, b = op.between(left, 0, middle), op.shortest(right, middle, op.FINAL)
        if a and b:
            ways.append((a[0] + b[0], a[1] + b[1]))
    assert min(ways) == op.shortest(left + right, 0, op.FINAL)[:2]


def test_query(spark):
    from tidemark.llm.queries import QUERIES

    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"][0](spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    want = {conv: report(r) for conv, r in damaged(map(tuple, rows)).items()}
    assert got == want
