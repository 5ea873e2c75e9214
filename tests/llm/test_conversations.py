import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from tests.parity import duck
from tidemark.llm import conversations as cv

FOLDER = "/root/testdata/sf0.001"


def damage(rows):
    """conv -> rows (turn, role, text) in order."""
    held = {}
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else x
        h = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        out = held.setdefault(conv, [])
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(f"{x[1]}:{x[2]}".encode()).digest())) for c, r in held.items()}


def cheapest(rows):
    """(cost, audit, lines) by trying all edits; rows: (role, text, must go, unfinished)."""

    @lru_cache(None)
    def rest(i, state, added):
        """Least (cost, audit, lines) of rows i on; state: roles' initials so far, in short."""
        got = []
        if i == len(rows):
            if state in ("", "a"):
                got.append((0, "", ()))
        else:
            role, text, gone, open_ = rows[i]
            got.append(more(3, "D", rest(i + 1, state, 0), ()))
            if not gone:
                to = after(state, role[:1])
                if to:
                    got.append(more(open_, "K", rest(i + 1, to, 0), ((role, text),)))
                for new in ("user", "assistant"):
                    to = after(state, new[0])
                    if to:
                        got.append(more(2 + open_, "R", rest(i + 1, to, 0), ((new, text),)))
        if added < 4:
            for new in ("user", "assistant"):
                to = after(state, new[0])
                if to:
                    got.append(more(2, "I", rest(i, to, added + 1), ((new, ""),)))
        got = [g for g in got if g]
        return min(got, key=lambda g: (g[0], g[1])) if got else None

    def more(cost, letter, then, line):
        return then and (cost + then[0], letter + then[1], line + then[2])

    def after(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    return rest(0, "", 0)


def expected(rows):
    for conv, held in damage(rows).items():
        seen, faults, given = set(), [], []
        for _, role, text in held:
            kept = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "b" if not kept else "d" if (role, text) in seen else "t" if kept[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            given.append((role, text, fault in ("b", "d") and fault != "", fault == "t"))
        turns = [t for t, *_ in held if t is not None]
        cost, audit, lines = cheapest(tuple(given))
        initials = [r[:1] for _, r, _ in held]
        yield (
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in "bdt"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
        )


def as_table(rows):
    return sorted(rows, key=str)


def repaired(spark, rows, *size):
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, block int, pos int")
    return as_table(tuple(r) for r in cv.repair(frame, *size).collect())


def drawn(seed, conversations, rows):
    draw = random.Random(seed)
    texts = ["Yes.", "No", "", " ", "Well?", "Ja!  \n", "a b.", "hm", None]
    return [
        (c, draw.choice([t, t, t, draw.randint(0, 9), None]) if c % 3 else t, draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), draw.choice(texts) if draw.random() < 0.4 else f"Text {draw.randint(0, 99)}.")
        for c in range(conversations)
        for t in range(draw.randint(1, rows))
    ]


def test_random_conversations_as_brute_force(spark):
    rows = drawn(3, 250, 12)
    assert repaired(spark, rows) == as_table(expected(rows))


@pytest.mark.parametrize("block", [1, 2, 5])
def test_conversations_over_many_blocks(spark, block):
    rows = drawn(block, 40, 12) + [(100, t, "user" if t % 3 else "assistant", f"T{t % 50}.") for t in range(60)]
    assert repaired(spark, rows, block) == as_table(expected(rows))


def test_odd_rows(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (1, 0, "user", None), (2, 5, "", "x."), (2, 5, "", "x."), (2, None, "system", "s."),
        (7, 0, "user", "w " * 100_000 + "."), (7, 1, "assistant", "é?" + "\t" * 50_000), *[(9, 3, "user", "Same.")] * 300,
    ]
    assert repaired(spark, rows) == as_table(expected(rows))


def test_nothing_left_and_nothing_there(spark):
    gone = [(c, 0, "user", "x.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone and repaired(spark, gone) == as_table((c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in gone)
    frame = spark.createDataFrame(gone, "conv_id long, turn long, role string, text string")
    assert cv.repair(frame.where("false")).isEmpty()


def test_groups_of_blocks():
    codes = ["A" * n for n in (1, 40_000, 40_000, 70_000, 2, 3)]
    assert [codes[g] for g in cv._groups(codes)] == [codes[:2], codes[2:3], codes[3:4], codes[4:]]


def test_a_long_conversation(spark):
    rows = [(5, t, "user" if t % 2 else "assistant", f"Text {t}{'.' if t % 7 else ''}") for t in range(20_000)]
    [got] = repaired(spark, rows)
    roles = []
    held = damage(rows)[5]
    at = 0
    for x in got[7]:
        if x in "KR":
            roles.append(held[at][1][0] if x == "K" else "R")
        elif x == "I":
            roles.append("I")
        at += x != "I"
    assert at == len(held) and len(roles) % 2 == 0
    assert all(r in ("R", "I", "ua"[i % 2]) for i, r in enumerate(roles))


def test_whole_table_as_brute_force(spark):
    from tidemark.llm.queries import ENTRIES

    rows = duck(FOLDER).execute("select conv_id, turn, role, text from conversations").fetchall()
    got = as_table(tuple(r) for r in ENTRIES["op13_conversation_repair"][0](spark, FOLDER).collect())
    missing = [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in {r[0] for r in rows} - damage(rows).keys()]
    assert got == as_table([*expected(rows), *missing])
