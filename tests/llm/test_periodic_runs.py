import hashlib
import random
import re
import time
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import periodic_runs as pr
from tests.parity import duck


def brute(words):
    """Every run by trying every period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            begin = i
            while i < n and words[i] == words[i - q]:
                i += 1
            start, length = begin - q, i - begin + q
            if length >= max(6, 4 * q):
                found.setdefault((start, length), q)  # the smallest period of a stretch comes first
    return sorted((s, m, q) for (s, m), q in found.items())


def edited(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc_id, text):
    words = edited(doc_id, text)
    runs = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (
        doc_id, len(runs), s, m, q, 1000 * m // q if runs else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest(),
    )


def found(texts):
    return [r for r, _ in pr.runs_of_texts(pa.array(texts, pa.string()))]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("abc ", max_size=120).map(lambda t: " ".join(t)), max_size=4))
def test_as_brute_force_on_few_letters(texts):
    assert found(texts) == [brute(t.split()) for t in texts]


def test_as_brute_force_on_nested_repeats():
    draw = random.Random(4)
    for _ in range(300):
        words = [draw.choice("abcd") for _ in range(draw.randint(1, 5))]
        while len(words) < 150:
            piece = words[-draw.randint(1, len(words)) :]
            words += piece * draw.randint(1, 6)
            if draw.random() < 0.5:
                words.append(draw.choice("abcdxyz"))
        words = words[:600]
        assert found([" ".join(words)]) == [brute(words)]


def test_fibonacci_and_powers():
    a, b = "x", "y x"
    while len(b) < 4000:
        a, b = b, b + " " + a
    for text in (b, " ".join(["a"] * 37 + ["b"] + ["a"] * 37 + ["b"] + ["a"] * 37 + ["b"] + ["a"] * 37 + ["b"] + ["a"] * 40)):
        assert found([text]) == [brute(text.split())]


def test_very_long_texts_take_linear_time():
    start = time.time()
    assert found(["w " * 300_000]) == [[(0, 300_000, 1)]]
    assert found(["a b " * 150_000 + "c"]) == [[(0, 300_000, 2)]]
    draw = random.Random(1)
    root = [str(draw.randint(0, 300)) for _ in range(40_000)]
    [runs] = found([" ".join(root * 5)])
    assert max(runs, key=lambda r: r[1]) == (0, 200_000, 40_000)
    assert time.time() - start < 60


ROWS = [
    (0, "la " * 9 + "end"), (1, None), (2, ""), (3, " \t\n"), (4, "a b c a b c a b c a b c a"), (4, "a b c a b c a b c a b c a"),
    (None, "x " * 7), (5, "é é " * 30), (6, "x y " * 6 + "x x x x x x x"), (7, "n" * 100_000), (19, "one two three four five six seven eight"),
]


def test_odd_rows(spark):
    rows = [(d, t, 1, "s") for d, t in ROWS] + [(i, "q w e r t y u i o p " * (1 + i % 7), 1, "s") for i in range(100, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, row string")
    got = pr.periodic(docs).collect()
    key = lambda r: (str(r[0]), str(r))
    assert sorted(map(tuple, got), key=key) == sorted((expected(d, t) for d, t, *_ in rows), key=key)
    assert pr.periodic(docs.where("false")).isEmpty()
    kept = pr.with_runs(docs)
    assert kept.columns == ["row", "runs", "collapsed"] and kept.select("row.runs", "row.row").distinct().count() == 1


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_whole_table_as_brute_force(spark, folder):
    from tidemark.llm.queries import ENTRIES

    rows = duck(folder).execute("select doc_id, text from documents").fetchall()
    got = {r[0]: tuple(r) for r in ENTRIES["op12_periodic_runs"][0](spark, folder).collect()}
    assert got == {d: expected(d, t) for d, t in rows}
    assert any(r[1] for r in got.values())
