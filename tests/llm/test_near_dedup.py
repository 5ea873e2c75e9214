import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import near_dedup as nd
from tidemark.llm import words
from tidemark.llm.components import local_stars


def labelled(text):
    w = [x.lower() if x.isascii() else x for x in re.findall(r"[^ \t-\r]+", text or "")]
    grams = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    seen, out = {}, []
    for g in grams:
        out.append((g, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + 1
    return out


def plain_similarity(a, b):
    """Longest common subsequence by the full table."""
    best = np.zeros(len(b) + 1, int)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b):
            old = best[j + 1]
            best[j + 1] = diagonal + 1 if x == y else max(best[j + 1], best[j])
            diagonal = old
    return best[-1] / (len(a) + len(b) - best[-1])


def brute(rows):
    """Class of each row by comparing all pairs."""
    seqs = [labelled(t) for _, t in rows]
    sets = [set(s) for s in seqs]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            if not seqs[i] or not seqs[j] or min(len(seqs[i]), len(seqs[j])) < 0.8 * max(len(seqs[i]), len(seqs[j])):
                continue
            common = len(sets[i] & sets[j])
            if common / (len(seqs[i]) + len(seqs[j]) - common) >= 0.8 and plain_similarity(seqs[i], seqs[j]) >= 0.8:
                links.append((i, j))
    left, right = (np.array([p[k] for p in links], int) for k in (0, 1))
    group = local_stars(len(rows), left, right)
    return {i: min(rows[j][0] for j in range(len(rows)) if group[j] == group[i]) for i in range(len(rows))}


@settings(deadline=None)
@given(st.lists(st.text("ab \n", max_size=40), max_size=6))
def test_shingles_as_plain(texts):
    found = {}
    for segment in words.segments(pa.array(texts, pa.string()), 16, whole=True):
        made, begin, piece, whole = nd.shingles(segment)
        ends = np.append(begin[1:], len(made))
        for k, (s, e) in enumerate(zip(begin, ends)):
            found[int(segment.rows[piece[k]])] = (made[s:e].tolist(), int(whole[k]))
    expected = [labelled(t) for t in texts]
    ids = {}
    for i, e in enumerate(expected):
        assert (i in found) == bool(e)
        if e:
            assert len(found[i][0]) == len(e)
            for h, gram in zip(found[i][0], e):
                assert ids.setdefault(gram, h) == h
    assert len(set(ids.values())) == len(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=40, unique=True), st.data())
def test_similarity_as_full_table(a, data):
    b = list(a)
    for _ in range(data.draw(st.integers(0, 4))):
        kind, at = data.draw(st.integers(0, 2)), data.draw(st.integers(0, len(b)))
        b[at : at + (kind > 0)] = [100 + len(b) * 7 + at] * (kind < 2)
    b = list(dict.fromkeys(b)) or [1]
    expected = plain_similarity(a, b)
    assert nd.similarity(np.array(a, np.uint32), np.array(b, np.uint32)) == pytest.approx(expected if expected >= 0.8 else 0)


def got(df):
    return sorted((r.doc_id, r.class_id, r.kept) for r in df.collect())


def test_whole_table_as_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    classes = brute(rows)
    assert got(nd.classes_of(docs)) == sorted((d, classes[i], classes[i] == d) for i, (d, _) in enumerate(rows))


def test_large_group_with_far_members(spark, monkeypatch):
    monkeypatch.setattr(nd, "MINOR_BLOCK", 5)
    monkeypatch.setattr(nd, "MEMBER_BLOCK", 20)
    draw = random.Random(4)
    base = [f"w{i}" for i in range(200)]

    def edited(n):
        w = list(base)
        for _ in range(n):
            w[draw.randrange(len(w))] = f"x{draw.random()}"
        return " ".join(w)

    # about the threshold from the text they were made from, below it from each other
    rows = [(i, edited(draw.choice([1, 2, 3, 4, 5, 6]))) for i in range(150)]
    rows += [(1000 + i, " ".join(f"y{i}{j}" for j in range(50)) + " " + " ".join(base[:60])) for i in range(40)]
    draw.shuffle(rows)
    classes = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(nd.classes_of(docs)) == sorted((d, classes[i], classes[i] == d) for i, (d, _) in enumerate(rows))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, " \n"), (5, "A b  c"), (4, "a b c"), (4, "a b c"), (4, "a b c"), (None, "a B c"), (9, "a b d"), (None, None), (7, "z " * 60_000), (8, "z " * 60_001)]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, tag int")
    found = [(r.doc_id, r.class_id, r.kept) for r in nd.classes_of(docs).collect()]
    assert len(found) == len(rows)
    assert [f for f in found if f[1] == 4 and f[2]] == [(4, 4, True)]
    assert sum(f[1] == 4 for f in found) == 5
    kept = nd.deduplicated(docs).collect()
    assert sorted((r.doc_id or 0, r.text is None) for r in kept) == sorted([(1, False), (2, False), (2, False), (4, False), (9, False), (0, True), (7, False)][1:] + [(1, True)])
    assert nd.deduplicated(docs).columns == docs.columns
    assert nd.classes_of(docs.where("false")).count() == 0
