import hashlib
import time
from collections import Counter

import pytest
import xxhash

from tidemark.llm import fingerprints as fp


def likeness(a, b):
    x, y = Counter(a.split("\n")), Counter(b.split("\n"))
    shared = sum((x & y).values())
    total = sum(x.values()) + sum(y.values())
    return shared / (total - shared)


def text_hash(doc_id, text):
    """As the engine hashes a text and a flag after it, signed."""
    flag = int(doc_id is None).to_bytes(4, "little")
    seed = xxhash.xxh64(text.encode(), seed=42).intdigest()
    h = xxhash.xxh64(flag, seed=seed).intdigest()
    return h - (1 << 64) if h >> 63 else h


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, text_hash(*r)))
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        yield d, len(t), hashlib.sha256(edited.encode()).hexdigest(), likeness(t, edited), likeness(t, nxt)


ROWS = [
    (5, "one\ntwo\nthree\nfour"), (1, None), (2, ""), (3, "one\ntwo\nthree\nfour"), (9, "ä\u00f6\U0001f600\nä\nä\nä"),
    (7, "\n".join(f"line {i}" for i in range(700))), (8, "\n".join(f"line {i % 350}" for i in range(900))), (5, "five"), (None, "x\ny"),
    *[(6, "same\nrow\nthree times over, so that a quarter is long")] * 3, *[(20, "last\nrow\ntwice")] * 2,
]


def test_as_brute_force_with_retries(spark):
    docs = spark.createDataFrame([(d, t, 1) for d, t in ROWS], "doc_id long, text string, cells int")
    got = fp.fingerprints(docs).collect()
    have = sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got)
    assert have == sorted((str(d), n, s, round(e, 9), round(x, 9)) for d, n, s, e, x in brute(ROWS))
    by_id = {r.doc_id: r for r in got if r.doc_id in (3, 1, 2)}
    assert by_id[1].fingerprint == by_id[2].fingerprint
    assert by_id[3].fingerprint in {r.fingerprint for r in got if r.doc_id == 5}


def test_empty_and_single(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    assert fp.fingerprints(docs.where("false")).count() == 0
    [row] = fp.fingerprints(docs).collect()
    assert row.near_next == 1.0


def test_very_long_texts_take_linear_time(spark):
    rows = [(1, "\n".join(f"line {i}" for i in range(100_000))), (2, "\n".join(f"line {i % 9}" for i in range(100_000))), (3, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: (r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in fp.fingerprints(docs).collect()}
    assert time.time() - start < 90
    assert got == {d: (n, s, round(e, 9), round(x, 9)) for d, n, s, e, x in brute(rows)}


@pytest.mark.parametrize("seed", [1])
def test_whole_table(spark, seed):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in fp.fingerprints(docs).collect()}
    assert got == {d: (n, s, round(e, 9), round(x, 9)) for d, n, s, e, x in brute(rows)}
