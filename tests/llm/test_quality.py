import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import quality, words


def plain_words(text):
    return re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff \t-\r]+", text.encode())


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40))), st.integers(1, 60))
def test_words_of_segments(texts, limit):
    found = {i: b"" for i in range(len(texts))}
    for segment in words.segments(pa.array(texts, pa.string()), limit):
        starts, ends, piece = words.spans(segment)
        hashes = words.Hasher(segment.data).of(starts, ends)
        raw = segment.data.tobytes()
        for a, b, p, h in zip(starts, ends, piece, hashes):
            found[segment.rows[p]] += raw[a:b]
            again = words.Hasher(np.frombuffer(raw[a:b], np.uint8)).of(np.array([0]), np.array([b - a]))
            assert again[0] == h
    assert found == {i: b"".join(plain_words(t or "")) for i, t in enumerate(texts)}


def test_corpus_vectors_as_brute_force(spark):
    texts = ["a b c a", None, "", "x, y; a " * 50, "a"]
    docs = spark.createDataFrame([(t, 1) for t in texts], "text string, n int").repartition(3)
    index = quality.index_vectors()
    expected = {}
    for t in texts:
        w = plain_words(t or "")
        b = [int(words.Hasher(np.frombuffer(x, np.uint8)).of(np.array([0]), np.array([len(x)]))[0] % np.uint64(quality.BUCKETS)) for x in w]
        for i, own in enumerate(b):
            near = [b[j] for j in range(max(0, i - quality.REACH), min(len(b), i + quality.REACH + 1)) if j != i]
            n, v = expected.get(own, (0, np.zeros(quality.DIMENSIONS, int)))
            expected[own] = (n + 1, v + index[near].astype(int).sum(0))
    got = {r["bucket"]: (r["n"], [r[f"v{i}"] for i in range(quality.DIMENSIONS)]) for r in quality.corpus_vectors(docs).collect()}
    assert got == {k: (n, v.tolist()) for k, (n, v) in expected.items()}


def some_vectors():
    draw = np.random.default_rng(3)
    corpus = draw.normal(size=(quality.BUCKETS, quality.DIMENSIONS)).astype(np.float32)
    return quality.WordVectors(draw.random(quality.BUCKETS).astype(np.float32), np.hstack([quality.index_vectors().astype(np.float32), corpus]))


def test_pooled_as_brute_force():
    vectors, index = some_vectors(), quality.index_vectors().astype(int)
    n = quality.BLOCK
    lengths = [0, 1, 2, 3, n - 1, n, 1, n + 1, n + 2, 2, 3 * n + 1, 40, 5]
    draw = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in draw.zipf(1.3, k) % 5000) for k in lengths] + [None, " ", "same same same same"]
    got = vectors.pooled(pa.array(texts))
    for text, row in zip(texts, got, strict=True):
        w = plain_words(text or "")
        b = [int(words.Hasher(np.frombuffer(x, np.uint8)).of(np.array([0]), np.array([len(x)]))[0] % np.uint64(quality.BUCKETS)) for x in w]
        held, k = vectors.weights[b].astype(float), max(1, len(b))
        weighted = vectors.table[b] * held[:, None]
        again = sum(index[b[i]] @ index[b[j]] for i in range(len(b)) for j in range(max(0, i - quality.REACH), min(len(b), i + quality.REACH + 1)) if j != i)
        mean, spread = weighted.sum(0) / max(held.sum(), 1e-6), np.sqrt((weighted**2).sum(0) / k)
        np.testing.assert_allclose(row, [*mean, *spread, held.sum() / k, again / k, np.log1p(len(b)), not b], rtol=1e-4, atol=1e-5)


def test_pooling_holds_no_vector_per_word():
    """Vectors of all words of a segment, copied at each step, were most of the time: some 80 MB each here."""
    vectors, texts = some_vectors(), pa.array(["ab cd ef gh " * 600] * 140)
    vectors.pooled(texts)
    tracemalloc.start()
    vectors.pooled(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_learning_pools_each_text_once(spark, tmp_path):
    log = tmp_path / "pooled"

    class Noted(quality.WordVectors):
        def pooled(self, texts):
            with open(log, "a") as f:
                f.write("".join(f"{t}\n" for t in texts.to_pylist()))
            return super().pooled(texts)

    held = some_vectors()
    docs = spark.createDataFrame([(i, f"a{i} b") for i in range(200)] + [(5, "again")], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, label int")
    network = quality.learn(docs, labels, Noted(held.weights, held.table))
    expected = [r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % quality.FOLDS != quality.HELD_OUT]
    assert sorted(log.read_text().split("\n")[:-1]) == sorted(expected)
    again = quality.learn(docs.repartition(3), labels, held)
    assert (network.w1 == again.w1).all() and network.temperature == again.temperature


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id", "quality as label")
    rows = quality.scored(spark.read.parquet(f"{folder}/documents.parquet"), labels).toPandas().set_index("doc_id")
    assert len(rows) == 10_000 and rows.score.between(0, 1).all()
    assert (rows.predicted == (rows.score >= 0.5)).all()
    assert rows.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.index]
    known = labels.toPandas().set_index("doc_id").label
    held = rows.loc[known.index][rows.loc[known.index].held_out]
    assert (held.predicted == known[held.index]).mean() > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a b", 5), (3, "w " * 400_000, 5), (3, "w", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (9, 1), (None, 0)], "doc_id long, label int")
    rows = quality.scored(docs, labels).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5}
    assert quality.scored(docs.where("false"), labels).count() == 0
    both = spark.createDataFrame([(2, 0), (3, 1)], "doc_id long, label int")
    assert all(0 <= r.score <= 1 for r in quality.scored(docs, both).collect())
