import random

import numpy as np

from tidemark.llm import embedding_dedup as ed
from tidemark.llm.components import components


def got(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_whole_table_as_brute_force(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert got(ed.linked(vectors)) == ed.brute_force(rows)


def test_blocks_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 16)
    monkeypatch.setattr(ed, "LIST_ROWS", 20)
    draw = random.Random(3)
    centres = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [[c + draw.gauss(0, 0.15) for c in draw.choice(centres)] for _ in range(300)]
    rows += [rows[0]] * 40 + [None, [], [0.0] * 6, [-0.0] * 6, [float("nan")] * 6, [1.0] * 5 + [float("inf")], [None] + [1.0] * 5]
    rows += [[1e30 * x for x in rows[0]], [-x for x in rows[0]]]
    table = list(enumerate(rows))
    draw.shuffle(table)
    vectors = spark.createDataFrame([(i, v, i) for i, v in table], "vec_id long, embedding array<float>, node long")
    exact = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert got(ed.linked(vectors)) == ed.brute_force(exact)


def test_many_lists_on_vectors_of_low_rank(spark, monkeypatch):
    monkeypatch.setattr(ed, "LIST_ROWS", 30)
    draw = np.random.default_rng(5)
    for dimensions, rank in ((64, 4), (384, 8)):
        plane = np.linalg.qr(draw.normal(size=(dimensions, rank)))[0].T
        low = draw.normal(size=(1500, rank))
        low /= np.linalg.norm(low, axis=1, keepdims=True)
        step = draw.normal(size=low.shape)
        step /= np.linalg.norm(step, axis=1, keepdims=True)
        near = low + step * draw.uniform(0, 0.3, (1500, 1))
        rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([low, near]) @ plane)]
        assert got(ed.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == ed.brute_force(rows)


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert ed.linked(spark.createDataFrame([], schema)).count() == 0
    assert got(ed.linked(spark.createDataFrame([(1, None), (2, [0.0])], schema))) == {1: (0, 1, True), 2: (0, 2, True)}
    other_length = spark.createDataFrame([(1, [1.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0])], schema)
    assert got(ed.linked(other_length)) == {1: (0, 1, True), 2: (1, 2, True), 3: (1, 2, False)}


def test_every_length_is_linked(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 60)
    monkeypatch.setattr(ed, "LIST_ROWS", 20)
    draw, rows = np.random.default_rng(8), []
    for length, n in ((3, 500), (5, 200), (2, 40), (7, 2), (9, 1)):
        rows += [(length, v.tolist()) for v in draw.normal(size=(n, length))]
    table = [(int(i), v, "x", 1) for i, (_, v) in zip(draw.permutation(len(rows)), rows)]
    vectors = spark.createDataFrame(table, "vec_id long, embedding array<double>, component_id string, node int")
    expected = {}
    for length in (2, 3, 5, 7, 9):
        expected |= ed.brute_force([(i, v) for i, v, *_ in table if len(v) == length])
    assert got(ed.linked(vectors)) == expected
    pair = spark.createDataFrame([(1, [1.0] * 3), (2, [0.0, 1.0, 2.0]), (3, [3.0, 4.0]), (4, [6.0, 8.0]), (5, None)], "vec_id long, embedding array<float>")
    assert got(ed.linked(pair)) == {1: (0, 1, True), 2: (0, 2, True), 3: (1, 3, True), 4: (1, 3, False), 5: (0, 5, True)}


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 300)] + [(5, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 300)}
