import pytest

import __spark_entry__
from tests.parity import duck, duck_rows, sort_key, spark_rows
from tidemark.llm.queries import ENTRIES

FOLDER = "/root/testdata/sf0.001"
WITH_SQL = [name for name, (_, sql) in ENTRIES.items() if sql]


def test_every_operator_and_the_pipeline_are_registered():
    assert {n.split("_")[0] for n in ENTRIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert ENTRIES.keys() <= __spark_entry__.queries().keys()
    assert set(WITH_SQL) <= __spark_entry__.oracle_sql().keys()


@pytest.mark.parametrize("name", WITH_SQL)
def test_as_the_check_sql(spark, name):
    run, sql = ENTRIES[name]
    names, rows = spark_rows(run(spark, FOLDER))
    columns, expected = duck_rows(duck(FOLDER), sql)
    assert names == columns
    assert sorted(rows, key=sort_key) == sorted(expected, key=sort_key)


def test_mix_of_odd_rows(spark):
    from tidemark.llm import mixing

    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "z", "b"), (5, "w " * 30_000, "hot")]
    docs = spark.createDataFrame([(d, t, s, 7) for d, t, s in rows], "doc_id long, text string, source string, size int")
    mixed = [(r.row.doc_id, r["size"], r.source_size, r.copies) for r in mixing.mixed(docs).collect()]
    assert sorted((d or 0, n, s) for d, n, s, _ in mixed) == [(0, 1, 1), (1, 0, 0), (2, 0, 0), (3, 2, 4), (3, 2, 4), (5, 30_000, 30_000)]
    assert all(c <= mixing.CAP for *_, c in mixed)
    out = mixing.emit(docs)
    assert out.columns == docs.columns and {r["size"] for r in out.collect()} == {7}
    assert mixing.emit(docs.where("false")).isEmpty()


def test_targets_by_resharing(spark):
    """As shares that are capped and dealt again until none is above its cap."""
    from tidemark.llm import mixing

    sizes = [("a", 10), ("b", 500), ("c", 3), ("d", 0), (None, 90), ("e", 40)]
    weights = {s: i % 3 + 1 for i, s in enumerate(["a", "b", "c", "d", "e", None])}
    held, total, open_ = dict(sizes), sum(n for _, n in sizes), set(weights)
    target = {}
    while True:
        left = total - sum(target.values())
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * held[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * held[s] for s in over}
        open_ -= over
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    assert got == pytest.approx(target)
