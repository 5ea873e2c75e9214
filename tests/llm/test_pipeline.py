from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_near_dedup import brute as brute_classes
from tests.llm.test_packing import check as check_packing
from tidemark.llm import mixing, packing, pii, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage read and returned."""
    folder = tmp_path_factory.mktemp("stages")
    docs, seen = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, FOLDER).write.parquet(path)
        out = spark.read.parquet(path)
        seen.append((docs, out))
        docs = out
    return seen


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_columns_stay(steps):
    for docs, out in steps[:-1]:
        assert out.columns == docs.columns


def test_toxic_go_and_others_stay(spark, steps):
    docs, out = steps[0]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").selectExpr("doc_id", "toxic as label")
    verdict = {r.doc_id: r.predicted for r in toxicity.scored(docs, labels).collect()}
    assert rows(out) == Counter({r: n for r, n in rows(docs).items() if not verdict[r[0]]})


def test_one_of_each_class_stays(steps):
    docs, out = steps[1]
    held = [tuple(r) for r in docs.collect()]
    classes = brute_classes([(r[0], r[1]) for r in held])
    assert rows(out) == Counter(r for i, r in enumerate(held) if classes[i] == r[0])


def test_personal_data_is_masked(steps):
    docs, out = steps[2]
    before, after = ({r.doc_id: r for r in df.collect()} for df in (docs, out))
    assert before.keys() == after.keys()
    for i, r in before.items():
        base = pii.base_spans(r.text)
        if base:
            assert not pii.base_spans(after[i].text) and after[i].n_chars == len(after[i].text)
        assert base or after[i].text == r.text or "[" in after[i].text


def test_mix_repeats_whole_documents(steps):
    docs, out = steps[3]
    copies = {r.row.doc_id: r.copies for r in mixing.mixed(docs).collect()}
    assert rows(out) == Counter({tuple(r): copies[r.doc_id] for r in docs.collect() if copies[r.doc_id]})


def test_packing_holds_every_copy(steps):
    docs, out = steps[4]
    once = docs.dropDuplicates(["doc_id"])
    taken = Counter(r.doc_id for r in docs.collect())
    pieces = Counter((r.doc_id, r.piece) for r in out.collect())
    assert {d for d, _ in pieces} == set(taken) and all(n == taken[d] for (d, _), n in pieces.items())
    assert out.groupBy("shard", "bin").agg({"size": "sum"}).where(f"`sum(size)` > {packing.CAPACITY}").isEmpty()
    check_packing(once, packing.packed(once).collect(), packing.CAPACITY)


def test_run_as_the_stages(spark, steps):
    assert rows(corpus_pipeline.run(spark, FOLDER)) == rows(steps[-1][1])


def test_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).isEmpty()
