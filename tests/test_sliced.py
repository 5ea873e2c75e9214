"""Sliced windows against plain Python, with one key holding most rows."""

import random
from collections import defaultdict

import pytest

from tidemark.operators import aggregates, joins, sliced, windows


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    made = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}"
        at = rng.randrange(50) if rng.random() < 0.5 else rng.randrange(100000)
        value = rng.randrange(1000) if rng.random() < 0.9 else None
        made.append((key, at, i, value))
    return made


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, at bigint, id bigint, value bigint").repartition(7)


def by_key(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    return {k: sorted(g, key=lambda r: (r[1], r[2])) for k, g in groups.items()}


@pytest.mark.parametrize("slices", [2, 9, 64])
def test_running_number(frame, rows, slices):
    wanted = {r[2]: n for g in by_key(rows).values() for n, r in enumerate(g, 1)}
    got = sliced.running_number(frame, ["key"], ["at", "id"], "n", slices).select("id", "n").collect()
    assert {r.id: r.n for r in got} == wanted


@pytest.mark.parametrize("slices", [2, 9, 64])
def test_best_before(frame, rows, slices):
    wanted = {}
    for g in by_key(rows).values():
        best = None
        for _, _, i, value in g:
            wanted[i] = best
            if value is not None and (best is None or value > best):
                best = value
    got = sliced.best_before(frame, ["key"], ["at", "id"], "value", "b", slices).select("id", "b").collect()
    assert {r.id: r.b for r in got} == wanted


@pytest.mark.parametrize("slices", [2, 64])
def test_next_row(frame, rows, slices):
    wanted = {a[2]: b[2] for g in by_key(rows).values() for a, b in zip(g, g[1:])}
    got = joins.sequence_next(frame, "key", ["at", "id"], ["id"], slices).select("id", "next_id").collect()
    assert {r.id: r.next_id for r in got} == wanted


def test_a_value_with_half_of_all_rows_is_cut_by_the_second_column(spark):
    data = [("hot", 5 if i % 2 else i, i) for i in range(4000)]
    df = spark.createDataFrame(data, "key string, at int, id int")
    sizes = sliced.sliced(df, ["at", "id"], 128).groupBy("__slice").count().agg({"count": "max"}).first()[0]
    assert sizes < 150
    ordered = sorted(data, key=lambda r: r[1:])
    got = sliced.running_number(df, ["key"], ["at", "id"], "n", 128).select("id", "n").collect()
    assert {r.id: r.n for r in got} == {r[2]: n for n, r in enumerate(ordered, 1)}


def test_sliced_handles_empty_and_null_order(spark):
    empty = spark.createDataFrame([], "key string, at bigint, id bigint")
    assert sliced.running_number(empty, ["key"], ["at", "id"], "n").count() == 0
    some = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", None, 3)], "key string, at bigint, id bigint")
    got = sliced.running_number(some, ["key"], ["at", "id"], "n").collect()
    assert {r.id: r.n for r in got} == {1: 1, 3: 2, 2: 3}


def test_value_counts_of_a_hot_group(spark, rows):
    df = spark.createDataFrame(rows, "key string, at bigint, id bigint, value bigint")
    assert aggregates.value_counts(df, ["key", "id"]).agg({"occurrences": "sum"}).first()[0] == len(rows)


def test_first_examples_by_frequency(spark):
    data = [("g", w) for w, n in (("a", 1), ("b", 3), ("c", 3), ("d", 2)) for _ in range(n)]
    df = spark.createDataFrame(data, "g string, w string")
    assert aggregates.first_examples(df, ["g"], "w", 3, "e").first().e == ["b", "c", "d"]


def test_first_examples_cut_before_the_shuffle(spark):
    df = spark.range(5000).selectExpr("case when id % 100 = 99 then 'cold' else 'hot' end as g", "cast(id as string) as w")
    found = aggregates.first_examples(df, ["g"], "w", 2, "e")
    assert {r.g: r.e for r in found.collect()} == {"hot": ["0", "1"], "cold": ["1099", "1199"]}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and plan.rindex("WindowGroupLimit") > plan.index("hashpartitioning")


def test_latest_record_ignores_row_order(spark):
    data = [(1, "2024-01-01", 5), (1, "2024-01-03", 2), (1, "2024-01-03", 9), (2, None, 1)]
    df = spark.createDataFrame(data, "id int, at string, votes int")
    for n in (1, 5):
        got = windows.latest_record(df.repartition(n), ["id"], ["at"]).collect()
        assert {r.id: (r.at, r.votes) for r in got} == {1: ("2024-01-03", 9), 2: (None, 1)}


def replay(trials, initial, target):
    best, kept = initial, []
    for score, failed in trials:
        if failed:
            kept.append("error")
            continue
        kept.append("improved" if score > best else "regressed" if score < best else "unchanged")
        best = max(best, score)
        if best >= target:
            break
    return kept


def test_decide_trials_replays_the_loop(spark):
    rng = random.Random(3)
    data, wanted = [], {}
    for run in range(120):
        trials = [(rng.randrange(10) / 10, rng.random() < 0.2) for _ in range(rng.randrange(1, 12))]
        initial = rng.choice([0.2, 0.5, 0.95])
        wanted[run] = replay(trials, initial, 0.9)
        data += [(run, i, s, f, initial) for i, (s, f) in enumerate(trials)]
    df = spark.createDataFrame(data, "run int, i int, score double, failed boolean, initial double")
    got = defaultdict(list)
    decided = windows.decide_trials(df, ["run"], ["i"], "score", "initial", 0.9, failed="failed", slices=5)
    for r in decided.orderBy("run", "i").collect():
        got[r.run].append(r.decision)
    assert dict(got) == wanted


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("slices", [1, 9, 64])
def test_competition_ranks(frame, rows, slices, descending):
    def smaller(v, w):
        return w is not None if v is None else w is not None and v < w

    wanted = {}
    for g in by_key(rows).values():
        for _, _, i, value in g:
            ahead = [smaller(value, o[3]) if descending else smaller(o[3], value) for o in g]
            wanted[i] = 1 + sum(ahead)
    ranked = sliced.competition_ranks(frame, ["key"], {"r": ("value", descending), "by_at": ("at", False)}, slices)
    got = ranked.select("id", "r").collect()
    assert len(got) == len(rows) and {r.id: r.r for r in got} == wanted


def test_competition_ranks_of_one_value_nulls_and_nothing(spark):
    df = spark.range(50).selectExpr("case when id < 40 then 7D when id < 45 then 9D end as v", "id")
    got = sliced.competition_ranks(df, [], {"up": ("v", False), "down": ("v", True)}, 8).collect()
    assert {(r.v, r.up, r.down) for r in got} == {(None, 1, 46), (7.0, 6, 6), (9.0, 46, 1)} and len(got) == 50
    assert sliced.competition_ranks(df.filter("id < 0"), [], {"up": ("v", False)}).count() == 0


def test_distinct_counts_equal_spark(spark, rows):
    df = spark.createDataFrame(rows, "key string, at bigint, id bigint, value bigint").selectExpr(
        "nullif(key, 'k1') as key", "at", "value"
    )
    got = aggregates.distinct_counts(df, ["key"], {"a": "at", "v": "value"})
    wanted = defaultdict(lambda: (set(), set()))
    for r in df.collect():
        for held, value in zip(wanted[r.key], (r.at, r.value)):
            held.update([] if value is None else [value])
    assert {r.key: (r.a, r.v) for r in got.collect()} == {k: (len(a), len(v)) for k, (a, v) in wanted.items()}
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
