"""Result comparison: invariants and a brute-force matcher on small results."""

import random

import pytest

from tidemark.plans import compare
from tidemark.plans.compare import Leniency


def frame(spark, rows):
    return spark.createDataFrame(rows, "pair_id int, row_no int, cells array<string>")


def as_rows(results):
    return [(p, i, [None if c is None else str(c) for c in row]) for p, rows in results.items() for i, row in enumerate(rows)]


def verdicts(spark, expected, actual, **rules):
    got = compare.compare_results(frame(spark, as_rows(expected)), frame(spark, as_rows(actual)), rules=Leniency(**rules))
    return {r.pair_id: r for r in got.collect()}


def test_same_data_in_other_spellings_passes(spark):
    expected = {1: [["2025-01-29", "Active", None, "1500000", "123.456"]]}
    actual = {1: [["01/29/2025", " active ", "None", "1.5e6", "123.4561"]]}
    assert verdicts(spark, expected, actual)[1].passed


@pytest.mark.parametrize(
    "left, right, same",
    [
        ("2025-01-29T00:00:00Z", "2025-01-29", True),
        ("2025-01-29 10:00:00+02:00", "2025-01-29 08:00:00", True),
        ("2025-01-29", "2025-01-30", False),
        ("New  York", "new york", True),
        ("<null>", "null", True),
        ("", "null", False),
        ("-0", "0.0", True),
        ("1d", "1", False),
        ("nan", "1", False),
    ],
)
def test_cell_spellings(spark, left, right, same):
    assert verdicts(spark, {1: [[left]]}, {1: [[right]]})[1].passed is same


def test_order_does_not_matter_unless_asked(spark):
    a, b = {1: [["x"], ["y"]]}, {1: [["y"], ["x"]]}
    assert verdicts(spark, a, b)[1].passed
    assert not verdicts(spark, a, b, ordered=True)[1].passed
    assert verdicts(spark, a, a, ordered=True)[1].passed


def test_copies_count(spark):
    got = verdicts(spark, {1: [["x"], ["x"], ["y"]]}, {1: [["x"], ["y"], ["y"]]})[1]
    assert (got.matched_rows, got.missing_rows, got.extra_rows, got.passed) == (2, 1, 1, False)


def test_one_changed_cell_fails_only_its_pair(spark):
    rows = [[i, f"n{i}", i * 1.5] for i in range(20)]
    changed = [list(r) for r in rows]
    changed[7][2] = 99.0
    got = verdicts(spark, {1: rows, 2: rows}, {1: rows, 2: changed})
    assert got[1].passed and not got[2].passed and got[2].matched_rows == 19


def test_values_on_both_sides_of_a_bucket_border_meet(spark):
    # 0.0149 and 0.0151 round to different hundredths
    assert verdicts(spark, {1: [["0.0149"]]}, {1: [["0.0151"]]}, tolerance=0.01)[1].passed
    assert not verdicts(spark, {1: [["0.01"]]}, {1: [["0.03"]]}, tolerance=0.01)[1].passed
    assert not verdicts(spark, {1: [["0.0149"]]}, {1: [["0.0151"]]}, tolerance=0)[1].passed


def test_missing_rows_pass_only_within_the_share(spark):
    rows = [[str(i)] for i in range(10)]
    assert not verdicts(spark, {1: rows}, {1: rows[:9]})[1].passed
    assert verdicts(spark, {1: rows}, {1: rows[:9]}, max_missing_share=0.1)[1].passed
    assert not verdicts(spark, {1: rows}, {1: rows[:8] + [["z"]]}, max_missing_share=0.5)[1].passed


def test_pairs_on_one_side_only_are_reported(spark):
    got = verdicts(spark, {1: [["x"]]}, {2: [["x"]]})
    assert (got[1].missing_rows, got[2].extra_rows) == (1, 1)


@pytest.mark.parametrize("cells", [1, 2, 3, 5])
def test_any_number_of_noisy_cells_meets(spark, cells):
    rng = random.Random(cells)
    step = 0.01 / (cells + 1) * 0.99
    rows = [[round(rng.choice([i / 100, i / 100 + 0.005, i / 8]), 5) for _ in range(cells)] for i in range(60)]
    noisy = [[v + rng.choice([-1, 1]) * rng.choice([1e-10, step]) for v in row] for row in rows]
    got = verdicts(spark, {1: rows}, {1: noisy})[1]
    assert (got.matched_rows, got.passed) == (60, True)


@pytest.mark.parametrize("cells", [1, 2, 3, 4])
def test_cells_within_the_whole_tolerance_meet(spark, cells):
    rng = random.Random(cells + 50)
    rows = [[round(rng.uniform(0, 1000), 4) for _ in range(cells)] for _ in range(200)]
    moved = [[round(v + rng.uniform(-0.0099, 0.0099), 6) if i % 10 else v + 0.0102 for v in row] for i, row in enumerate(rows)]
    expected = {1: [[f"t{i % 3}", *r] for i, r in enumerate(rows)]}
    actual = {1: [[f"t{i % 3}", *r] for i, r in enumerate(moved)]}
    got = verdicts(spark, expected, actual)[1]
    assert (got.matched_rows, got.expected_rows) == (180, 200)


def test_rounded_rows_pass(spark):
    rng = random.Random(9)
    rows = [[rng.uniform(0, 5) for _ in range(3)] for _ in range(200)]
    assert verdicts(spark, {1: rows}, {1: [[round(v, 2) for v in r] for r in rows]})[1].passed


def test_crowded_numbers_meet_as_brute_force(spark):
    """Few distinct places, so that rows could meet several others; one number, where the order gives the most."""
    rng = random.Random(3)
    expected = {p: [[round(rng.uniform(0, 0.12), 3)] for _ in range(9)] for p in range(30)}
    actual = {p: [[round(v[0] + rng.choice([0.009, -0.009, 0.02]), 3)] for v in rows] for p, rows in expected.items()}
    got = verdicts(spark, expected, actual)
    for p in expected:
        e, a = [r[0] for r in expected[p]], [r[0] for r in actual[p]]
        # rows within half the tolerance may count as one
        assert largest_matching(e, a, 0.01 + 1e-9) - 2 <= got[p].matched_rows <= largest_matching(e, a, 0.015 + 1e-9)


def test_far_cells_never_meet_on_any_grid(spark):
    rows = [[i, i * 0.5, i / 8] for i in range(40)]
    far = [[a, b + 0.0101, c] for a, b, c in rows]
    assert verdicts(spark, {1: rows}, {1: far})[1].matched_rows == 0


def test_relative_tolerance_is_for_large_numbers(spark):
    big, near, wrong = [["1234567.8", "a"]], [["1234568", "a"]], [["1234667.8", "a"]]
    assert not verdicts(spark, {1: big}, {1: near})[1].passed
    assert verdicts(spark, {1: big}, {1: near}, relative=1e-5)[1].passed
    assert not verdicts(spark, {1: big}, {1: wrong}, relative=1e-5)[1].passed
    assert not verdicts(spark, {1: [["0.01"]]}, {1: [["0.03"]]}, relative=1e-5)[1].passed


def test_every_named_pair_gets_a_verdict(spark):
    pairs = spark.createDataFrame([(1,), (2,), (3,)], "pair_id int")
    expected, actual = frame(spark, as_rows({1: [["x"]]})), frame(spark, as_rows({1: [["x"]], 3: [["y"]]}))
    got = {r.pair_id: r for r in compare.compare_results(expected, actual, pairs=pairs).collect()}
    assert (got[1].passed, got[2].passed, got[3].passed) == (True, True, False)
    assert (got[2].expected_rows, got[2].match_ratio) == (0, 1.0)


def largest_matching(left, right, tol):
    """Maximum matching of numbers within a tolerance by augmenting paths."""
    owner = {}

    def assign(i, seen):
        for j, v in enumerate(right):
            if abs(left[i] - v) <= tol and j not in seen:
                seen.add(j)
                if j not in owner or assign(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return sum(assign(i, set()) for i in range(len(left)))


def test_matches_lie_between_half_and_full_tolerance(spark):
    rng = random.Random(11)
    expected, actual = {}, {}
    for p in range(40):
        base = [round(rng.uniform(0, 0.3), 4) for _ in range(12)]
        expected[p] = [[v] for v in base]
        actual[p] = [[round(v + rng.choice([0, 0.002, -0.004, 0.03]), 4)] for v in base]
    got = verdicts(spark, expected, actual, tolerance=0.01)
    for p in expected:
        e, a = [r[0] for r in expected[p]], [r[0] for r in actual[p]]
        assert got[p].matched_rows <= largest_matching(e, a, 0.01 + 1e-9)
        alone = verdicts_lower_bound(e, a)
        assert got[p].matched_rows >= alone


def verdicts_lower_bound(e, a):
    return len([v for v in set(e) if v in a])


def test_columns_in_another_order(spark):
    rows = [[f"id{i}", i * 10, "x" if i % 3 else "y"] for i in range(9)]
    moved = [[c, a, b] for a, b, c in rows]
    expected, actual = frame(spark, as_rows({1: rows, 2: rows})), frame(spark, as_rows({1: moved, 2: rows}))
    order = {r.pair_id: r.column_order for r in compare.column_order(expected, actual).collect()}
    assert order == {1: [1, 2, 0], 2: [0, 1, 2]}
    assert all(r.passed for r in compare.compare_any_columns(expected, actual).collect())


def test_compare_sql_reasons(spark):
    pairs = spark.createDataFrame(
        [(1, "select 1", "SELECT  1;"), (2, "select 1", None), (3, None, "x"), (4, "select 1", "select 2")],
        "id int, e string, a string",
    )
    got = {r.id: (r.passed, r.differences) for r in compare.compare_sql(pairs, "e", "a").collect()}
    assert got == {
        1: (True, []),
        2: (False, ["query absent"]),
        3: (False, ["expected query absent"]),
        4: (False, ["normalized texts differ"]),
    }
