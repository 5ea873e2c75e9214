"""Physical plans: what reaches the scan, what is shuffled, what is not collected."""

import pytest

from tidemark.plans import social
from tidemark.registry import entries, runner
from tidemark.views import Views
from tests.test_parity import FOLDER


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["j01_most_reacted_messages", "j18_spike_response", "k02_compare_results", "c12_window_join", "i13_daily_summary", "w11_decide_trials", "l02_resolve_tables"]
)
def test_no_nested_loop_or_cartesian_join(spark, name):
    plan = plan_of(runner(entries()[name])(spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_hot_keys_are_combined_before_the_shuffle(spark):
    v = Views(spark, FOLDER)
    c = social.Community(v.message, v.reaction, v.channel, v.review, v.topic, v.comment)
    assert "partial_sum" in plan_of(c.reactions_per_message())
    assert "partial_max" in plan_of(runner(entries()["w04_latest_record"])(spark, FOLDER))


def test_scans_read_only_needed_columns(spark):
    plan = plan_of(runner(entries()["c10_semi_join"])(spark, FOLDER))
    assert "l_comment" not in plan and "l_extendedprice" not in plan
    assert "PushedFilters: [IsNotNull(p_type), EqualTo(p_type,PROMO)" in plan


def test_top_n_keeps_n_rows_per_task(spark):
    assert "TakeOrderedAndProject" in plan_of(runner(entries()["f01_top_n"])(spark, FOLDER))


def test_comparison_is_one_pass_over_each_side(spark):
    df = runner(entries()["k02_compare_results"])(spark, FOLDER)
    df.collect()
    final = plan_of(df).split("== Initial Plan")[0]
    assert final.count("FileScan") == 2 and "ReusedExchange" in final


@pytest.mark.parametrize(
    "name",
    ["d02_distinct_counts", "j05_most_commented_topics", "j07_active_channels", "j08_busiest_hours", "j13_game_response", "j32_channel_activity", "j32_hourly_activity"],
)
def test_distinct_counts_copy_no_rows(spark, name):
    assert "Expand" not in plan_of(runner(entries()[name])(spark, FOLDER))


def test_cube_copies_rows_of_entities_only(spark):
    plan = plan_of(runner(entries()["d21_metric_cube"])(spark, FOLDER))
    assert plan.count("Expand") == 1 and plan.index("Expand") < plan.index("partial_sum(cast(o_totalprice")


def test_rank_orders_no_rows_in_one_task(spark):
    plan = plan_of(runner(entries()["w05_rank_by"])(spark, FOLDER))
    # what meets in one task is aggregated by its task first: a row per slice, or partial quantiles
    for piece in plan.split("Exchange SinglePartition")[1:]:
        assert "HashAggregate" in piece.splitlines()[1]


def test_few_scans(spark):
    scans = {n: plan_of(runner(entries()[n])(spark, FOLDER)).count("FileScan") for n in ("j18_spike_response", "j29_statistics_text", "c12_window_join")}
    assert scans["j18_spike_response"] <= 12 and scans["j29_statistics_text"] <= 7 and scans["c12_window_join"] <= 3
