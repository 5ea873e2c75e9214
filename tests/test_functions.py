"""Worked numbers, empty inputs, ties and zero denominators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, labels, numbers, text
from tidemark.operators import aggregates, filters, joins, ranking, windows
from tidemark.plans import metrics


def value(spark, column, **literals):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in literals.items()]).select(column.alias("x"))
    return row.first().x


def test_change_of_recorded_weeks(spark):
    # 14973 -> 36875 messages is a rise of 146.28 percent; the first week has none
    df = spark.createDataFrame([(1, 14973), (2, 36875), (3, 0), (4, 7)], "w int, n int")
    got = [r.rate for r in windows.pct_change(df, "n", "w", "rate").orderBy("w").collect()]
    assert got == [None, 146.28, -100.0, None]


@pytest.mark.parametrize(
    "guard, before, wanted",
    [("positive", -10, None), ("nonzero", -10, -300.0), ("abs", -10, 300.0), ("nonzero", 0, None), ("abs", None, None)],
)
def test_change_guards(spark, guard, before, wanted):
    column = numbers.percent_change(F.lit(20), F.lit(before).cast("int"), guard)
    assert value(spark, column) == wanted


@pytest.mark.parametrize(
    "rate, direction, magnitude",
    [(None, "안정", "작은 변화"), (20.01, "급증", "중간 변화"), (20.0, "증가", "중간 변화"), (-5.0, "안정", "작은 변화"), (-31.0, "급감", "큰 변화")],
)
def test_change_labels(spark, rate, direction, magnitude):
    c = F.lit(rate).cast("double")
    assert value(spark, labels.change_direction(c)) == direction
    assert value(spark, labels.change_magnitude(c)) == magnitude


def test_ratio_rounds_ties_up_and_is_null_on_zero(spark):
    df = spark.createDataFrame([("a", "297925.97", 2), ("b", "1385698.95", 6), ("c", "1", 0)], "k string, n string, d int")
    typed = df.withColumn("n", F.col("n").cast("decimal(18,2)"))
    got = {r.k: r.r and str(r.r) for r in typed.groupBy("k").agg(numbers.ratio("n", "d").alias("r")).collect()}
    assert got == {"a": "148962.99", "b": "230949.83", "c": None}


def test_normalize_sql_keeps_a_semicolon_before_a_blank(spark):
    assert value(spark, text.normalize_sql(F.lit(" select\n 1 ;;"))) == "SELECT 1"
    assert value(spark, text.normalize_sql(F.lit("select 1; "))) == "SELECT 1;"


def test_lenient_date_and_fiscal_year(spark):
    assert value(spark, dates.lenient_date(F.lit("no date"))) is None
    assert value(spark, dates.fiscal_year(F.lit("2024-07-01").cast("date"))) == 2025
    assert value(spark, dates.fiscal_year(F.lit("2024-06-30").cast("date"))) == 2024


def test_previous_quarter(spark):
    df = spark.sql("select explode(sequence(date'2024-01-01', date'2024-12-31')) as d")
    got = filters.previous_period(df, "d", "quarter", "2024-08-15").agg(F.min("d"), F.max("d")).first()
    assert tuple(got) == (dt.date(2024, 4, 1), dt.date(2024, 6, 30))


def test_score_of_nothing_is_zero(spark):
    empty = spark.createDataFrame([], "passed boolean")
    row = aggregates.score_rollup(empty, []).first()
    assert (row.total, row.passed, row.failed, row.score) == (0, 0, 0, 0.0)


def test_success_rate_counts_missing_as_failure(spark):
    df = spark.createDataFrame([(True,), (None,), (False,), (True,)], "ok boolean")
    assert df.agg(numbers.success_rate("ok").alias("r")).first().r == 0.5


def test_keep_active_keeps_parents_with_only_deleted_children(spark):
    parent = spark.createDataFrame([(1,), (2,), (3,)], "p int")
    child = spark.createDataFrame([(1, True), (2, True), (2, False)], "c int, gone boolean")
    kept = filters.keep_active(parent, child, "p", "c", "gone").select("p").distinct()
    compat = filters.keep_active(parent, child, "p", "c", "gone", compat=True).select("p").distinct()
    assert sorted(r.p for r in kept.collect()) == [1, 2, 3]
    assert sorted(r.p for r in compat.collect()) == [2, 3]


def test_window_totals_keep_lonely_events(spark):
    events = spark.createDataFrame([("2024-01-01",), ("2024-03-01",)], "e string").select(F.to_date("e").alias("e"))
    series = spark.createDataFrame([("2024-01-02", 1), ("2023-12-31", 2), ("2024-01-03", 4)], "d string, n int").select(
        F.to_date("d").alias("d"), "n"
    )
    events = events.unionByName(spark.sql("select cast(null as date) as e"))
    got = joins.window_totals(events, "e", series, "d", 1, 1, [], {"n": F.sum("n")}).collect()
    assert {str(r.e): r.n for r in got} == {"2024-01-01": 3, "2024-03-01": None, "None": None} and len(got) == 3
    tagged = series.withColumn("by", F.when(F.col("n") > 1, "late"))
    got = joins.window_totals(events, "e", tagged, "d", 1, 1, ["by"], {"n": F.sum("n")}).collect()
    assert {(str(r.e), r.by, r.n) for r in got} == {
        ("2024-01-01", None, 1), ("2024-01-01", "late", 2), ("2024-03-01", None, None), ("None", None, None)
    }


def test_top_n_is_repeatable_on_ties(spark):
    df = spark.range(100).withColumn("score", F.lit(1))
    for n in (1, 9):
        got = ranking.top_n(df.repartition(n), [F.col("score").desc()], 3, ["id"])
        assert [r.id for r in got.collect()] == [0, 1, 2]


def test_canonical_array_ignores_case_and_keeps_equal_order(spark):
    df = spark.sql("select array(named_struct('k','b','v',1), named_struct('k','A','v',2), named_struct('k','B','v',3)) as a")
    got = df.select(ranking.canonical_array("a", "k").alias("a")).first().a
    assert [(x.k, x.v) for x in got] == [("A", 2), ("b", 1), ("B", 3)]


def test_share_of_total_and_empty(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3)], "k string, n int")
    assert {r.k: r.s for r in windows.share(df, "n", "s").collect()} == {"a": 25.0, "b": 75.0}
    assert windows.share(df.filter("n > 9"), "n", "s").count() == 0


def test_metric_view_joins_only_what_dimensions_need(spark):
    orders = spark.createDataFrame([(1, "F", 10.0)], "o_custkey int, o_orderstatus string, o_totalprice double")
    customer = spark.createDataFrame([(1, "X")], "o_custkey int, c_mktsegment string")
    view = metrics.MetricView(
        orders,
        {"status": F.col("o_orderstatus"), "segment": F.col("c_mktsegment")},
        {"n": F.count(F.lit(1))},
        {"customer": (customer, ["o_custkey"])},
        {"segment": ["customer"]},
    )
    plain = view.query(["status"], ["n"])
    assert "Join" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert view.query(["segment"], ["n"]).first().segment == "X"


def test_snippets_know_their_synonyms():
    snippets = metrics.sales_snippets()
    assert snippets._find(snippets.measures, " Sales ").name == "total_revenue"
    with pytest.raises(KeyError):
        snippets._find(snippets.measures, "weight")
