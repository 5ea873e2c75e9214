"""Product KPI reports.

KPI rows are additive counts per day and segment. Rates are ratios of sums, so
every report sums to its own grain first and divides once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import inside_label
from tidemark.functions.numbers import exact, money, percent_change, ratio, rounded
from tidemark.operators import filters, joins, windows
from tidemark.operators.aggregates import pivot_max
from tidemark.operators.ranking import top_n

MEASURES = ("active_user", "cash_paying_user", "cash_revenue", "online_ts_mins")
RETENTION_DAYS = [1, 3, 7, 14, 28]


def summary(df: DataFrame, keys: list[str], prefix: str, wanted: str, rate_scale: int = 4) -> DataFrame:
    """KPI measures per key; ``prefix`` d, w or m names them (dau, warpu, mpur ...).

    ``wanted`` picks from: active revenue arpu arppu pay_rate online.
    """
    period = {"d": "daily", "w": "weekly", "m": "monthly"}[prefix]
    known: dict[str, Column] = {
        "active": F.sum("active_user").alias(f"{prefix}au"),
        "revenue": money(F.sum("cash_revenue")).alias(f"{period}_revenue"),
        "arpu": ratio("cash_revenue", "active_user").alias(f"{prefix}arpu"),
        "arppu": ratio("cash_revenue", "cash_paying_user").alias(f"{prefix}arppu"),
        "pay_rate": ratio("cash_paying_user", "active_user", rate_scale).alias(f"{prefix}pur"),
        "paying": F.sum("cash_paying_user").alias("paying_users"),
        "online": ratio("online_ts_mins", "active_user").alias(f"{period}_avg_online"),
    }
    return df.groupBy(*keys).agg(*[known[w] for w in wanted.split()])


def _to_period(daily: DataFrame, unit: str, end: Column) -> DataFrame:
    keys = [c for c in daily.columns if c not in (*MEASURES, "event_date")]
    start = F.trunc("event_date", unit).alias("start_date")
    return daily.groupBy(start, end.alias("end_date"), *keys).agg(*[F.sum(m).alias(m) for m in MEASURES])


def weekly_from_daily(daily: DataFrame) -> DataFrame:
    """Weeks starting on Monday (week_start_day 2, Sunday being 1)."""
    weekly = _to_period(daily, "week", F.date_add(F.trunc("event_date", "week"), 6))
    return weekly.withColumn("week_start_day", F.lit(2))


def monthly_from_daily(daily: DataFrame) -> DataFrame:
    return _to_period(daily, "month", F.last_day("event_date"))


def month_to_date_from_daily(daily: DataFrame) -> DataFrame:
    """One row per month and day: sums from the month's start to that day.

    Runs on the daily summary: at most 31 rows per month and segment.
    """
    keys = [c for c in daily.columns if c not in (*MEASURES, "event_date")]
    start = F.trunc("event_date", "month")
    so_far = (
        Window.partitionBy(*keys, start).orderBy("event_date").rowsBetween(Window.unboundedPreceding, 0)
    )
    return daily.select(
        start.alias("start_date"),
        F.col("event_date").alias("end_date"),
        *keys,
        *[F.sum(m).over(so_far).alias(m) for m in MEASURES],
    )


def daily_trend(daily: DataFrame, days: int, as_of: str) -> DataFrame:
    recent = filters.last_n_days(daily, "event_date", days, as_of)
    return summary(recent, ["event_date", "game_code"], "d", "active revenue")


def regional_rates(daily: DataFrame, region: DataFrame, days: int, as_of: str, n: int = 20) -> DataFrame:
    recent = filters.last_n_days(daily, "event_date", days, as_of)
    located = joins.with_region(recent, region)
    rates = summary(located, ["event_date", "region_name"], "d", "active revenue arpu arppu pay_rate")
    return top_n(rates, [F.col("daily_revenue").desc()], n, ["event_date", "region_name"])


def user_type_mix(daily: DataFrame, days: int, as_of: str) -> DataFrame:
    recent = filters.last_n_days(daily, "event_date", days, as_of)
    mix = summary(recent, ["event_date", "user_type"], "d", "active arpu")
    return windows.share(mix, "dau", "user_type_ratio", ["event_date"])


def weekly_trend(weekly: DataFrame, days: int, as_of: str, week_start_day: int = 2) -> DataFrame:
    chosen = filters.last_n_days(weekly, "end_date", days, as_of).filter(F.col("week_start_day") == week_start_day)
    return summary(chosen, ["start_date", "end_date", "week_start_day"], "w", "active revenue arpu pay_rate")


def monthly_trend(monthly: DataFrame, months: int, as_of: str) -> DataFrame:
    complete = filters.month_end_only(filters.last_n_months(monthly, "end_date", months, as_of), "end_date")
    return summary(complete, ["start_date", "end_date"], "m", "active revenue arpu arppu pay_rate")


def month_to_date(running: DataFrame, region: DataFrame) -> DataFrame:
    rows = joins.with_region(filters.month_end_only(running, "end_date", month_to_date=True), region)
    keys = ["start_date", "end_date", "game_code", "region_name", "user_type"]
    return summary(rows, keys, "m", "active revenue arpu arppu pay_rate online", 2)


def daily_summary(daily: DataFrame, region: DataFrame) -> DataFrame:
    """Every daily measure by game, region and user type."""
    keys = ["event_date", "game_code", "region_name", "user_type"]
    return summary(joins.with_region(daily, region), keys, "d", "active revenue arpu arppu pay_rate online", 2)


def online_time(daily: DataFrame, platform: str, days: int, as_of: str) -> DataFrame:
    recent = filters.last_n_days(daily, "event_date", days, as_of)
    minutes = F.try_divide(F.sum("online_ts_mins").cast("double"), F.sum("active_user").cast("double"))
    return recent.groupBy("event_date", F.col(platform).alias("platform")).agg(
        F.sum("active_user").alias("dau"),
        ratio("online_ts_mins", "active_user").alias("avg_online_time_mins"),
        F.round(minutes / 60, 2).alias("avg_online_time_hours"),
    )


def best_sellers(sales: DataFrame, items: DataFrame, on: list[str], days: int, as_of: str, n: int = 20) -> DataFrame:
    """Top products by spend.

    The row-ratio mean is carried as sum and count, so sales can be combined per
    product before the dimension join.
    """
    recent = filters.last_n_days(sales, "sale_date", days, as_of)
    price = F.try_divide(F.col("paid_used").cast("double"), F.col("unit_sold").cast("double"))
    per_item = recent.groupBy(*on).agg(
        F.sum("unit_sold").alias("u"), F.sum("paid_used").alias("p"), F.sum(price).alias("s"), F.count(price).alias("c")
    )
    grouped = (
        joins.join_dimensions(per_item, (items, on))
        .groupBy("category", "sub_category", "product_name")
        .agg(
            F.sum("u").alias("total_units_sold"),
            money(F.sum("p")).alias("total_paid_used"),
            F.round(F.try_divide(F.sum("s"), F.sum("c").cast("double")), 2).alias("avg_price_per_unit"),
        )
    )
    return top_n(grouped, [F.col("total_paid_used").desc()], n, ["category", "sub_category", "product_name"])


def week_over_week(weekly: DataFrame, days: int, as_of: str) -> DataFrame:
    chosen = filters.last_n_days(weekly, "end_date", days, as_of)
    series = summary(chosen, ["start_date", "end_date"], "w", "active revenue")
    order = Window.orderBy("end_date")  # one row per week
    moved = series.withColumns(
        {"prev_wau": F.lag("wau").over(order), "prev_revenue": F.lag("weekly_revenue").over(order)}
    )
    return moved.withColumns(
        {
            "wau_growth_rate": percent_change("wau", "prev_wau", guard="nonzero"),
            "revenue_growth_rate": percent_change("weekly_revenue", "prev_revenue", guard="nonzero"),
        }
    )


def period_retention(retention: DataFrame, day_plus: int, event: tuple[str, str], span: tuple[str, str]) -> DataFrame:
    """Retention inside an event window against the days outside it, per cohort first."""
    chosen = filters.between_dates(retention, "cohort_date", *span).filter(F.col("day_plus") == day_plus)
    per_cohort = chosen.groupBy("cohort_date").agg(
        ratio("retained_user", "cohort_size", 4).cast("double").alias("rate"), F.sum("cohort_size").alias("size")
    )
    label = inside_label("cohort_date", *event, "event_period", "normal_period").alias("period_type")
    return per_cohort.groupBy(label).agg(
        F.count(F.lit(1)).alias("days_count"),
        F.round(F.avg("rate"), 4).alias("avg_retention_rate"),
        F.round(F.min("rate"), 4).alias("min_retention_rate"),
        F.round(F.max("rate"), 4).alias("max_retention_rate"),
        F.sum("size").alias("total_cohort_size"),
    )


def retention_rates(retention: DataFrame, days: list[int]) -> DataFrame:
    return (
        retention.filter(F.col("day_plus").isin(days))
        .groupBy("cohort_date", "day_plus")
        .agg(
            ratio("retained_user", "cohort_size", 4).alias("retention_rate"),
            F.sum("cohort_size").alias("cohort_size"),
            F.sum("retained_user").alias("retained_users"),
        )
    )


def top_regions(monthly: DataFrame, region: DataFrame, as_of: str, n: int = 3) -> DataFrame:
    last = filters.last_complete_month(monthly, "end_date", as_of)
    located = joins.with_region(last, region)
    rates = summary(located, ["start_date", "end_date", "region_name"], "m", "revenue paying arppu")
    return top_n(rates, [F.col("marppu").desc_nulls_last()], n, ["region_name"])


def type_gap(daily: DataFrame, first: str, second: str, days: int, as_of: str) -> DataFrame:
    """Daily revenue per user of two user types side by side, with their gap."""
    recent = filters.one_of(filters.last_n_days(daily, "event_date", days, as_of), "user_type", [first, second])
    rates = summary(recent, ["event_date", "user_type"], "d", "active arpu")
    wide = pivot_max(rates, ["event_date"], "user_type", [first, second], {"darpu": "darpu", "dau": "dau"})
    a, b = f"{first}_darpu".lower(), f"{second}_darpu".lower()
    both = wide.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.withColumns(
        {
            "darpu_difference": (F.col(a) - F.col(b)).cast("decimal(38,2)"),
            "darpu_diff_percentage": percent_change(a, b, guard="nonzero"),
        }
    )


def active_days(events: DataFrame, user: str, date: Column | str, *more: str) -> DataFrame:
    """One row per user and day: the only part of raw activity retention needs."""
    day = F.col(date) if isinstance(date, str) else date
    return events.select(F.col(user).alias("user_id"), day.alias("day"), *more).distinct()


def cohort_retention(days: DataFrame, offsets: list[int] = RETENTION_DAYS) -> DataFrame:
    """Retention rows from raw active days: cohort day, day offset, size, retained.

    Every cohort has a row for every offset, with 0 retained where nobody returned.
    """
    first = days.groupBy("user_id").agg(F.min("day").alias("cohort_date"))
    sizes = first.groupBy("cohort_date").agg(F.count(F.lit(1)).alias("cohort_size"))
    grid = sizes.withColumn("day_plus", F.explode(F.array(*[F.lit(n) for n in offsets])))
    since = F.date_diff("day", "cohort_date")
    back = (
        days.join(first, "user_id")
        .withColumn("day_plus", since)
        .filter(F.col("day_plus").isin(offsets))
        .groupBy("cohort_date", "day_plus")
        .agg(F.count(F.lit(1)).alias("retained_user"))
    )
    return grid.join(back, ["cohort_date", "day_plus"], "left").withColumn(
        "retained_user", F.coalesce("retained_user", F.lit(0))
    )


def user_types(days: DataFrame, away: int = 14) -> DataFrame:
    """New, Return (back after ``away`` days or more) or Exist for every active day.

    The window runs over distinct days, whose number per user is bounded by the calendar.
    """
    before = F.lag("day").over(Window.partitionBy("user_id").orderBy("day"))
    gap = F.date_diff("day", F.col("before"))
    label = F.when(F.col("before").isNull(), "New").when(gap >= away, "Return").otherwise("Exist")
    return days.withColumn("before", before).withColumn("user_type", label).drop("before")


def top_customers(orders: DataFrame, customers: DataFrame, n: int) -> DataFrame:
    spend = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(exact("o_totalprice")).alias("s"))
    named = spend.join(customers, "c_custkey").groupBy("c_name").agg(money(F.sum("s")).alias("total_spent"))
    return top_n(named, [F.col("total_spent").desc()], n, ["c_name"])


def customers_above(orders: DataFrame, customers: DataFrame, threshold: float) -> DataFrame:
    spend = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(exact("o_totalprice")).alias("s"))
    named = spend.join(customers, "c_custkey").groupBy("c_name").agg(money(F.sum("s")).alias("total_spent"))
    return filters.having(named, F.col("total_spent") > threshold)


def revenue_by(df: DataFrame, category: str, date: str, lo: str, hi: str, amount: str) -> DataFrame:
    dated = df.withColumn("__day", F.to_date(date))
    return filters.between_dates(dated, "__day", lo, hi).groupBy(category).agg(
        money(F.sum(exact(amount))).alias("total_revenue"), F.count(F.lit(1)).alias("transaction_count")
    )


def product_popularity(sales: DataFrame, items: DataFrame, n: int | None = None) -> DataFrame:
    per_item = sales.groupBy("product_id").agg(F.count(F.lit(1)).alias("c"), F.sum("paid_used").alias("p"))
    named = (
        per_item.join(items, "product_id")
        .groupBy("product_name")
        .agg(F.sum("c").alias("purchase_count"), money(F.sum("p")).alias("total_revenue"))
    )
    full = named.withColumn(
        "avg_price", rounded(F.try_divide(F.col("total_revenue").cast("double"), F.col("purchase_count").cast("double")))
    )
    return full if n is None else top_n(full, [F.col("purchase_count").desc()], n, ["product_name"])


def total_revenue(df: DataFrame, amount: str) -> DataFrame:
    return df.agg(money(F.sum(exact(amount))).alias("total_revenue"))

