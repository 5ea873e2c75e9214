"""KPI reports over the stand-in views."""

from pyspark.sql import functions as F

from tidemark.operators import filters
from tidemark.plans import kpi
from tidemark.registry import query
from tidemark.views import EVENTS_AS_OF, ORDERS_AS_OF


def rate(num: str, den: str, scale: int = 2, only: str = "") -> str:
    """Ratio of two sums rounded half up, in whole numbers so that ties are exact."""
    n, d = f"cast(round((sum({num}) {only})::double * 1e{scale}) as hugeint)", f"(sum({den}) {only})"
    return f"cast(((2 * {n} + {d}) // nullif(2 * {d}, 0))::double / 1e{scale} as decimal(38,{scale}))"


ACTIVE = "cast(sum(active_user) as bigint)"
REVENUE = "cast(sum(cash_revenue) as decimal(38,2))"
ARPU, ARPPU = rate("cash_revenue", "active_user"), rate("cash_revenue", "cash_paying_user")
PAY_RATE = rate("cash_paying_user", "active_user", 4)
PAY_RATE_2 = rate("cash_paying_user", "active_user", 2)
ONLINE = rate("online_ts_mins", "active_user")


def since(column: str, days: int) -> str:
    return f"{column} >= cast(date '{ORDERS_AS_OF}' - interval {days} day as date)"


WEEKLY = "weekly as (select cast(date_trunc('week', event_date) as date) as start_date, cast(date_trunc('week', event_date) + interval 6 day as date) as end_date, * from kpi_daily)"
MONTHLY = "monthly as (select cast(date_trunc('month', event_date) as date) as start_date, cast(last_day(event_date) as date) as end_date, * from kpi_daily)"


@query(
    "i01_daily_trend",
    f"""select event_date, game_code, {ACTIVE} as dau, {REVENUE} as daily_revenue from kpi_daily
        where {since('event_date', 365)} group by 1, 2""",
)
def i01(v):
    return kpi.daily_trend(v.kpi_daily, 365, ORDERS_AS_OF)


@query(
    "i02_regional_rates",
    f"""select event_date, region_name, {ACTIVE} as dau, {REVENUE} as daily_revenue, {ARPU} as darpu, {ARPPU} as darppu,
          {PAY_RATE} as dpur from kpi_daily k left join region_dim r on k.country_code = r.country_code
        where {since('event_date', 365)} group by 1, 2 order by daily_revenue desc, event_date, region_name limit 20""",
)
def i02(v):
    return kpi.regional_rates(v.kpi_daily, v.region_dim, 365, ORDERS_AS_OF)


@query(
    "i03_user_type_mix",
    f"""with m as (select event_date, user_type, {ACTIVE} as dau, {ARPU} as darpu from kpi_daily
                   where {since('event_date', 365)} group by 1, 2)
        select *, round(dau::double * 100.0::double / (sum(dau) over (partition by event_date))::double, 2) as user_type_ratio from m""",
)
def i03(v):
    return kpi.user_type_mix(v.kpi_daily, 365, ORDERS_AS_OF)


@query(
    "i04_weekly_trend",
    f"""with {WEEKLY} select start_date, end_date, cast(2 as integer) as week_start_day, {ACTIVE} as wau, {REVENUE} as weekly_revenue, {ARPU} as warpu,
          {PAY_RATE} as wpur from weekly where {since('end_date', 728)} group by 1, 2""",
)
def i04(v):
    return kpi.weekly_trend(kpi.weekly_from_daily(v.kpi_daily), 728, ORDERS_AS_OF)


@query(
    "i05_monthly_trend",
    f"""with {MONTHLY} select start_date, end_date, {ACTIVE} as mau, {REVENUE} as monthly_revenue, {ARPU} as marpu,
          {ARPPU} as marppu, {PAY_RATE} as mpur from monthly where end_date >= date '1999-08-01' group by 1, 2""",
)
def i05(v):
    return kpi.monthly_trend(kpi.monthly_from_daily(v.kpi_daily), 24, ORDERS_AS_OF)


def retention_sql(table: str, user: str, day: str, offsets: str) -> str:
    """Retention rows of a raw table by joining every user's first day back to all days."""
    return f"""days as (select distinct {user} as u, {day} as d from {table}),
      firsts as (select u, min(d) as f from days group by u),
      retention as (select f as cohort_date, n as day_plus, count(distinct firsts.u) as cohort_size,
          count(distinct days.u) as retained_user
        from firsts cross join (select unnest([{offsets}]) as n) o
        left join days on days.u = firsts.u and days.d = firsts.f + n group by 1, 2)"""


_RET = retention_sql("lineitem", "l_partkey", "cast(l_shipdate as date)", "1, 3, 7, 14, 28")


def _retention(v):
    return kpi.cohort_retention(kpi.active_days(v.lineitem, "l_partkey", F.to_date("l_shipdate")))


@query(
    "i06_retention_rates",
    f"""with {_RET} select cohort_date, cast(day_plus as integer) as day_plus, {rate('retained_user', 'cohort_size', 4)} as retention_rate,
          cast(sum(cohort_size) as bigint) as cohort_size, cast(sum(retained_user) as bigint) as retained_users
        from retention where day_plus in (1, 7, 14) group by 1, 2""",
)
def i06(v):
    return kpi.retention_rates(_retention(v), [1, 7, 14])


@query(
    "i07_online_time",
    f"""select event_date, game_code as platform, {ACTIVE} as dau, {ONLINE} as avg_online_time_mins,
          round(sum(online_ts_mins)::double / nullif(sum(active_user), 0)::double / 60, 2) as avg_online_time_hours
        from kpi_daily where {since('event_date', 365)} group by 1, 2""",
)
def i07(v):
    return kpi.online_time(v.kpi_daily, "game_code", 365, ORDERS_AS_OF)


@query(
    "i08_best_sellers",
    f"""select category, sub_category, product_name, cast(sum(unit_sold) as bigint) as total_units_sold,
          cast(sum(paid_used) as decimal(38,2)) as total_paid_used,
          round(avg(paid_used::double / nullif(unit_sold, 0)::double), 2) as avg_price_per_unit
        from product_sales s left join product_dim d on s.product_id = d.product_id
        where {since('sale_date', 730)} group by 1, 2, 3
        order by total_paid_used desc, category, sub_category, product_name limit 20""",
)
def i08(v):
    return kpi.best_sellers(v.product_sales, v.product_dim, ["product_id"], 730, ORDERS_AS_OF)


@query(
    "i09_week_over_week",
    f"""with {WEEKLY}, w as (select start_date, end_date, {ACTIVE} as wau, {REVENUE} as weekly_revenue from weekly
                             where {since('end_date', 365)} group by 1, 2),
        p as (select *, lag(wau) over (order by end_date) as prev_wau, lag(weekly_revenue) over (order by end_date) as prev_revenue from w)
        select *, round((wau - prev_wau)::double * 100.0::double / nullif(prev_wau, 0)::double, 2) as wau_growth_rate,
          round((weekly_revenue::double - prev_revenue::double) * 100.0::double / nullif(prev_revenue, 0)::double, 2) as revenue_growth_rate from p""",
)
def i09(v):
    return kpi.week_over_week(kpi.weekly_from_daily(v.kpi_daily), 365, ORDERS_AS_OF)


@query(
    "i10_period_retention",
    f"""with {_RET}, c as (select cohort_date, {rate('retained_user', 'cohort_size', 4)}::double as rate, sum(cohort_size) as size
          from retention where day_plus = 7 and cohort_date between date '1995-01-01' and date '1995-12-31' group by 1)
        select case when cohort_date between date '1995-01-15' and date '1995-03-31' then 'event_period' else 'normal_period' end as period_type,
          count(*) as days_count, round(avg(rate), 4) as avg_retention_rate, round(min(rate), 4) as min_retention_rate,
          round(max(rate), 4) as max_retention_rate, cast(sum(size) as bigint) as total_cohort_size from c group by 1""",
)
def i10(v):
    return kpi.period_retention(_retention(v), 7, ("1995-01-15", "1995-03-31"), ("1995-01-01", "1995-12-31"))


@query(
    "i11_top_regions",
    f"""with {MONTHLY} select start_date, end_date, region_name, {REVENUE} as monthly_revenue,
          cast(sum(cash_paying_user) as bigint) as paying_users, {ARPPU} as marppu
        from monthly m left join region_dim r on m.country_code = r.country_code where end_date = date '2001-07-31'
        group by 1, 2, 3 order by marppu desc nulls last, region_name limit 3""",
)
def i11(v):
    return kpi.top_regions(kpi.monthly_from_daily(v.kpi_daily), v.region_dim, ORDERS_AS_OF)


@query(
    "i12_type_gap",
    f"""with m as (select event_date, {{}} from kpi_daily where {since('event_date', 365)} group by 1)
        select *, cast(building_darpu - household_darpu as decimal(38,2)) as darpu_difference,
          round((building_darpu::double - household_darpu::double) * 100.0::double / nullif(household_darpu::double, 0), 2) as darpu_diff_percentage
        from m where building_darpu is not null and household_darpu is not null""".format(
        ", ".join(
            rate("cash_revenue", "active_user", 2, f"filter (user_type = '{t}')") + f" as {t.lower()}_darpu, "
            f"cast(sum(active_user) filter (user_type = '{t}') as bigint) as {t.lower()}_dau"
            for t in ("BUILDING", "HOUSEHOLD")
        )
    ),
)
def i12(v):
    return kpi.type_gap(v.kpi_daily, "BUILDING", "HOUSEHOLD", 365, ORDERS_AS_OF)


@query(
    "i13_daily_summary",
    f"""select event_date, game_code, region_name, user_type, {ACTIVE} as dau, {REVENUE} as daily_revenue, {ARPU} as darpu,
          {ARPPU} as darppu, {PAY_RATE_2} as dpur, {ONLINE} as daily_avg_online
        from kpi_daily k left join region_dim r on k.country_code = r.country_code group by all""",
)
def i13(v):
    return kpi.daily_summary(v.kpi_daily, v.region_dim)


@query(
    "i14_month_to_date",
    f"""with running as (select cast(date_trunc('month', event_date) as date) as start_date, event_date as end_date, game_code, country_code, user_type,
          sum(active_user) over w as active_user, sum(cash_paying_user) over w as cash_paying_user,
          sum(cash_revenue) over w as cash_revenue, sum(online_ts_mins) over w as online_ts_mins from kpi_daily
          window w as (partition by game_code, country_code, user_type, date_trunc('month', event_date) order by event_date))
        select start_date, end_date, game_code, region_name, user_type, {ACTIVE} as mau, {REVENUE} as monthly_revenue,
          {ARPU} as marpu, {ARPPU} as marppu, {PAY_RATE_2} as mpur, {ONLINE} as monthly_avg_online
        from running k left join region_dim r on k.country_code = r.country_code group by all""",
)
def i14(v):
    return kpi.month_to_date(kpi.month_to_date_from_daily(v.kpi_daily), v.region_dim)


@query(
    "i15_cohort_retention",
    f"""with {retention_sql('activity', 'user_id', 'event_date', '1, 3, 7, 14, 28')}
        select cohort_date, cast(day_plus as integer) as day_plus, cohort_size, retained_user from retention""",
)
def i15(v):
    return kpi.cohort_retention(kpi.active_days(v.activity, "user_id", "event_date"))


@query(
    "i16_user_types",
    """with d as (select distinct o_custkey as u, cast(o_orderdate as date) as day from orders),
         t as (select u, day, (select max(e.day) from d e where e.u = d.u and e.day < d.day) as before from d)
       select day, case when before is null then 'New' when day - before >= 14 then 'Return' else 'Exist' end as user_type,
              count(*) as users from t group by 1, 2""",
)
def i16(v):
    typed = kpi.user_types(kpi.active_days(v.orders, "o_custkey", F.to_date("o_orderdate")))
    return typed.groupBy("day", "user_type").agg(F.count(F.lit(1)).alias("users"))


_SPEND = """select c_name, cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,2)) as total_spent
            from orders join customer on o_custkey = c_custkey group by 1"""


@query("i17_top_customers", f"{_SPEND} order by total_spent desc, c_name limit 10")
def i17(v):
    return kpi.top_customers(v.orders, v.customer, 10)


@query(
    "i18_revenue_by_category",
    """select o_orderpriority, cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,2)) as total_revenue,
         count(*) as transaction_count from orders where cast(o_orderdate as date) between date '1996-01-01' and date '1999-12-31' group by 1""",
)
def i18(v):
    return kpi.revenue_by(v.orders, "o_orderpriority", "o_orderdate", "1996-01-01", "1999-12-31", "o_totalprice")


@query(
    "i19_product_popularity",
    """select product_name, count(*) as purchase_count, cast(sum(paid_used) as decimal(38,2)) as total_revenue,
         round(sum(paid_used)::double / count(*), 2) as avg_price
       from product_sales s join product_dim d on s.product_id = d.product_id group by 1""",
)
def i19(v):
    return kpi.product_popularity(v.product_sales, v.product_dim)


@query("i20_customers_above", f"{_SPEND} having sum(cast(o_totalprice as decimal(18,2))) > 3000000")
def i20(v):
    return kpi.customers_above(v.orders, v.customer, 3000000)


@query(
    "i21_total_revenue",
    "select cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,2)) as total_revenue from orders",
)
def i21(v):
    return kpi.total_revenue(v.orders, "o_totalprice")


@query(
    "i21_previous_quarter_revenue",
    """select cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,2)) as total_revenue from orders
       where o_orderdate >= date '2001-04-01' and o_orderdate < date '2001-07-01'""",
)
def i21_quarter(v):
    dated = v.orders.withColumn("day", F.to_date("o_orderdate"))
    return kpi.total_revenue(filters.previous_period(dated, "day", "quarter", ORDERS_AS_OF), "o_totalprice")


@query(
    "i07_activity_by_platform",
    f"""select platform, count(distinct user_id) as users, count(*) as events from activity
        where event_date >= cast(date '{EVENTS_AS_OF}' - interval 14 day as date) group by 1""",
)
def i07_activity(v):
    recent = filters.last_n_days(v.activity, "event_date", 14, EVENTS_AS_OF)
    return recent.groupBy("platform").agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("events"))
