"""Filters, predicates and labels over the stand-in views."""

from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.functions.numbers import percent_change, pct
from tidemark.operators import filters, windows
from tidemark.registry import query
from tidemark.views import EVENTS_AS_OF, ORDERS_AS_OF

DAILY_MESSAGES = """
daily as (select event_date, count(*) as messages from message group by event_date)"""


def daily_messages(v):
    return v.message.groupBy("event_date").agg(F.count(F.lit(1)).alias("messages"))


@query(
    "b01_between_dates",
    "select message_id, event_date, game_code from message "
    "where event_date >= date '1996-01-01' and event_date <= date '1999-12-31'",
)
def b01(v):
    return filters.between_dates(v.message, "event_date", "1996-01-01", "1999-12-31").select(
        "message_id", "event_date", "game_code"
    )


@query(
    "b02_last_n_days",
    f"select event_date, count(*) as n from message "
    f"where event_date >= cast(date '{ORDERS_AS_OF}' - interval 365 day as date) group by event_date",
)
def b02(v):
    return (
        filters.last_n_days(v.message, "event_date", 365, ORDERS_AS_OF)
        .groupBy("event_date")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "b03_on_day",
    "select platform, count(*) as n from activity where event_date = date '2024-01-15' group by platform",
)
def b03(v):
    return filters.on_day(v.activity, "event_date", "2024-01-15").groupBy("platform").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "b04_around_instant",
    "select event_id, event_time, platform from activity where event_time >= timestamp '2024-01-15 11:00:00' "
    "and event_time <= timestamp '2024-01-15 17:00:00'",
)
def b04(v):
    return filters.around(v.activity, "event_time", "2024-01-15 14:00:00", "3 hours").select(
        "event_id", "event_time", "platform"
    )


@query(
    "b05_one_of",
    "select game_code, count(*) as n from message where game_code in ('F', 'O') group by game_code",
)
def b05(v):
    return filters.one_of(v.message, "game_code", ["F", "O"]).groupBy("game_code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b06_has_text",
    "select doc_id, lang, length(text) as chars from documents where text is not null and length(text) > 200",
)
def b06(v):
    return filters.has_text(v.documents, "text", 200).select(
        "doc_id", "lang", F.length("text").cast("bigint").alias("chars")
    )


@query(
    "b07_flagged",
    "select app_id, count(*) as negative_reviews from review where not voted_up group by app_id",
)
def b07(v):
    return filters.flagged(v.review, "voted_up", wanted=False).groupBy("app_id").agg(
        F.count(F.lit(1)).alias("negative_reviews")
    )


_MONTH_END = (
    "select cast(last_day(event_date) as date) as month_end, cast(sum(active_user) as bigint) as mau, "
    "count(*) as groups from kpi_daily {where} group by 1"
)


def _by_month_end(df):
    return df.groupBy(F.last_day("event_date").alias("month_end")).agg(
        F.sum("active_user").alias("mau"), F.count(F.lit(1)).alias("groups")
    )


@query("b08_month_end_only", _MONTH_END.format(where="where event_date = last_day(event_date)"))
def b08(v):
    return _by_month_end(filters.month_end_only(v.kpi_daily, "event_date"))


@query("b08_month_to_date", _MONTH_END.format(where=""))
def b08_mtd(v):
    return _by_month_end(filters.month_end_only(v.kpi_daily, "event_date", month_to_date=True))


@query(
    "b09_last_complete_month",
    "with monthly as (select last_day(event_date) as end_date, game_code, "
    "cast(sum(active_user) as bigint) as mau from kpi_daily group by 1, 2) "
    "select * from monthly where end_date = date '2001-07-31'",
)
def b09(v):
    monthly = v.kpi_daily.groupBy(F.last_day("event_date").alias("end_date"), "game_code").agg(
        F.sum("active_user").alias("mau")
    )
    return filters.last_complete_month(monthly, "end_date", ORDERS_AS_OF)


_KEEP_ACTIVE = """
select topic_id, count(distinct comment_id) as comments from topic left join {child} on url = topic_url
{where} group by topic_id"""


@query(
    "b10_keep_active",
    _KEEP_ACTIVE.format(child="(select * from comment where not is_deleted)", where=""),
)
def b10(v):
    kept = filters.keep_active(v.topic, v.comment.drop("event_date"), "url", "topic_url", "is_deleted")
    return kept.groupBy("topic_id").agg(F.countDistinct("comment_id").alias("comments"))


@query(
    "b10_keep_active_compat",
    _KEEP_ACTIVE.format(child="comment", where="where topic_url is null or not is_deleted"),
)
def b10_compat(v):
    kept = filters.keep_active(v.topic, v.comment.drop("event_date"), "url", "topic_url", "is_deleted", compat=True)
    return kept.groupBy("topic_id").agg(F.countDistinct("comment_id").alias("comments"))


@query(
    "b11_having",
    "select message_id, cast(sum(cnt) as bigint) as reactions from reaction group by message_id having sum(cnt) >= 100",
)
def b11(v):
    grouped = v.reaction.groupBy("message_id").agg(F.sum("cnt").alias("reactions"))
    return filters.having(grouped, F.col("reactions") >= 100)


@query(
    "b12_above_mean",
    f"with {DAILY_MESSAGES} select * from daily where messages >= (select avg(messages) * 1.8 from daily)",
)
def b12(v):
    return filters.above_mean(daily_messages(v), "messages", 1.8)


@query(
    "b13_spike_rule",
    """with d as (select event_date, count(*) as total, count(*) filter (not voted_up) as negative
       from review group by event_date),
       r as (select *, round(negative * 100.0::double / total, 2) as ratio,
             lag(negative) over (order by event_date) as before from d),
       g as (select *, case when before > 0 then round((negative - before) * 100.0::double / before, 2) end as growth from r)
       select event_date, negative, ratio, growth,
              coalesce(growth >= 50, false) or coalesce(negative >= 10 and ratio >= 40, false) as is_spike from g""",
)
def b13(v):
    daily = v.review.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("voted_up")).alias("negative")
    )
    series = daily.select("event_date", "negative", pct("negative", "total").alias("ratio"))
    return windows.detect_spikes(
        series, "event_date", "negative", "ratio", "growth", labels.SpikeRule(growth=50, count=10, ratio=40)
    )


@query(
    "b14_with_label",
    "select channel_id as id, channel_name as name, 'discord' as platform, guild_id from channel",
)
def b14(v):
    return filters.with_label(filters.rename(v.channel, id="channel_id", name="channel_name"), platform="discord")


@query(
    "b15_period_label",
    """select case when event_date < date '1997-01-01' then 'before'
                   when event_date <= date '1998-12-31' then 'during' else 'after' end as period,
              count(*) as messages from message group by 1""",
)
def b15(v):
    period = labels.period_label("event_date", "1997-01-01", "1998-12-31")
    return v.message.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("messages"))


@query(
    "b15_inside_label",
    """select case when event_date between date '1997-01-15' and date '1997-12-31' then 'event_period'
                   else 'normal_period' end as period_type, count(*) as messages from message group by 1""",
)
def b15_two_way(v):
    period = labels.inside_label("event_date", "1997-01-15", "1997-12-31", "event_period", "normal_period")
    return v.message.groupBy(period.alias("period_type")).agg(F.count(F.lit(1)).alias("messages"))


@query(
    "b16_change_label",
    f"""with {DAILY_MESSAGES},
        p as (select *, lag(messages) over (order by event_date) as before from daily),
        r as (select event_date, case when before > 0
              then round((messages - before) * 100.0::double / before, 2) end as rate from p)
        select event_date, rate,
          case when rate > 20 then '급증' when rate > 5 then '증가' when rate < -20 then '급감'
               when rate < -5 then '감소' else '안정' end as direction,
          case when abs(rate) > 30 then '큰 변화' when abs(rate) > 10 then '중간 변화' else '작은 변화' end as magnitude
        from r""",
)
def b16(v):
    rated = windows.pct_change(daily_messages(v), "messages", "event_date", "rate").drop("messages")
    return rated.withColumns(
        {"direction": labels.change_direction("rate"), "magnitude": labels.change_magnitude("rate")}
    )


@query(
    "b17_comovement_label",
    """with p as (select event_date, visits, adds, lag(visits) over (order by event_date) as v0,
               lag(adds) over (order by event_date) as a0 from traffic),
       r as (select event_date, case when v0 > 0 then round((visits - v0) * 100.0::double / v0, 2) end as t,
                    case when a0 > 0 then round((adds - a0) * 100.0::double / a0, 2) end as s from p)
       select event_date, t, s, case when t > 20 and s > 20 then '강한 양의 상관관계'
          when t > 20 and s < -20 then '강한 음의 상관관계' when t < -20 and s > 20 then '역상관관계'
          when abs(t) < 10 and abs(s) < 10 then '약한 상관관계' else '중간 상관관계' end as label from r""",
)
def b17(v):
    rated = windows.pct_change(v.traffic, "visits", "event_date", "t")
    rated = windows.pct_change(rated, "adds", "event_date", "s")
    return rated.select("event_date", "t", "s", labels.traffic_comovement("t", "s").alias("label"))


@query(
    "b18_run_template",
    """select o_custkey, cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,2)) as spend from orders
       where cast(o_orderdate as date) between date '1996-01-01' and date '1998-12-31' and o_orderstatus = 'F'
       group by o_custkey order by spend desc, o_custkey limit 25""",
)
def b18(v):
    return filters.run_template(
        v.spark,
        """select o_custkey, cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,2)) as spend
           from {orders} where cast(o_orderdate as date) between :start_date and :end_date
             and IDENTIFIER(:status_column) = :status
           group by o_custkey order by spend desc, o_custkey limit :limit_n""",
        {
            "start_date": ("DATE", "1996-01-01"),
            "end_date": ("TIMESTAMP", "1998-12-31"),
            "status": ("STRING", "F"),
            "status_column": ("STRING", "o_orderstatus"),
            "limit_n": ("LONG", 25),
        },
        orders=v.orders,
    )


@query(
    "b19_progress_label",
    """with i as (select run_id, max(iteration_number) as iteration, avg(case when passed then 1.0::double else 0 end) as score
              from bench_result group by run_id)
       select run_id, iteration, case when score >= 0.88 then 'Target Reached ✅' when iteration >= 5 then 'Max Iterations'
              else 'In Progress...' end as progress from i""",
)
def b19(v):
    runs = v.bench_result.groupBy("run_id").agg(
        F.max("iteration_number").alias("iteration"), F.avg(F.when(F.col("passed"), 1.0).otherwise(0.0)).alias("score")
    )
    label = labels.progress_label("score", F.lit(0.88), "iteration", F.lit(5), F.lit("RUNNING"))
    return runs.select("run_id", "iteration", label.alias("progress"))


@query(
    "b20_sentiment_flag",
    """select case when voted_up then 'positive' when not voted_up then 'negative' else 'unknown' end as sentiment,
              count(*) as reviews from review group by 1""",
)
def b20(v):
    return v.review.groupBy(labels.sentiment_flag("voted_up").alias("sentiment")).agg(
        F.count(F.lit(1)).alias("reviews")
    )


@query(
    "b20_sentiment_keywords",
    """select case when text like '%the%' or text like '%and%' then 'positive'
                   when text like '%que%' or text like '%der%' then 'negative' else 'neutral' end as sentiment,
              count(*) as documents from documents group by 1""",
)
def b20_keywords(v):
    label = labels.sentiment_keywords("text", ["the", "and"], ["que", "der"])
    return v.documents.groupBy(label.alias("sentiment")).agg(F.count(F.lit(1)).alias("documents"))


_PREVIOUS = """select o_orderstatus, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,2)) as revenue
from orders where cast(o_orderdate as date) >= date '{lo}' and cast(o_orderdate as date) < date '{hi}' group by 1"""


def _revenue_by_status(df):
    return df.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("revenue"),
    )


@query("b21_previous_quarter", _PREVIOUS.format(lo="2001-04-01", hi="2001-07-01"))
def b21(v):
    dated = v.orders.withColumn("day", F.to_date("o_orderdate"))
    return _revenue_by_status(filters.previous_period(dated, "day", "quarter", ORDERS_AS_OF))


@query("b21_previous_month", _PREVIOUS.format(lo="2001-07-01", hi="2001-08-01"))
def b21_month(v):
    dated = v.orders.withColumn("day", F.to_date("o_orderdate"))
    return _revenue_by_status(filters.previous_period(dated, "day", "month", ORDERS_AS_OF))


@query(
    "b02_last_n_months",
    "select month, count(*) as n from (select cast(date_trunc('month', event_date) as date) as month from message "
    "where event_date >= date '2001-05-01') m group by month",
)
def b02_months(v):
    recent = filters.last_n_months(v.message, "event_date", 3, ORDERS_AS_OF)
    return recent.groupBy(F.trunc("event_date", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b02_last_n_days_events",
    f"select platform, count(*) as n from activity "
    f"where event_date >= cast(date '{EVENTS_AS_OF}' - interval 7 day as date) group by platform",
)
def b02_events(v):
    return filters.last_n_days(v.activity, "event_date", 7, EVENTS_AS_OF).groupBy("platform").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "h20_percent_change",
    """with y as (select extract(year from event_date) as yr, count(*) as n from message group by 1)
       select a.yr, round((a.n - b.n) * 100.0::double / nullif(b.n, 0), 2) as growth
       from y a join y b on b.yr = a.yr - 1""",
)
def h20(v):
    yearly = v.message.groupBy(F.year("event_date").cast("bigint").alias("yr")).agg(F.count(F.lit(1)).alias("n"))
    before = yearly.select((F.col("yr") + 1).alias("yr"), F.col("n").alias("before"))
    return yearly.join(before, "yr").select("yr", percent_change("n", "before", guard="nonzero").alias("growth"))
