"""Aggregations over the stand-in views."""

from pyspark.sql import functions as F

from tidemark.catalog.kpi_queries import rate
from tidemark.functions import numbers, text
from tidemark.operators import aggregates, sets
from tidemark.plans.metrics import orders_metric_view, sales_snippets
from tidemark.registry import query


@query(
    "d01_profile",
    """select app_id, count(*) as row_count, cast(sum(votes_up) as bigint) as total, avg(votes_up) as mean,
              min(votes_up) as smallest, max(votes_up) as largest from review group by 1""",
)
def d01(v):
    return aggregates.profile(v.review, ["app_id"], "votes_up")


@query(
    "d02_distinct_counts",
    """select channel_id, count(distinct message_id) as messages, count(distinct author_id) as authors,
              count(distinct game_code) as games from message group by 1""",
)
def d02(v):
    return aggregates.distinct_counts(
        v.message, ["channel_id"], {"messages": "message_id", "authors": "author_id", "games": "game_code"}
    )


@query(
    "d02_approximate_counts",
    "select app_id, count(distinct recommendationid) as reviews, true as within_error from review group by 1",
)
def d02_approx(v):
    exact_counts = aggregates.distinct_counts(v.review, ["app_id"], {"reviews": "recommendationid"})
    sketch = aggregates.distinct_counts(v.review, ["app_id"], {"estimate": "recommendationid"}, approximate=True)
    error = F.abs(F.col("estimate") - F.col("reviews")) / F.col("reviews")
    return exact_counts.join(sketch, "app_id").select("app_id", "reviews", (error <= 0.15).alias("within_error"))


@query(
    "d03_sum0",
    """select topic_id, coalesce(cast(sum(case when is_deleted then 1 end) as bigint), 0) as deleted
       from topic left join comment on url = topic_url group by 1""",
)
def d03(v):
    deleted = v.comment.groupBy(F.col("topic_url").alias("url")).agg(
        F.sum(F.when(F.col("is_deleted"), 1)).alias("n")
    )
    return v.topic.join(deleted, "url", "left").groupBy("topic_id").agg(numbers.sum0("n").alias("deleted"))


@query(
    "d04_conditional_measures",
    """select app_id, count(*) filter (voted_up) as positive, count(distinct case when not voted_up then recommendationid end)
         as negative_reviews, cast(sum(votes_up) filter (voted_up) as bigint) as positive_votes from review group by 1""",
)
def d04(v):
    up = F.col("voted_up")
    return v.review.groupBy("app_id").agg(
        numbers.count_if(up).alias("positive"),
        numbers.count_distinct_if(~up, "recommendationid").alias("negative_reviews"),
        numbers.sum_if(up, "votes_up").alias("positive_votes"),
    )


@query(
    "d05_ratio_of_sums",
    f"""select user_type, {rate('cash_revenue', 'active_user')} as arpu,
         {rate('cash_paying_user', 'active_user', 4)} as pay_rate
       from kpi_daily group by 1""",
)
def d05(v):
    return v.kpi_daily.groupBy("user_type").agg(
        numbers.ratio("cash_revenue", "active_user").alias("arpu"),
        numbers.ratio("cash_paying_user", "active_user", 4).alias("pay_rate"),
    )


@query(
    "d06_average_of_ratios",
    """select platform, round(avg(paid_used::double / nullif(unit_sold, 0)::double), 2) as avg_price
       from product_sales group by 1""",
)
def d06(v):
    return v.product_sales.groupBy("platform").agg(numbers.avg_ratio("paid_used", "unit_sold").alias("avg_price"))


@query(
    "d07_percentage",
    """select app_id, round(count(*) filter (not voted_up) * 100.0::double / count(*), 2) as negative_ratio
       from review group by 1""",
)
def d07(v):
    counts = v.review.groupBy("app_id").agg(
        F.count_if(~F.col("voted_up")).alias("negative"), F.count(F.lit(1)).alias("n")
    )
    return counts.select("app_id", numbers.pct("negative", "n").alias("negative_ratio"))


@query(
    "d08_global_aggregate",
    """select count(*) as messages, count(distinct author_id) as authors, min(event_date) as first_day,
              max(event_date) as last_day, avg(length(message)) as mean_length from message""",
)
def d08(v):
    return v.message.agg(
        F.count(F.lit(1)).alias("messages"),
        F.countDistinct("author_id").alias("authors"),
        F.min("event_date").alias("first_day"),
        F.max("event_date").alias("last_day"),
        F.avg(F.length("message")).alias("mean_length"),
    )


@query(
    "d09_text_list_distinct",
    "select message_id, string_agg(distinct emoji_name, ', ' order by emoji_name) as emoji_list from reaction group by 1",
)
def d09(v):
    pairs = v.reaction.select("message_id", "emoji_name").distinct()
    return pairs.groupBy("message_id").agg(text.text_list_distinct("emoji_name").alias("emoji_list"))


@query(
    "d10_first_examples",
    """with n as (select run_id, question, count(*) as c from bench_result where not passed group by 1, 2),
            r as (select *, row_number() over (partition by run_id order by c desc, question) as rn from n)
       select run_id, list(question order by c desc, question) as examples from r where rn <= 3 group by 1""",
)
def d10(v):
    return aggregates.first_examples(v.bench_result.filter(~F.col("passed")), ["run_id"], "question", 3, "examples")


@query(
    "d11_two_level",
    """with m as (select message_id, cast(sum(cnt) as bigint) as r from reaction group by 1)
       select game_code, count(*) as messages, cast(sum(r) as bigint) as reactions, avg(r) as mean_reactions, max(r) as top
       from message join m using (message_id) group by 1""",
)
def d11(v):
    per_message = v.reaction.groupBy("message_id").agg(F.sum("cnt").alias("r"))
    return aggregates.two_level(
        v.message.join(per_message, "message_id"),
        ["game_code", "message_id"],
        {"r": F.max("r")},
        ["game_code"],
        {"messages": F.count(F.lit(1)), "reactions": F.sum("r"), "mean_reactions": F.avg("r"), "top": F.max("r")},
    )


@query(
    "d12_activity_score",
    """with r as (select message_id, sum(cnt) as n from reaction group by 1)
       select channel_id, count(*) + coalesce(sum(n), 0)::double * 0.5 as activity_score
       from message left join r using (message_id) group by 1""",
)
def d12(v):
    r = v.reaction.groupBy("message_id").agg(F.sum("cnt").alias("n"))
    return v.message.join(r, "message_id", "left").groupBy("channel_id").agg(
        numbers.activity_score(F.count(F.lit(1)), numbers.sum0("n")).alias("activity_score")
    )


@query(
    "d13_group_by_expression",
    """select cast(extract(hour from event_time) as integer) as hour_of_day, cast(date_trunc('week', event_date) as date) as week,
              count(*) as events from activity group by 1, 2""",
)
def d13(v):
    return v.activity.groupBy(
        F.hour("event_time").alias("hour_of_day"), F.trunc("event_date", "week").alias("week")
    ).agg(F.count(F.lit(1)).alias("events"))


@query(
    "d14_group_by_all",
    "select game_code, user_type, cast(sum(active_user) as bigint) as dau from kpi_daily group by all",
)
def d14(v):
    return v.spark.sql("select game_code, user_type, sum(active_user) as dau from {k} group by all", k=v.kpi_daily)


@query(
    "d15_pivot_max",
    """with d as (select event_date, user_type, cast(sum(active_user) as bigint) as dau from kpi_daily group by 1, 2)
       select event_date, max(case when user_type = 'BUILDING' then dau end) as building_dau,
         max(case when user_type = 'HOUSEHOLD' then dau end) as household_dau from d group by 1""",
)
def d15(v):
    daily = v.kpi_daily.groupBy("event_date", "user_type").agg(F.sum("active_user").alias("dau"))
    return aggregates.pivot_max(daily, ["event_date"], "user_type", ["BUILDING", "HOUSEHOLD"], {"dau": "dau"})


@query(
    "d16_count_map",
    """with c as (select run_id, failure_category as k, cast(count(*) as integer) as n from bench_result
                  where failure_category is not null group by 1, 2)
       select run_id, map_from_entries(list(struct_pack(k := k, v := n) order by k)) as failures from c group by 1""",
)
def d16(v):
    return aggregates.count_map(v.bench_result, ["run_id"], "failure_category", "failures")


@query(
    "d17_top_category",
    """with c as (select run_id, failure_category as k, count(*) as n from bench_result
                  where failure_category is not null group by 1, 2),
            r as (select *, row_number() over (partition by run_id order by n desc, k) as rn from c)
       select run_id, k as top_failure from r where rn = 1""",
)
def d17(v):
    return aggregates.top_category(v.bench_result, ["run_id"], "failure_category", "top_failure")


@query(
    "d18_score_rollup",
    """select run_id, iteration_number, count(*) as total, count(*) filter (passed) as passed,
         count(*) filter (not passed) as failed, count(*) filter (passed)::double / count(*) as score
       from bench_result group by 1, 2""",
)
def d18(v):
    return aggregates.score_rollup(v.bench_result, ["run_id", "iteration_number"])


@query(
    "d19_success_rate",
    """select change_type, avg(case when applied_successfully then 1.0::double else 0 end) as success_rate
       from change_row group by 1""",
)
def d19(v):
    return v.change_row.groupBy("change_type").agg(numbers.success_rate("applied_successfully").alias("success_rate"))


_MEASURES = """count(*) as order_count, count(distinct o_custkey) as customers,
  cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,2)) as revenue,
  cast(((2 * cast(round(sum(cast(o_totalprice as decimal(18,2)))::double * 1e2) as hugeint) + count(distinct o_custkey))
    // nullif(2 * count(distinct o_custkey), 0))::double / 1e2 as decimal(38,2)) as revenue_per_customer"""


@query(
    "d20_metric_view",
    f"""select r_name as region, o_orderstatus as status, {_MEASURES}
        from orders join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey
        left join region on n_regionkey = r_regionkey where cast(o_orderdate as date) >= date '1997-01-01' group by 1, 2""",
)
def d20(v):
    return orders_metric_view(v).query(
        dims=["region", "status"],
        measures=["order_count", "customers", "revenue", "revenue_per_customer"],
        where=F.to_date("o_orderdate") >= F.lit("1997-01-01").cast("date"),
    )


_LEVELS = f"""select r_name as region, o_orderstatus as status, cast(grouping(r_name) as integer) * 2
        + cast(grouping(o_orderstatus) as integer) as level, {_MEASURES}
        from orders join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey
        left join region on n_regionkey = r_regionkey group by {{how}}(r_name, o_orderstatus)"""


def _levels(v, how):
    view = orders_metric_view(v)
    frame = getattr(view, how)(
        dims=["region", "status"], measures=["order_count", "customers", "revenue", "revenue_per_customer"]
    )
    return frame.withColumn("level", F.col("level").cast("int"))


@query("d21_metric_cube", _LEVELS.format(how="cube"))
def d21_cube(v):
    return _levels(v, "cube")


@query("d21_metric_rollup", _LEVELS.format(how="rollup"))
def d21_rollup(v):
    return _levels(v, "rollup")


@query(
    "d22_recurring",
    """select benchmark_id, question, failure_category, count(*) as fail_count from bench_result where not passed
       group by 1, 2, 3 having count(*) >= 3""",
)
def d22(v):
    failed = v.bench_result.filter(~F.col("passed"))
    return aggregates.recurring(failed, ["benchmark_id", "question", "failure_category"], 3)


@query(
    "d23_named_snippets",
    """select cast(date_trunc('month', o_orderdate) as date) as order_month,
         cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,2)) as total_revenue, count(o_totalprice) as order_count,
         ((2 * cast(round(sum(cast(o_totalprice as decimal(18,2)))::double * 1e2) as hugeint) + count(*)) // (2 * count(*)))::double / 1e2
           as avg_order_value
       from orders where o_totalprice > 100000 and o_orderpriority = '1-URGENT' group by 1""",
)
def d23(v):
    return sales_snippets().query(
        v.orders, filters=["expensive", "urgent orders"], dims=["monthly"], measures=["sales", "count", "average"]
    )


@query(
    "d02_distinct_across_sources",
    """select platform, count(distinct id) as people from (select 'author' as platform, author_id as id from message
       union all select 'reviewer', reviewer_id from review) x group by 1""",
)
def d02_sources(v):
    people = sets.union_tagged(
        {
            "author": v.message.select(F.col("author_id").alias("id")),
            "reviewer": v.review.select(F.col("reviewer_id").alias("id")),
        }
    )
    return aggregates.distinct_counts(people, ["platform"], {"people": "id"})
