"""Joins over the stand-in views."""

from pyspark.sql import functions as F

from tidemark.functions.numbers import exact, sum0
from tidemark.operators import aggregates, filters, joins
from tidemark.registry import query


@query(
    "c01_join_children",
    """select m.message_id, coalesce(r.reactions, 0) as reactions from message m
       left join (select message_id, cast(sum(cnt) as bigint) as reactions from reaction group by 1) r
         on m.message_id = r.message_id""",
)
def c01(v):
    joined = joins.join_children(v.message, v.reaction, "message_id", {"reactions": F.sum("cnt")})
    return joined.select("message_id", F.coalesce("reactions", F.lit(0)).alias("reactions"))


@query(
    "c02_join_dimensions",
    """select channel_name, r_name, count(*) as messages from message m
       left join channel c on m.channel_id = c.channel_id left join region on guild_id = r_regionkey group by 1, 2""",
)
def c02(v):
    guild = v.region.select(F.col("r_regionkey").alias("guild_id"), "r_name")
    counts = v.message.groupBy("channel_id").agg(F.count(F.lit(1)).alias("messages"))
    joined = joins.join_dimensions(counts, (v.channel, "channel_id"), (guild, "guild_id"))
    return joined.groupBy("channel_name", "r_name").agg(F.sum("messages").alias("messages"))


@query(
    "c03_inner_join",
    """select o_orderkey, o_custkey, c_mktsegment, cast(o_totalprice as decimal(18,2)) as price
       from orders join customer on o_custkey = c_custkey""",
)
def c03(v):
    joined = v.orders.join(v.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", "o_custkey", "c_mktsegment", exact("o_totalprice").alias("price"))


@query(
    "c04_with_region",
    """select region_name, cast(sum(active_user) as bigint) as active_user from kpi_daily k
       left join region_dim r on k.country_code = r.country_code group by 1""",
)
def c04(v):
    by_country = v.kpi_daily.groupBy("country_code").agg(F.sum("active_user").alias("n"))
    return joins.with_region(by_country, v.region_dim).groupBy("region_name").agg(F.sum("n").alias("active_user"))


@query(
    "c05_composite_key_join",
    """with items as (select l_linestatus as platform, l_partkey as product_id, l_suppkey as sales_id,
                             max(l_tax) as top_tax, count(*) as listed from lineitem group by 1, 2, 3)
       select s.platform, i.listed, count(*) as sales, cast(sum(s.unit_sold) as bigint) as units
       from product_sales s left join items i
         on s.platform = i.platform and s.product_id = i.product_id and s.sales_id = i.sales_id
       group by 1, 2""",
)
def c05(v):
    keys = ["platform", "product_id", "sales_id"]
    items = v.lineitem.groupBy(
        F.col("l_linestatus").alias("platform"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("sales_id"),
    ).agg(F.count(F.lit(1)).alias("listed"))
    sold = v.product_sales.groupBy(*keys).agg(F.count(F.lit(1)).alias("sales"), F.sum("unit_sold").alias("units"))
    return joins.join_dimensions(sold, (items, keys)).groupBy("platform", "listed").agg(
        F.sum("sales").alias("sales"), F.sum("units").alias("units")
    )


@query(
    "c06_two_dimensions",
    """select p_type, s_nationkey, cast(sum(l_quantity) as bigint) as units from lineitem
       left join part on l_partkey = p_partkey left join supplier on l_suppkey = s_suppkey group by 1, 2""",
)
def c06(v):
    sold = v.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    product = v.part.select(F.col("p_partkey").alias("l_partkey"), "p_type")
    seller = v.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    joined = joins.join_dimensions(sold, (product, "l_partkey"), (seller, "l_suppkey"))
    return joined.groupBy("p_type", "s_nationkey").agg(F.sum("q").alias("units"))


@query(
    "c07_cast_key",
    """with named as (select cast(s_suppkey as varchar) as app_id, s_name from supplier
                      union all select 'none', 'no number')
       select s_name, count(*) as reviews from review r join named n on r.reviewer_id = try_cast(n.app_id as bigint) group by 1""",
)
def c07(v):
    named = v.supplier.select(F.col("s_suppkey").cast("string").alias("app_id"), "s_name").union(
        v.spark.createDataFrame([("none", "no number")], "app_id string, s_name string")
    )
    typed = joins.cast_key(named, "app_id", "bigint")
    per_reviewer = v.review.groupBy(F.col("reviewer_id").alias("app_id")).agg(F.count(F.lit(1)).alias("reviews"))
    return per_reviewer.join(typed, "app_id").groupBy("s_name").agg(F.sum("reviews").alias("reviews"))


@query(
    "c08_natural_key_join",
    """select t.topic_id, t.title, count(*) as comments, max(c.commented_at) as last_comment
       from topic t join comment c on t.url = c.topic_url group by 1, 2""",
)
def c08(v):
    per_topic = v.comment.groupBy(F.col("topic_url").alias("url")).agg(
        F.count(F.lit(1)).alias("comments"), F.max("commented_at").alias("last_comment")
    )
    return v.topic.join(per_topic, "url").select("topic_id", "title", "comments", "last_comment")


@query(
    "c09_key_and_date_join",
    """with p as (select l_suppkey as app, cast(l_shipdate as date) as d, count(*) as n from lineitem group by 1, 2),
            q as (select l_suppkey as app, cast(l_shipdate as date) as d, cast(sum(l_quantity) as bigint) as units
                  from lineitem where l_returnflag = 'R' group by 1, 2)
       select app, d, n, units from p join q using (app, d)""",
)
def c09(v):
    day = v.lineitem.select(
        F.col("l_suppkey").alias("app"), F.to_date("l_shipdate").alias("d"), "l_returnflag", "l_quantity"
    )
    p = day.groupBy("app", "d").agg(F.count(F.lit(1)).alias("n"))
    q = day.filter(F.col("l_returnflag") == "R").groupBy("app", "d").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("units")
    )
    return p.join(q, ["app", "d"])


@query(
    "c10_semi_join",
    """select app_id, count(*) as reviews from review
       where part_id in (select p_partkey from part where p_type = 'PROMO') group by 1""",
)
def c10(v):
    promo = v.part.filter(F.col("p_type") == "PROMO").select(F.col("p_partkey").alias("part_id"))
    return joins.semi(v.review, promo, "part_id").groupBy("app_id").agg(F.count(F.lit(1)).alias("reviews"))


@query(
    "c11_child_count",
    """select t.topic_id, (select count(distinct c.comment_id) from comment c where c.topic_url = t.url) as comments
       from topic t""",
)
def c11(v):
    return joins.child_count(v.topic, v.comment, "url", "topic_url", "comment_id", "comments").select(
        "topic_id", "comments"
    )


_SPIKES = """spikes as (select event_date, visits from traffic
    where visits >= (select avg(visits) * 1.1 from traffic)),
    daily as (select event_date, platform, count(*) as n from activity group by 1, 2)"""


def _spikes(v):
    return filters.above_mean(v.traffic, "visits", 1.1).select("event_date", "visits")


@query(
    "c12_window_join",
    f"""with {_SPIKES}
       select s.event_date as spike_date, s.visits, d.platform, cast(sum(d.n) as bigint) as events from spikes s
       left join daily d on d.event_date between s.event_date - interval 1 day and s.event_date + interval 1 day
       group by 1, 2, 3""",
)
def c12(v):
    daily = v.activity.groupBy("event_date", "platform").agg(F.count(F.lit(1)).alias("n"))
    spikes = _spikes(v).withColumnRenamed("event_date", "spike_date")
    return joins.window_totals(
        spikes, "spike_date", daily, "event_date", 1, 1, ["platform"], {"events": F.sum("n")}
    )


@query(
    "c13_bounded_by",
    f"""with {_SPIKES} select platform, count(*) as n from activity
       where event_date >= (select min(event_date) - interval 1 day from spikes)
         and event_date <= (select max(event_date) + interval 1 day from spikes) group by 1""",
)
def c13(v):
    return joins.bounded_by(v.activity, "event_date", _spikes(v), "event_date", 1).groupBy("platform").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "c14_literal_dim",
    """select g.game_name, count(*) as messages from message m
       join (values ('Final', 'F'), ('Open', 'O')) g(game_name, game_code) on m.game_code = g.game_code group by 1""",
)
def c14(v):
    games = joins.literal_dim(v.spark, "game_name string, game_code string", [("Final", "F"), ("Open", "O")])
    counts = v.message.groupBy("game_code").agg(F.count(F.lit(1)).alias("messages"))
    return counts.join(games, "game_code").select("game_name", "messages")


_ALIGN = """with a as (select event_date, count(*) as messages from message group by 1),
    b as (select event_date, count(*) as reviews from review group by 1)
    select {date} as event_date, {m} as messages, coalesce(b.reviews, 0) as reviews
    from a {how} join b on a.event_date = b.event_date"""


def _two_series(v):
    a = v.message.groupBy("event_date").agg(F.count(F.lit(1)).alias("messages"))
    return a, v.review.groupBy("event_date").agg(F.count(F.lit(1)).alias("reviews"))


@query("c15_align_series", _ALIGN.format(date="a.event_date", m="a.messages", how="left"))
def c15(v):
    return joins.align_series(*_two_series(v), "event_date", ["reviews"])


@query(
    "c15_align_series_full",
    _ALIGN.format(date="coalesce(a.event_date, b.event_date)", m="coalesce(a.messages, 0)", how="full outer"),
)
def c15_full(v):
    return joins.align_series(*_two_series(v), "event_date", ["messages", "reviews"], how="full")


@query(
    "c16_with_latest_child",
    """with ranked as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn
                       from orders)
       select c_custkey, o_orderkey, o_orderdate, o_orderstatus from customer
       left join ranked on c_custkey = o_custkey and rn = 1""",
)
def c16(v):
    parent = v.customer.select("c_custkey")
    child = v.orders.withColumnRenamed("o_custkey", "c_custkey")
    return joins.with_latest_child(
        parent, child, "c_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate", "o_orderstatus"]
    )


@query(
    "c17_pair_by_id",
    """select d.doc_id as benchmark_id, d.lang, l.quality, n.n_chars from documents d
       join labels l on d.doc_id = l.doc_id join documents n on n.doc_id = d.doc_id""",
)
def c17(v):
    asked = v.documents.select(F.col("doc_id").alias("benchmark_id"), "lang")
    judged = v.labels.select(F.col("doc_id").alias("benchmark_id"), "quality")
    executed = v.documents.select(F.col("doc_id").alias("benchmark_id"), "n_chars")
    return joins.pair_by_id(asked, judged, executed)


@query(
    "c18_remove_keys",
    "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)",
)
def c18(v):
    buyers = v.orders.filter(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("c_custkey"))
    return joins.remove_keys(v.customer, buyers, "c_custkey").select("c_custkey", "c_name")


@query(
    "c19_safe_join_agg",
    """with o as (select o_custkey as k, count(*) as orders_placed,
                         cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,2)) as spend from orders group by 1),
            l as (select o_custkey as k, count(*) as lines, cast(sum(l_quantity) as bigint) as units
                  from orders join lineitem on o_orderkey = l_orderkey group by 1)
       select o.k, orders_placed, spend, lines, units from o left join l on o.k = l.k""",
)
def c19(v):
    orders = v.orders.withColumnRenamed("o_custkey", "k")
    per_order = v.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("q")
    )
    lines = orders.select("k", "o_orderkey").join(per_order, "o_orderkey")
    return joins.safe_join_agg(
        [
            (
                orders,
                {
                    "orders_placed": F.count(F.lit(1)),
                    "spend": F.sum(exact("o_totalprice")).cast("decimal(38,2)"),
                },
            ),
            (lines, {"lines": F.sum("n"), "units": F.sum("q")}),
        ],
        ["k"],
    )


@query(
    "c20_sequence_next",
    """select * from (select user_id, event_time, event_id, platform,
          lead(event_time) over w as next_event_time, lead(event_id) over w as next_event_id,
          lead(platform) over w as next_platform
       from activity window w as (partition by user_id order by event_time, event_id)) s
       where next_event_id is not null""",
)
def c20(v):
    return joins.sequence_next(
        v.activity.select("user_id", "event_time", "event_id", "platform"),
        "user_id",
        ["event_time", "event_id"],
        ["event_time", "event_id", "platform"],
    )


@query(
    "c20_later_row_count",
    """select event_id, user_id, count(*) over (partition by user_id) - row_number()
         over (partition by user_id order by event_time, event_id) as later_events from activity""",
)
def c20_counts(v):
    numbered = joins.later_row_count(
        v.activity.select("event_id", "user_id", "event_time"), "user_id", ["event_time", "event_id"], "later_events"
    )
    return numbered.select("event_id", "user_id", "later_events")


@query(
    "c21_one_sided_condition",
    """select o_orderstatus, c_mktsegment, count(*) as n from orders
       left join customer on o_custkey = c_custkey and cast(o_orderdate as date) >= date '2000-01-01' group by 1, 2""",
)
def c21(v):
    segment = v.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    joined = joins.left_join_since(v.orders, segment, "o_custkey", "o_orderdate", "2000-01-01")
    return joined.groupBy("o_orderstatus", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c11_child_count_by_group",
    """select subforum, count(*) as topics, cast(sum(n) as bigint) as comments from
       (select t.subforum, t.url, count(distinct c.comment_id) as n from topic t left join comment c on c.topic_url = t.url
        group by 1, 2) x group by 1""",
)
def c11_group(v):
    counted = joins.child_count(v.topic, v.comment, "url", "topic_url", "comment_id", "n")
    return aggregates.two_level(
        counted,
        ["subforum", "url"],
        {"n": F.max("n")},
        ["subforum"],
        {"topics": F.count(F.lit(1)), "comments": sum0("n")},
    )
