"""Ordered comparisons, rankings and unions over the stand-in views."""

from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.functions.numbers import exact, pct
from tidemark.operators import aggregates, ranking, sets, sliced, windows
from tidemark.registry import query
from tidemark.session import materialize

_DAILY = "d as (select event_date, count(*) as n, count(distinct author_id) as a from message group by 1)"


def _daily(v):
    return v.message.groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))


@query(
    "w01_pct_change_global",
    f"""with {_DAILY}, p as (select event_date, n, lag(n) over (order by event_date) as previous from d)
        select *, case when previous > 0 then round((n - previous) * 100.0::double / previous, 2) end as rate from p""",
)
def w01(v):
    return windows.pct_change(_daily(v), "n", "event_date", "rate", previous="previous")


_PARTITIONED = """with d as (select app_id, event_date, count(*) - 8 as n from review group by 1, 2),
    p as (select *, lag(n) over (partition by app_id order by event_date) as previous from d)
    select app_id, event_date, n, {rate} as rate from p"""


def _by_app(v):
    return v.review.groupBy("app_id", "event_date").agg((F.count(F.lit(1)) - 8).alias("n"))


@query(
    "w01_pct_change_partitioned",
    _PARTITIONED.format(rate="case when previous > 0 then round((n - previous) * 100.0::double / previous, 2) end"),
)
def w01_partitioned(v):
    return windows.pct_change(_by_app(v), "n", "event_date", "rate", partition=["app_id"])


@query(
    "w01b_pct_change_nonzero",
    _PARTITIONED.format(rate="round((n - previous) * 100.0::double / nullif(previous, 0), 2)"),
)
def w01b(v):
    return windows.pct_change(_by_app(v), "n", "event_date", "rate", partition=["app_id"], guard="nonzero")


@query(
    "w01c_pct_change_absolute",
    _PARTITIONED.format(
        rate="case when previous <> 0 then round((n - previous) * 100.0::double / abs(previous), 2) end"
    ),
)
def w01c(v):
    return windows.pct_change(_by_app(v), "n", "event_date", "rate", partition=["app_id"], guard="abs")


@query(
    "w01d_lag_over_aggregate",
    """select platform, event_date, cast(sum(1) as bigint) as n,
         case when lag(sum(1)) over w > 0 then round((sum(1) - lag(sum(1)) over w)::double * 100.0::double
              / (lag(sum(1)) over w)::double, 2) end as growth
       from activity group by platform, event_date window w as (partition by platform order by event_date)""",
)
def w01d(v):
    daily = v.activity.groupBy("platform", "event_date").agg(F.count(F.lit(1)).alias("n"))
    return windows.pct_change(daily, "n", "event_date", "growth", partition=["platform"])


@query(
    "w02_lagged_effect",
    """with g as (select event_date, visits, adds, lag(visits) over o as v0, lag(adds) over o as a0 from traffic
                  window o as (order by event_date)),
       r as (select event_date, case when v0 > 0 then round((visits - v0) * 100.0::double / v0, 2) end as t,
                    case when a0 > 0 then round((adds - a0) * 100.0::double / a0, 2) end as s from g)
       select event_date, t, s, case when t > 5 and lag(s, 1) over (order by event_date) > 5 then '1일 지연 효과'
           when t > 5 and lag(s, 2) over (order by event_date) > 5 then '2일 지연 효과' else '즉시 반응' end as response_timing
       from r""",
)
def w02(v):
    rated = windows.pct_change(v.traffic, "visits", "event_date", "t")
    rated = windows.pct_change(rated, "adds", "event_date", "s").select("event_date", "t", "s")
    one, two, now = labels.TIMING_LABELS
    return windows.lagged_effect(rated, "t", "s", "event_date", [1, 2], [one, two], now, strong=5)


@query(
    "w03_top1_per_group",
    """with c as (select user_id, hour(event_time) as h, count(*) as n from activity group by 1, 2),
            r as (select *, row_number() over (partition by user_id order by n desc, h) as rn from c)
       select user_id, cast(h as integer) as peak_hour, n from r where rn = 1""",
)
def w03(v):
    counts = v.activity.groupBy("user_id", F.hour("event_time").alias("peak_hour")).agg(F.count(F.lit(1)).alias("n"))
    return windows.top1_per_group(counts, ["user_id"], [-F.col("n"), F.col("peak_hour")], ["peak_hour", "n"])


_LATEST = """with r as (select *, row_number() over (partition by recommendationid
    order by event_date desc, revision desc, app_id desc, voted_up desc, votes_up desc, weighted_vote_score desc,
             part_id desc, reviewer_id desc, playtime desc) as rn from review)
    select app_id, count(*) as reviews, cast(sum(votes_up) as bigint) as votes from r {where} group by 1"""


def _reviews(v, snapshot):
    chosen = windows.snapshot_view(v.review, ["recommendationid"], ["event_date", "revision"], snapshot)
    return chosen.groupBy("app_id").agg(F.count(F.lit(1)).alias("reviews"), F.sum("votes_up").alias("votes"))


@query("w04_snapshot_latest", _LATEST.format(where="where rn = 1"))
def w04_view(v):
    return _reviews(v, "latest")


@query("w04_snapshot_raw", _LATEST.format(where=""))
def w04_raw(v):
    return _reviews(v, "raw")


@query(
    "w04_latest_record",
    """select recommendationid, event_date, revision, votes_up, voted_up from
       (select *, row_number() over (partition by recommendationid order by event_date desc, revision desc, votes_up desc,
          voted_up desc) as rn
        from review) r where rn = 1""",
)
def w04(v):
    kept = v.review.select("recommendationid", "event_date", "revision", "votes_up", "voted_up")
    return windows.latest_record(kept, ["recommendationid"], ["event_date", "revision", "votes_up", "voted_up"])


@query(
    "w05_rank_by",
    """with c as (select l_suppkey, count(*) as n, cast(sum(l_quantity) as bigint) as q from lineitem group by 1)
       select l_suppkey, n, q, rank() over (order by n desc) as by_count, rank() over (order by q) as by_quantity from c""",
)
def w05(v):
    c = v.lineitem.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("q")
    )
    suppliers = materialize(c, "supplier-counts")
    return sliced.competition_ranks(suppliers, [], {"by_count": ("n", True), "by_quantity": ("q", False)})


@query(
    "w06_share_of_total",
    """with c as (select channel_id, count(*) as n from message group by 1)
       select channel_id, n, round(n::double * 100.0::double / (select sum(n) from c)::double, 2) as share from c""",
)
def w06(v):
    c = v.message.groupBy("channel_id").agg(F.count(F.lit(1)).alias("n"))
    return windows.share(c, "n", "share")


@query(
    "w07_share_in_partition",
    """select event_date, user_type, cast(sum(active_user) as bigint) as dau,
         round(sum(active_user)::double * 100.0::double / (sum(sum(active_user)) over (partition by event_date))::double, 2) as share
       from kpi_daily group by event_date, user_type""",
)
def w07(v):
    c = v.kpi_daily.groupBy("event_date", "user_type").agg(F.sum("active_user").alias("dau"))
    return windows.share(c, "dau", "share", ["event_date"])


@query(
    "w08_with_total",
    """with c as (select cast(date_trunc('week', event_date) as date) as week, platform, count(*) as n from activity group by 1, 2)
       select *, cast(sum(n) over (partition by week) as bigint) as week_total from c""",
)
def w08(v):
    c = v.activity.groupBy(F.trunc("event_date", "week").alias("week"), "platform").agg(F.count(F.lit(1)).alias("n"))
    return windows.with_total(c, ["week"], {"week_total": "n"})


_RATIO = """d as (select event_date, round(count(*) filter (not voted_up) * 100.0::double / count(*), 2) as ratio
    from review group by 1), p as (select *, lag(ratio) over (order by event_date) as previous from d)"""


def _negative_ratio(v):
    c = v.review.groupBy("event_date").agg(
        F.count_if(~F.col("voted_up")).alias("negative"), F.count(F.lit(1)).alias("n")
    )
    return c.select("event_date", pct("negative", "n").alias("ratio"))


@query("w09_delta_prev", f"with {_RATIO} select *, ratio - previous as change from p")
def w09(v):
    return windows.delta_prev(_negative_ratio(v), "ratio", "event_date", "change", "previous")


@query("w09_jump_rows", f"with {_RATIO} select *, ratio - previous as change from p where ratio - previous > 10")
def w09_jumps(v):
    return windows.jump_rows(_negative_ratio(v), "ratio", "event_date", "change", "previous", 10)


@query(
    "w10_detect_spikes",
    """with d as (select event_date, count(*) filter (not voted_up) as negative,
              round(count(*) filter (not voted_up) * 100.0::double / count(*), 2) as ratio from review group by 1),
       p as (select *, lag(negative) over (order by event_date) as b from d)
       select event_date, negative, ratio, case when b > 0 then round((negative - b) * 100.0::double / b, 2) end as growth
       from p where (b > 0 and round((negative - b) * 100.0::double / b, 2) >= 80) or (negative >= 12 and ratio >= 45)""",
)
def w10(v):
    series = v.review.groupBy("event_date").agg(
        F.count_if(~F.col("voted_up")).alias("negative"), F.count(F.lit(1)).alias("n")
    ).select("event_date", "negative", pct("negative", "n").alias("ratio"))
    found = windows.detect_spikes(
        series, "event_date", "negative", "ratio", "growth", labels.SpikeRule(growth=80, count=12, ratio=45)
    )
    return found.filter("is_spike").drop("is_spike")


# The check replays the loop one trial at a time per run.
@query(
    "w11_decide_trials",
    """with recursive t as (
         select o_custkey as run, o_orderkey as trial, o_totalprice as score,
                o_orderpriority = '5-LOW' and o_orderstatus = 'P' as failed,
                row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as i from orders),
       loop as (
         select run, trial, i, score, failed, 150000.0::double as to_beat,
                case when failed or score <= 150000 then 150000.0::double else score end as best,
                not failed and greatest(score, 150000) >= 420000 as done from t where i = 1
         union all
         select t.run, t.trial, t.i, t.score, t.failed, loop.best,
                case when t.failed or t.score <= loop.best then loop.best else t.score end,
                not t.failed and greatest(t.score, loop.best) >= 420000
         from loop join t on t.run = loop.run and t.i = loop.i + 1 where not loop.done)
       select run, trial, to_beat as score_to_beat, case when failed then 'error' when score > to_beat then 'improved'
              when score < to_beat then 'regressed' else 'unchanged' end as decision, not failed and score >= to_beat as kept
       from loop""",
)
def w11(v):
    trials = v.orders.select(
        F.col("o_custkey").alias("run"),
        F.col("o_orderkey").alias("trial"),
        "o_orderdate",
        F.col("o_totalprice").alias("score"),
        ((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")).alias("failed"),
        F.lit(150000.0).alias("initial"),
    )
    decided = windows.decide_trials(
        trials, ["run"], ["o_orderdate", "trial"], "score", "initial", 420000.0, failed="failed"
    )
    return decided.select("run", "trial", "score_to_beat", "decision", "kept")


@query(
    "w12_stop_signals",
    """with s as (select run_id, iteration_number as i, count(*) filter (passed)::double / count(*) as score
                  from bench_result group by 1, 2),
       g as (select *, score - lag(score) over (partition by run_id order by i) as score_gain from s),
       f as (select *, case when score_gain < 0.05 then 1 else 0 end as flat,
                    case when score_gain < 0 then 1 else 0 end as fall from g),
       k as (select *, score >= 0.95 as target_reached, i >= 5 as cap_reached,
                    sum(flat) over (partition by run_id order by i rows between 2 preceding and current row) = 3 as no_gain,
                    sum(fall) over (partition by run_id order by i rows between 1 preceding and current row) = 2 as degrading
             from f)
       select run_id, i, score, score_gain, target_reached, cap_reached, no_gain, degrading,
              target_reached or cap_reached or no_gain or degrading as stop from k""",
)
def w12(v):
    scored = aggregates.score_rollup(
        v.bench_result.withColumnRenamed("iteration_number", "i"), ["run_id", "i"]
    ).select("run_id", "i", "score")
    return windows.stop_signals(scored, "run_id", "i", "score", target=0.95, cap=5)


@query(
    "w00_running_number",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint) as q,
         row_number() over (partition by l_returnflag order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
           l_quantity, l_extendedprice) as number from lineitem""",
)
def w00(v):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    numbered = sliced.running_number(v.lineitem.select("l_returnflag", *order), ["l_returnflag"], order, "number")
    return numbered.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"), "number"
    )


@query(
    "f01_top_n",
    """select message_id, cast(sum(cnt) as bigint) as reactions from reaction group by 1
       order by reactions desc, message_id limit 20""",
)
def f01(v):
    grouped = v.reaction.groupBy("message_id").agg(F.sum("cnt").alias("reactions"))
    return ranking.top_n(grouped, [F.col("reactions").desc()], 20, ["message_id"])


@query(
    "f02_top_n_two_keys",
    """select recommendationid, votes_up, weighted_vote_score, part_id, reviewer_id, event_date from review
       order by votes_up desc, weighted_vote_score desc, recommendationid, part_id, reviewer_id, event_date limit 20""",
)
def f02(v):
    return ranking.top_n(
        v.review.select("recommendationid", "votes_up", "weighted_vote_score", "part_id", "reviewer_id", "event_date"),
        [F.col("votes_up").desc(), F.col("weighted_vote_score").desc()],
        20,
        ["recommendationid", "part_id", "reviewer_id", "event_date"],
    )


@query(
    "f03_order_by_labels",
    """select game_code, case when event_date < date '1997-01-01' then 'before' when event_date <= date '1998-12-31'
         then 'during' else 'after' end as period, count(*) as n from message group by 1, 2
       order by 1, case period when 'before' then 1 when 'during' then 2 else 3 end""",
)
def f03(v):
    period = labels.period_label("event_date", "1997-01-01", "1998-12-31").alias("period")
    grouped = v.message.groupBy("game_code", period).agg(F.count(F.lit(1)).alias("n"))
    return ranking.order_by_labels(grouped, ["game_code"], "period", ["before", "during", "after"])


@query(
    "f04_latest_n",
    "select event_id, event_time, user_id from activity order by event_time desc, event_id limit 50",
)
def f04(v):
    return ranking.latest_n(v.activity.select("event_id", "event_time", "user_id"), "event_time", 50, ["event_id"])


@query(
    "f05_mixed_order",
    """select event_date, user_type, cast(sum(active_user) as bigint) as dau from kpi_daily group by 1, 2
       order by event_date desc, dau desc, user_type""",
)
def f05(v):
    grouped = v.kpi_daily.groupBy("event_date", "user_type").agg(F.sum("active_user").alias("dau"))
    return grouped.orderBy(F.col("event_date").desc(), F.col("dau").desc(), "user_type")


@query(
    "g01_union_tagged",
    """select platform, count(*) as n, max(d) as newest from (select 'discord' as platform, event_date as d from message
       union all select 'steam_review', event_date from review union all select 'steam_comment', event_date from comment) u group by 1""",
)
def g01(v):
    dated = {
        "discord": v.message.select("event_date"),
        "steam_review": v.review.select("event_date"),
        "steam_comment": v.comment.select("event_date"),
    }
    return sets.union_tagged(dated).groupBy("platform").agg(
        F.count(F.lit(1)).alias("n"), F.max("event_date").alias("newest")
    )


@query(
    "g02_union_padded",
    """select platform, count(*) as n, count(author) as with_author from (select 'discord' as platform, author_id as author from message
       union all select 'steam_review', null from review) u group by 1""",
)
def g02(v):
    parts = {
        "discord": v.message.select("event_date", F.col("author_id").alias("author")),
        "steam_review": v.review.select("event_date"),
    }
    return sets.union_tagged(parts, pad=True).groupBy("platform").agg(
        F.count(F.lit(1)).alias("n"), F.count("author").alias("with_author")
    )


@query(
    "g03_union_same_shape",
    """with a as (select event_date, count(*) as n from message group by 1), b as (select event_date, count(*) as n from review group by 1)
       select * from a union all select * from b""",
)
def g03(v):
    return sets.union_all(*[x.groupBy("event_date").agg(F.count(F.lit(1)).alias("n")) for x in (v.message, v.review)])


@query(
    "g04_union_distinct",
    "select author_id as id, event_date from message union select reviewer_id, event_date from review",
)
def g04(v):
    return sets.union_distinct(
        v.message.select(F.col("author_id").alias("id"), "event_date"),
        v.review.select(F.col("reviewer_id").alias("id"), "event_date"),
    )


@query(
    "d03_revenue_by_status",
    """select o_orderstatus, cast(coalesce(sum(cast(o_totalprice as decimal(18,2))), 0) as decimal(38,2)) as revenue
       from orders group by 1""",
)
def d03_revenue(v):
    return v.orders.groupBy("o_orderstatus").agg(
        F.coalesce(F.sum(exact("o_totalprice")), F.lit(0)).cast("decimal(38,2)").alias("revenue")
    )
