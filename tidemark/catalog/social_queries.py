"""Community signal reports over the stand-in views."""

from pyspark.sql import functions as F

from tidemark.functions.labels import SpikeRule
from tidemark.operators import joins
from tidemark.plans import social
from tidemark.plans.social import Community
from tidemark.registry import query


def community(v) -> Community:
    return Community(v.message, v.reaction, v.channel, v.review, v.topic, v.comment)


PER_MESSAGE = """pm as (select m.*, coalesce((select cast(sum(cnt) as bigint) from reaction r where r.message_id = m.message_id), 0) as rc
    from message m)"""
PER_TOPIC = "pt as (select t.*, (select count(distinct comment_id) from comment c where c.topic_url = t.url) as rc from topic t)"


def contents(lo: str, hi: str) -> str:
    span = f"event_date between date '{lo}' and date '{hi}'"
    return f"""{PER_MESSAGE}, {PER_TOPIC}, items as (
      select 'discord' as platform, cast(message_id as varchar) as id, message as body, created_at as tm, rc, null as mood from pm where {span}
      union all select 'steam_review', cast(recommendationid as varchar), 'part ' || cast(part_id as varchar),
        cast(event_date as timestamp), votes_up, case when voted_up then 'positive' else 'negative' end from review where {span}
      union all select 'steam_topic', cast(topic_id as varchar), title, cast(event_date as timestamp), rc, null from pt where {span})"""


WHOLE = ("1996-01-01", "2000-12-31")


def whole(v) -> Community:
    return community(v).within(*WHOLE)


@query(
    "j01_most_reacted_messages",
    """select m.message_id, m.created_at, c.channel_name, cast(sum(r.cnt) as bigint) as reaction_count,
         count(distinct r.emoji_name) as unique_emojis, string_agg(distinct r.emoji_name, ', ' order by r.emoji_name) as emoji_list
       from message m left join reaction r on m.message_id = r.message_id left join channel c on m.channel_id = c.channel_id
       where m.event_date between date '1996-01-01' and date '2000-12-31' group by 1, 2, 3 having coalesce(sum(r.cnt), 0) > 0
       order by reaction_count desc, m.message_id limit 20""",
)
def j01(v):
    return social.most_reacted_messages(whole(v))


_REVIEW_ORDER = "votes_up desc, weighted_vote_score desc, recommendationid, event_date, revision, part_id, reviewer_id, playtime"


@query("j02_most_upvoted_reviews", f"select * from review order by {_REVIEW_ORDER} limit 20")
def j02(v):
    return social.most_upvoted_reviews(v.review)


@query(
    "j02_most_upvoted_latest",
    f"""with r as (select *, row_number() over (partition by recommendationid order by event_date desc, revision desc,
          app_id desc, voted_up desc, votes_up desc, weighted_vote_score desc, part_id desc, reviewer_id desc, playtime desc) as rn from review)
        select * exclude (rn) from r where rn = 1 order by {_REVIEW_ORDER} limit 20""",
)
def j02_latest(v):
    return social.most_upvoted_reviews(v.review, snapshot="latest")


@query(
    "j03_most_reacted_platforms",
    f"""with {contents(*WHOLE)} select platform, count(*) as content_count, cast(sum(rc) as bigint) as total_reactions,
          max(rc) as max_reactions, max(body) as sample_content from items where rc > 0 group by 1""",
)
def j03(v):
    return social.most_reacted_platforms(whole(v))


def reactions(v):
    """Activity with a whole-number engagement."""
    return v.activity.withColumn("reactions", F.floor("engagement").cast("bigint"))


_REACTIONS = "ev as (select *, cast(floor(engagement) as bigint) as reactions from activity)"


@query(
    "j04_hot_channels_by_hour",
    f"""with {_REACTIONS} select date_trunc('hour', event_time)::timestamp as hour_bucket, platform, count(*) as message_count,
          cast(sum(reactions) as bigint) as total_reactions, round(avg(reactions), 2) as avg_reactions, max(reactions) as max_reactions
        from ev group by 1, 2 order by total_reactions desc, hour_bucket, platform limit 10""",
)
def j04(v):
    return social.hot_channels_by_hour(reactions(v))


@query(
    "j05_most_commented_topics",
    """select topic_id, title, subforum, count(distinct comment_id) as comment_count, count(distinct author) as unique_commenters,
         max(commented_at) as last_comment_time from topic t left join comment c on t.url = c.topic_url
       where t.event_date between date '1995-01-01' and date '1996-12-31' and (c.comment_id is null or not c.is_deleted)
       group by 1, 2, 3 having count(distinct comment_id) > 0 order by comment_count desc, topic_id limit 20""",
)
def j05(v):
    return social.most_commented_topics(community(v).within("1995-01-01", "1996-12-31"))


_VOLUME = """vol as (select 'discord' as platform, count(distinct message_id) as content_count, cast(coalesce(sum(rc), 0) as bigint) as total_reactions,
      round(avg(length(message)), 2) as avg_content_length from pm where event_date between date '1996-01-01' and date '2000-12-31' and length(message) > {least}
    union all select 'steam_review', count(distinct recommendationid), cast(sum(votes_up) as bigint), round(avg(length(cast(part_id as varchar))), 2)
      from review where event_date between date '1996-01-01' and date '2000-12-31'
    union all select 'steam_topic', count(distinct topic_id), (select count(distinct comment_id) from comment where topic_url in
      (select url from topic where event_date between date '1996-01-01' and date '2000-12-31')), round(avg(length(title)), 2)
      from topic where event_date between date '1996-01-01' and date '2000-12-31'
    union all select 'steam_comment', count(distinct comment_id), 0, round(avg(length(topic_url)), 2) from comment)"""


@query("j06_content_volume", f"with {PER_MESSAGE}, {_VOLUME.format(least=10)} select * from vol")
def j06(v):
    return social.content_volume(whole(v))


@query(
    "j07_active_channels",
    f"""with {PER_MESSAGE}, p as (select * from pm where event_date between date '1996-01-01' and date '2000-12-31')
        select c.channel_id, channel_name, guild_id, count(distinct message_id) as message_count, count(distinct author_id) as unique_authors,
          cast(sum(rc) as bigint) as reaction_count, (select count(distinct emoji_name) from reaction r join p q on q.message_id = r.message_id
             where q.channel_id = c.channel_id) as unique_emojis,
          count(distinct message_id) + sum(rc)::double * 0.5 as activity_score, min(created_at) as first_message_time, max(created_at) as last_message_time
        from channel c join p on p.channel_id = c.channel_id group by 1, 2, 3 order by activity_score desc, channel_id limit 20""",
)
def j07(v):
    return social.active_channels(whole(v)).select(
        "channel_id", "channel_name", "guild_id", "message_count", "unique_authors", "reaction_count", "unique_emojis",
        "activity_score", "first_message_time", "last_message_time",
    )


@query(
    "j08_busiest_hours",
    """with b as (select cast(hour(event_time) as integer) as hour_of_day, date_trunc('hour', event_time) as bucket, platform, count(distinct event_id) as m,
                  case when platform = 'error' then null else count(distinct user_id) end as a from activity group by 1, 2, 3)
       select hour_of_day, cast(sum(m) as bigint) as total_mentions, cast(sum(coalesce(a, 0)) as bigint) as total_unique_authors,
         count(distinct platform) as platform_count, string_agg(distinct platform, ', ' order by platform) as platforms,
         round(avg(m), 2) as avg_mentions_per_hour from b group by 1""",
)
def j08(v):
    events = v.activity.withColumn("user_id", F.when(F.col("platform") != "error", F.col("user_id")))
    return social.busiest_hours(events)


_PROFILE = """count(*) as content_count, cast(sum(rc) as bigint) as total_reactions, avg(rc) as avg_reactions,
  max(rc) as max_reactions, min(tm) as earliest_time, max(tm) as latest_time"""


@query(
    "j09_high_engagement",
    f"""with {contents(*WHOLE)} select case when platform = 'discord' then 'high_engagement' else mood end as sentiment_type, platform, {_PROFILE}
        from items where (platform = 'discord' and rc >= 5) or (platform = 'steam_review' and rc >= 10) group by 1, 2""",
)
def j09(v):
    return social.high_engagement(whole(v))


@query(
    "j10_negative_volume",
    f"""with {contents(*WHOLE)} select platform, {_PROFILE} from items
        where (platform = 'discord' and rc >= 5) or (platform = 'steam_review' and mood = 'negative') or platform = 'steam_topic' group by 1""",
)
def j10(v):
    return social.negative_volume(whole(v))


_DAILY_SENTIMENT = """ds as (select event_date as review_date, count(*) as total_reviews, count(*) filter (not voted_up) as negative_reviews,
    count(*) filter (voted_up) as positive_reviews, round(count(*) filter (not voted_up) * 100.0::double / count(*), 2) as negative_ratio
    from review group by 1)"""


@query(
    "j11_negative_spikes",
    f"""with {_DAILY_SENTIMENT}, g as (select *, lag(negative_reviews) over (order by review_date) as b from ds),
        r as (select * exclude (b), case when b > 0 then round((negative_reviews - b) * 100.0::double / b, 2) end as negative_growth_rate from g)
        select r.*, (select count(*) from review x where x.event_date = r.review_date and not voted_up) as spike_day_negative_count,
          (select round(avg(votes_up), 2) from review x where x.event_date = r.review_date and not voted_up) as avg_votes_up,
          (select max(votes_up) from review x where x.event_date = r.review_date and not voted_up) as max_votes_up
        from r where negative_growth_rate >= 50 or (negative_reviews >= 12 and negative_ratio >= 40)""",
)
def j11(v):
    return social.negative_spikes(v.review, SpikeRule(growth=50, count=12, ratio=40)).withColumn(
        "spike_day_negative_count", F.coalesce("spike_day_negative_count", F.lit(0))
    )


@query(
    "j12_sentiment_ratio",
    f"""with {PER_MESSAGE}, s as (select voted_up, count(distinct recommendationid) as n, sum(votes_up) as t from review
          where event_date between date '1996-01-01' and date '2000-12-31' group by 1),
        p as (select *, round(n::double * 100.0::double / (sum(n) over ())::double, 2) as share from s)
        select 'discord' as platform, 0.0::double as positive_ratio, 0.0::double as negative_ratio, count(distinct message_id) as total_count,
          cast(coalesce(sum(rc), 0) as bigint) as total_reactions from pm where event_date between date '1996-01-01' and date '2000-12-31' and length(message) > 5
        union all select 'steam', sum(share) filter (voted_up), sum(share) filter (not voted_up), cast(sum(n) as bigint), cast(sum(t) as bigint) from p""",
)
def j12(v):
    return social.sentiment_ratio(whole(v))


@query(
    "j13_game_response",
    f"""with {PER_MESSAGE}, g(game_name, game_code, app_id) as (values ('Alpha', 'F', 0), ('Beta', 'O', 1), ('Gamma', 'X', 9)),
        d as (select game_code, count(distinct message_id) as m, cast(sum(rc) as bigint) as r, count(distinct author_id) as a, count(distinct channel_id) as c from pm group by 1),
        s as (select app_id, count(distinct recommendationid) as n, cast(sum(votes_up) as bigint) as u, round(avg(votes_up), 2) as av,
               count(distinct case when voted_up then recommendationid end) as pos, count(distinct case when not voted_up then recommendationid end) as neg from review group by 1)
        select game_name, coalesce(m, 0) as discord_messages, coalesce(r, 0) as discord_reactions, coalesce(a, 0) as discord_authors, coalesce(c, 0) as discord_channels,
          coalesce(n, 0) as steam_reviews, coalesce(u, 0) as steam_votes_up, coalesce(pos, 0) as steam_positive, coalesce(neg, 0) as steam_negative,
          coalesce(av, 0.0::double) as steam_avg_votes, coalesce(m, 0) + coalesce(n, 0) as total_content, coalesce(r, 0) + coalesce(u, 0) as total_engagement,
          case when n > 0 then round(pos::double * 100.0::double / n::double, 2) end as positive_ratio
        from g left join d on g.game_code = d.game_code left join s on g.app_id = s.app_id""",
)
def j13(v):
    games = joins.literal_dim(
        v.spark,
        "game_name string, game_code string, app_id bigint",
        [("Alpha", "F", 0), ("Beta", "O", 1), ("Gamma", "X", 9)],
    )
    return social.game_response(community(v), games)


@query(
    "j14_platform_share",
    f"""with {PER_MESSAGE}, {_VOLUME.format(least=-1)}, w as (select * from vol where platform <> 'steam_comment')
        select *, round(total_reactions::double * 100.0::double / (sum(total_reactions) over ())::double, 2) as reaction_percentage from w""",
)
def j14(v):
    return social.platform_share(whole(v))


def periods(review_filter: str = "true") -> str:
    label = "case when event_date < date '1997-06-01' then 'before' when event_date <= date '1998-05-31' then 'during' else 'after' end"
    return f"""with {PER_MESSAGE} select 'discord' as platform, {label} as period, count(distinct message_id) as activity_count,
          cast(sum(rc) as bigint) as engagement_count from pm where event_date between date '1996-01-01' and date '2000-12-31' group by 2
        union all select 'steam', {label}, count(distinct recommendationid), cast(sum(votes_up) as bigint) from review
          where event_date between date '1996-01-01' and date '2000-12-31' and {review_filter} group by 2"""


@query("j15_event_periods", periods())
def j15(v):
    return social.event_periods(whole(v), "1997-06-01", "1998-05-31")


def typed_events(v):
    side = F.when(F.col("platform").isin("view", "click"), "discord").otherwise("steam")
    return reactions(v).select(
        "event_time",
        F.col("platform").alias("event_type"),
        side.alias("platform"),
        F.col("reactions").alias("reaction_count"),
        F.col("props").alias("content_text"),
    )


@query(
    "j16_hourly_timeline",
    f"""with {_REACTIONS} select date_trunc('hour', event_time)::timestamp as hour_bucket, case when platform in ('view', 'click') then 'discord' else 'steam' end as platform,
          platform as event_type, count(*) as event_count, cast(sum(reactions) as bigint) as total_reactions, max(reactions) as max_reactions, max(props) as sample_content
        from ev group by 1, 2, 3""",
)
def j16(v):
    return social.hourly_timeline(typed_events(v))


@query(
    "j17_around_instant",
    f"""with {_REACTIONS} select platform as channel_name, count(*) as message_count, cast(sum(reactions) as bigint) as total_reactions, round(avg(reactions), 2) as avg_reactions,
          max(reactions) as max_reactions, min(event_time) as first_message_time, max(event_time) as last_message_time
        from ev where event_time between timestamp '2024-01-15 02:00:00' and timestamp '2024-01-16 02:00:00' group by 1
        order by total_reactions desc, channel_name limit 10""",
)
def j17(v):
    events = reactions(v).withColumn("channel_name", F.col("platform"))
    return social.around_instant(events, "2024-01-15 14:00:00", "12 hours")


_SPIKE = """tr as (select *, lag(visits) over (order by event_date) as b from {traffic}),
    gr as (select event_date, visits, case when b > 0 then round((visits - b) * 100.0::double / b, 2) end as rate from tr),
    sp as (select * from gr where rate >= {growth} or visits >= (select avg(visits) * {factor}::double from {traffic}))
    select sp.event_date as traffic_spike_date, sp.visits as traffic_visits, sp.rate as traffic_growth_rate, so.platform,
      cast(sum(so.content_count) as bigint) as total_content, cast(sum(so.total_reactions) as bigint) as total_engagement
    from sp left join so on so.event_date between sp.event_date - interval 1 day and sp.event_date + interval 1 day group by 1, 2, 3, 4"""


@query(
    "j18_spike_response",
    f"""with {PER_MESSAGE}, visits as (select event_date, count(*) as visits from comment group by 1),
        so as (select 'discord' as platform, event_date, count(distinct message_id) as content_count, sum(rc) as total_reactions from pm group by 2
          union all select 'steam_review', event_date, count(distinct recommendationid), sum(votes_up) from review group by 2
          union all select 'steam_topic', t.event_date, count(distinct t.topic_id), count(distinct c.comment_id) from topic t left join comment c on c.topic_url = t.url group by 2),
        {_SPIKE.format(traffic='visits', growth=60, factor=1.4)}""",
)
def j18(v):
    visits = v.comment.groupBy("event_date").agg(F.count(F.lit(1)).alias("visits"))
    return social.spike_response(visits, social.daily_by_platform(community(v)), growth=60, factor=1.4)


@query(
    "j18_spike_response_events",
    f"""with so as (select event_date, platform, count(*) as content_count, sum(cast(floor(engagement) as bigint)) as total_reactions from activity group by 1, 2),
        {_SPIKE.format(traffic='traffic', growth=10, factor=1.1)}""",
)
def j18_events(v):
    per_day = reactions(v).groupBy("event_date", "platform").agg(
        F.count(F.lit(1)).alias("content_count"), F.sum("reactions").alias("total_reactions")
    )
    return social.spike_response(v.traffic.select("event_date", "visits"), per_day, growth=10, factor=1.1)


def trend(bucket: str) -> str:
    return f"""{PER_MESSAGE}, parts as (
      select 'discord' as platform, {bucket} as tm, count(distinct message_id) as m, cast(sum(rc) as bigint) as r, count(distinct author_id) as a from pm
        where event_date between date '1996-01-01' and date '2000-12-31' group by 2
      union all select 'steam', {bucket}, count(distinct recommendationid), cast(sum(votes_up) as bigint), null from review
        where event_date between date '1996-01-01' and date '2000-12-31' group by 2)"""


WEEK = "cast(date_trunc('week', event_date) as date)"


def change(now: str, before: str) -> str:
    return f"case when {before} > 0 then round(({now} - {before})::double * 100.0::double / {before}::double, 2) end"


@query(
    "j19_weekly_trend",
    f"""with {trend(WEEK)}, l as (select *, lag(m) over w as pm_, lag(r) over w as pr_ from parts window w as (partition by platform order by tm)),
        x as (select tm as week_start, platform, m as total_messages, r as total_reactions, pm_ as prev_messages, pr_ as prev_reactions,
               {change('m', 'pm_')} as message_change_rate, {change('r', 'pr_')} as reaction_change_rate from l)
        select *, case when abs(message_change_rate) > 30 then '큰 변화' when abs(message_change_rate) > 10 then '중간 변화' else '작은 변화' end as change_magnitude from x""",
)
def j19(v):
    return social.weekly_trend(whole(v))


@query(
    "j20_daily_trend",
    f"""with {trend('event_date')}, d as (select tm, cast(sum(m) as bigint) as m, cast(sum(r) as bigint) as r from parts group by 1),
        l as (select *, lag(m) over (order by tm) as pm_, lag(r) over (order by tm) as pr_ from d),
        x as (select tm as activity_date, m as total_messages, r as total_reactions, pm_ as prev_messages, pr_ as prev_reactions,
               {change('m', 'pm_')} as message_change_rate, {change('r', 'pr_')} as reaction_change_rate from l)
        select *, case when message_change_rate > 20 then '급증' when message_change_rate > 5 then '증가' when message_change_rate < -20 then '급감'
             when message_change_rate < -5 then '감소' else '안정' end as trend_direction from x""",
)
def j20(v):
    return social.daily_trend(whole(v))


@query(
    "j21_country_response",
    """with rv as (select n_name as country_name, event_id, event_time, platform <> 'error' as up, cast(floor(engagement) as bigint) as votes,
              date_sub('hour', timestamp '2024-01-01 00:00:00', event_time) as h
            from activity join customer on user_id = c_custkey join nation on c_nationkey = n_nationkey),
       wl as (select channel_name as country_name, cast(sum(active_user) as bigint) as w, cast(sum(cash_paying_user) as bigint) as u
            from kpi_daily join channel on country_code = channel_id group by 1),
       pk as (select country_name, hour(event_time) as ph, count(*) as k from rv group by 1, 2),
       pr as (select *, row_number() over (partition by country_name order by k desc, ph) as rn from pk),
       c as (select country_name, count(distinct event_id) as total_reviews, round(avg(h), 2) as avg_response_hours, min(h) as fastest_response_hours,
              count(*) filter (h <= 24) as reviews_within_24h, round(count(*) filter (h <= 24) * 100.0::double / count(*), 2) as response_rate_24h,
              count(*) filter (up) as positive_reviews, count(*) filter (not up) as negative_reviews, round(avg(votes), 2) as avg_votes_up,
              round(count(*) filter (up) * 100.0::double / count(*), 2) as positive_ratio from rv group by 1)
       select c.*, cast(pr.ph as integer) as peak_response_hour, wl.w as total_wishlists, wl.u as total_sales,
         cast(rank() over (order by avg_response_hours) as integer) as response_speed_rank, cast(rank() over (order by response_rate_24h desc) as integer) as response_rate_rank
       from c left join pr on pr.country_name = c.country_name and rn = 1 left join wl on wl.country_name = c.country_name
       order by avg_response_hours, c.country_name limit 20""",
)
def j21(v):
    homes = v.customer.join(v.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    reviews = (
        reactions(v)
        .join(homes, F.col("user_id") == F.col("c_custkey"))
        .select(
            F.col("n_name").alias("country_name"),
            F.col("event_id").alias("review_id"),
            F.col("event_time").alias("review_time"),
            (F.col("platform") != "error").alias("voted_up"),
            F.col("reactions").alias("votes_up"),
        )
    )
    wishlists = v.kpi_daily.join(v.channel, F.col("country_code") == F.col("channel_id")).select(
        F.col("channel_name").alias("country_name"),
        F.col("active_user").alias("wishlists"),
        F.col("cash_paying_user").alias("units"),
    )
    return social.country_response(reviews, wishlists, "2024-01-01 00:00:00")


@query(
    "j22_regional_sales",
    """with d as (select region_name, event_date, sum(active_user) as w, sum(cash_paying_user) as u from kpi_daily k
              join region_dim r on k.country_code = r.country_code group by 1, 2)
       select region_name, count(distinct event_date) as days_tracked, cast(sum(w) as bigint) as total_wishlists, cast(sum(u) as bigint) as total_sales,
         round(avg(w), 2) as avg_daily_wishlists, round(avg(u), 2) as avg_daily_sales, min(event_date) as period_start, max(event_date) as period_end
       from d group by 1 order by total_sales desc, region_name limit 10""",
)
def j22(v):
    daily = v.kpi_daily.join(v.region_dim, "country_code").groupBy("region_name", "event_date").agg(
        F.sum("active_user").alias("wishlists"), F.sum("cash_paying_user").alias("units")
    )
    return social.regional_sales(daily)


@query("j24_campaign_periods", periods("weighted_vote_score is not null and part_id is not null"))
def j24(v):
    c = whole(v)
    with_text = c.review.filter(F.col("weighted_vote_score").isNotNull() & F.col("part_id").isNotNull())
    texted = Community(c.message, c.reaction, c.channel, with_text, c.topic, c.comment)
    return social.event_periods(texted, "1997-06-01", "1998-05-31")


_SOCIAL = """so as (select event_date, count(*) as m, cast(sum(cast(floor(engagement) as bigint)) as bigint) as r, count(distinct user_id) as a
    from activity where platform <> 'error' group by 1)"""


def daily_social(v):
    talk = reactions(v).filter(F.col("platform") != "error")
    return talk.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.sum("reactions").alias("total_reactions"),
        F.countDistinct("user_id").alias("total_authors"),
    )


@query(
    "j25_traffic_vs_social",
    f"""with {_SOCIAL}, t as (select event_date, visits, lag(visits) over (order by event_date) as b from traffic),
        j as (select t.event_date, visits as total_visits, {change('visits', 'b')} as traffic_growth_rate, coalesce(m, 0) as social_messages,
               coalesce(r, 0) as social_reactions, coalesce(a, 0) as social_authors from t left join so on so.event_date = t.event_date),
        k as (select *, lag(social_messages) over (order by event_date) as sb from j),
        x as (select * exclude (sb), {change('social_messages', 'sb')} as social_growth_rate from k),
        y as (select * from x where traffic_growth_rate is not null)
        select *, case when traffic_growth_rate > 20 and social_growth_rate > 20 then '강한 양의 상관관계'
           when traffic_growth_rate > 20 and social_growth_rate < -20 then '강한 음의 상관관계'
           when traffic_growth_rate < -20 and social_growth_rate > 20 then '역상관관계'
           when abs(traffic_growth_rate) < 10 and abs(social_growth_rate) < 10 then '약한 상관관계' else '중간 상관관계' end as correlation_type,
          case when traffic_growth_rate > 20 and lag(social_growth_rate, 1) over (order by event_date) > 20 then '1일 지연 효과'
           when traffic_growth_rate > 20 and lag(social_growth_rate, 2) over (order by event_date) > 20 then '2일 지연 효과' else '즉시 반응' end as response_timing
        from y""",
)
def j25(v):
    traffic = v.traffic.select("event_date", F.col("visits").alias("total_visits"))
    return social.traffic_vs_social(traffic, daily_social(v))


@query(
    "j26_wishlist_vs_social",
    f"""with {_SOCIAL}, t as (select event_date, adds, deletes, purchases, adds - deletes as net_wishlist_change from traffic),
        l as (select *, lag(net_wishlist_change) over (order by event_date) as b from t),
        j as (select l.* exclude (b), case when b <> 0 then round((net_wishlist_change - b)::double * 100.0::double / abs(b)::double, 2) end as wishlist_change_rate,
               coalesce(m, 0) as social_messages, coalesce(r, 0) as social_reactions, coalesce(a, 0) as social_authors from l left join so on so.event_date = l.event_date),
        k as (select *, lag(social_messages) over (order by event_date) as sb from j),
        x as (select * exclude (sb), {change('social_messages', 'sb')} as social_change_rate from k)
        select *, case when wishlist_change_rate > 20 and social_change_rate > 20 then '위시리스트 증가 → 소셜 반응 증가'
           when wishlist_change_rate < -20 and social_change_rate > 20 then '위시리스트 감소 → 소셜 반응 증가 (역상관)'
           when wishlist_change_rate > 20 and social_change_rate < -20 then '위시리스트 증가 → 소셜 반응 감소 (역상관)' else '약한 상관관계' end as correlation_type
        from x where wishlist_change_rate is not null""",
)
def j26(v):
    local = v.traffic.select(
        F.date_format("event_date", "yyyy-MM-dd").alias("date_local"), "adds", "deletes", "purchases"
    )
    broken = joins.literal_dim(
        v.spark, "date_local string, adds bigint, deletes bigint, purchases bigint", [("not a date", 1, 2, 3)]
    )
    return social.wishlist_vs_social(local.unionByName(broken), daily_social(v))


_SUMMARY = """select platform, count(distinct id) as total_content, cast(sum(rc) as bigint) as total_reactions, round(avg(rc), 2) as avg_reactions,
    max(rc) as max_reactions, min(tm) as earliest_time, max(tm) as latest_time from items group by 1"""


@query("j27_day_summary", f"with {contents('1998-03-10', '1998-03-10')} {_SUMMARY}")
def j27(v):
    return social.platform_summary(community(v).on("1998-03-10"))


@query("j27_period_summary", f"with {contents(*WHOLE)} {_SUMMARY}")
def j27_period(v):
    return social.platform_summary(whole(v))


@query(
    "j28_week_summary",
    f"""with {PER_MESSAGE} select 'discord' as platform, count(distinct message_id) as activity_count, cast(coalesce(sum(rc), 0) as bigint) as engagement_count from pm
          where event_date between date '1998-03-09' and date '1998-03-15'
        union all select 'steam', count(distinct recommendationid), cast(coalesce(sum(votes_up), 0) as bigint) from review
          where event_date between date '1998-03-09' and date '1998-03-15'""",
)
def j28(v):
    return social.week_summary(community(v).within("1998-03-09", "1998-03-15"))


@query(
    "j29_statistics_text",
    f"""with {contents(*WHOLE)}, p as (select platform, count(distinct id) as c, sum(rc) as r, count(*) filter (mood = 'positive') as p,
          count(*) filter (mood = 'negative') as n from items group by 1)
        select '=== 통합 소셜 반응 통계 ===' as section, (select count(distinct id) from items)::varchar || '개 콘텐츠, ' || sum(r)::varchar || '개 반응, ' ||
          cast(round(sum(p)::double * 100.0::double / sum(p + n)::double, 2) as decimal(5,2))::varchar || '% 긍정 (스팀 리뷰 기준)' as detail from p
        union all select '플랫폼별 통계', platform || ': ' || c::varchar || '개 콘텐츠, ' || r::varchar || '개 반응, ' || p::varchar || '개 긍정, ' || n::varchar || '개 부정' from p""",
)
def j29(v):
    return social.statistics_text(whole(v))


@query(
    "j30_keyword_sentiment",
    f"""with {PER_MESSAGE}, s as (select case when message like '%URGENT%' or message like '%HIGH%' then 'positive' when message like '%LOW%' then 'negative'
          else 'neutral' end as sentiment, count(*) as message_count, cast(sum(rc) as bigint) as total_reactions from pm group by 1)
        select *, round(message_count::double * 100.0::double / (sum(message_count) over ())::double, 2) as percentage from s""",
)
def j30(v):
    return social.keyword_sentiment(community(v), "message", ["URGENT", "HIGH"], ["LOW"])


@query(
    "j31_review_sentiment",
    """with s as (select case when voted_up then 'positive' when not voted_up then 'negative' else 'unknown' end as sentiment, count(*) as review_count,
         cast(sum(votes_up) as bigint) as total_upvotes, round(sum(cast(weighted_vote_score as decimal(9,4)))::double / count(*), 4) as avg_weighted_score
       from review where app_id in (0, 1) group by 1)
       select *, round(review_count::double * 100.0::double / (sum(review_count) over ())::double, 2) as percentage from s""",
)
def j31(v):
    apps = joins.literal_dim(v.spark, "app_id bigint", [(0,), (1,)])
    return social.review_sentiment(v.review, apps)


@query(
    "j32_channel_activity",
    f"""with {PER_MESSAGE} select event_date, channel_name, count(distinct message_id) as message_count, cast(sum(rc) as bigint) as reaction_count,
          count(distinct author_id) as unique_authors from pm join channel c on pm.channel_id = c.channel_id group by 1, 2""",
)
def j32(v):
    return social.channel_activity(community(v))


@query(
    "j32_hourly_activity",
    """select cast(hour(event_time) as integer) as hour, count(distinct event_id) as message_count, count(distinct user_id) as unique_authors from activity group by 1""",
)
def j32_hourly(v):
    return social.hourly_activity(v.activity)


@query(
    "j33_negative_ratio_jumps",
    f"""with {_DAILY_SENTIMENT}, l as (select review_date, total_reviews, negative_reviews, negative_ratio, lag(negative_ratio) over (order by review_date) as prev_negative_ratio from ds)
        select *, negative_ratio - prev_negative_ratio as ratio_change from l where negative_ratio - prev_negative_ratio > 10""",
)
def j33(v):
    return social.negative_ratio_jumps(v.review, 10)


@query(
    "j34_weekly_totals",
    f"""with {trend(WEEK)} select tm as week_start, platform, m as activity_count, r as engagement_count, cast(sum(m) over (partition by tm) as bigint) as total_activity,
          cast(sum(r) over (partition by tm) as bigint) as total_engagement from parts""",
)
def j34(v):
    return social.weekly_totals(whole(v))


@query(
    "j35_hourly_engagement",
    f"""with {_REACTIONS}, s as (select event_time, case when platform in ('view', 'click') then 'discord' else 'steam_review' end as platform, reactions from ev),
        i as (select event_time, platform, sum(reactions) as e from s where platform = 'discord' group by 1, 2 union all select * from s where platform <> 'discord')
        select date_trunc('hour', event_time)::timestamp as time_bucket, platform, count(*) as activity_count, cast(sum(e) as bigint) as engagement_count from i group by 1, 2""",
)
def j35(v):
    side = F.when(F.col("platform").isin("view", "click"), "discord").otherwise("steam_review")
    events = reactions(v).select("event_time", side.alias("platform"), F.col("reactions").alias("engagement_count"))
    return social.hourly_engagement(events)


STOP_WORDS = ["the", "and", "that", "of", "de", "la", "le", "un", "und", "der", "die", "que"]


@query(
    "j36_keyword_frequency",
    f"""with w as (select unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) as word from documents)
        select word, count(*) as frequency from w where length(word) >= 2 and word not in ({', '.join(repr(s) for s in STOP_WORDS)})
        group by 1 order by frequency desc, word limit 50""",
)
def j36(v):
    stop = joins.literal_dim(v.spark, "word string", [(w,) for w in STOP_WORDS])
    return social.keyword_frequency(v.documents, "text", stop, 50)
