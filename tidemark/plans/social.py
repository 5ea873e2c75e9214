"""Community signal reports over messages, reactions, reviews, topics and comments.

Every measure is brought to the grain of its own entity before anything is
joined: reactions per message, comments per topic. A message or topic with a
third of all reactions or comments is combined on the map side and reaches each
join as one row, and no join multiplies a count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.functions.dates import elapsed, lenient_date, truncated
from tidemark.functions.numbers import activity_score, pct, sum0
from tidemark.functions.text import joined_text, text_list_distinct
from tidemark.operators import aggregates, filters, joins, ranking, sets, windows
from tidemark.session import materialize


def _rows() -> Column:
    return F.count(F.lit(1))


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


@dataclass(frozen=True)
class Community:
    """The relations the reports read; filter them once with ``within``."""

    message: DataFrame
    reaction: DataFrame
    channel: DataFrame
    review: DataFrame
    topic: DataFrame
    comment: DataFrame

    def within(self, lo: str, hi: str) -> "Community":
        """Messages, reviews and topics of a closed date range.

        Only partition dates are filtered, so scans can skip files and row groups.
        """
        kept = {n: filters.between_dates(getattr(self, n), "event_date", lo, hi) for n in ("message", "review", "topic")}
        return Community(reaction=self.reaction, channel=self.channel, comment=self.comment, **kept)

    def on(self, date: str) -> "Community":
        return self.within(date, date)

    # -- measures at entity grain ------------------------------------------------

    def reactions_per_message(self) -> DataFrame:
        return self.reaction.groupBy("message_id").agg(F.sum("cnt").alias("reaction_count"))

    def messages(self) -> DataFrame:
        """Messages with their reaction total, 0 where nobody reacted."""
        joined = self.message.join(self.reactions_per_message(), "message_id", "left")
        return joined.withColumn("reaction_count", _zero("reaction_count"))

    def topics(self) -> DataFrame:
        """Topics with their number of comments as reaction total."""
        return joins.child_count(self.topic, self.comment, "url", "topic_url", "comment_id", "reaction_count")

    def contents(self, reviews: DataFrame | None = None) -> DataFrame:
        """One row per message, review and topic in a common shape."""
        reviews = self.review if reviews is None else reviews
        empty = F.lit(None).cast("string")
        return sets.union_tagged(
            {
                "discord": self.messages().select(
                    F.col("message_id").cast("string").alias("content_id"),
                    F.col("message").alias("content_text"),
                    F.col("created_at").alias("event_time"),
                    "reaction_count",
                    empty.alias("sentiment"),
                ),
                "steam_review": reviews.select(
                    F.col("recommendationid").cast("string").alias("content_id"),
                    F.concat_ws(" ", F.lit("part"), "part_id").alias("content_text"),
                    F.col("event_date").cast("timestamp_ntz").alias("event_time"),
                    F.col("votes_up").alias("reaction_count"),
                    F.when(F.col("voted_up"), "positive").otherwise("negative").alias("sentiment"),
                ),
                "steam_topic": self.topics().select(
                    F.col("topic_id").cast("string").alias("content_id"),
                    F.col("title").alias("content_text"),
                    F.col("event_date").cast("timestamp_ntz").alias("event_time"),
                    "reaction_count",
                    empty.alias("sentiment"),
                ),
            }
        )


# -- discussion popularity -------------------------------------------------------


def most_reacted_messages(c: Community, n: int = 20) -> DataFrame:
    """Messages with most reactions and the list of emojis used."""
    per_emoji = c.reaction.groupBy("message_id", "emoji_name").agg(F.sum("cnt").alias("n"))
    per_message = per_emoji.groupBy("message_id").agg(
        F.sum("n").alias("reaction_count"),
        _rows().alias("unique_emojis"),
        text_list_distinct("emoji_name").alias("emoji_list"),
    )
    # an inner join is enough: messages without reactions do not pass the filter
    popular = filters.having(per_message, F.col("reaction_count") > 0)
    top = ranking.top_n(
        c.message.join(popular, "message_id"), [F.col("reaction_count").desc()], n, ["message_id"]
    )
    named = top.join(c.channel, "channel_id", "left")
    return named.select("message_id", "created_at", "channel_name", "reaction_count", "unique_emojis", "emoji_list")


def most_upvoted_reviews(review: DataFrame, n: int = 20, snapshot: str = "raw") -> DataFrame:
    chosen = windows.snapshot_view(review, ["recommendationid"], ["event_date", "revision"], snapshot)
    return ranking.top_n(
        chosen,
        [F.col("votes_up").desc(), F.col("weighted_vote_score").desc()],
        n,
        ["recommendationid", "event_date", "revision", "part_id", "reviewer_id", "playtime"],
    )


def most_reacted_platforms(c: Community) -> DataFrame:
    reacted = c.contents().filter(F.col("reaction_count") > 0)
    return reacted.groupBy("platform").agg(
        _rows().alias("content_count"),
        F.sum("reaction_count").alias("total_reactions"),
        F.max("reaction_count").alias("max_reactions"),
        F.max("content_text").alias("sample_content"),
    )


def hot_channels_by_hour(events: DataFrame, n: int = 10) -> DataFrame:
    """Hour and platform buckets with most engagement, from one row per event."""
    per_hour = events.groupBy(truncated("event_time", "hour").alias("hour_bucket"), "platform").agg(
        _rows().alias("message_count"),
        F.sum("reactions").alias("total_reactions"),
        F.round(F.avg("reactions"), 2).alias("avg_reactions"),
        F.max("reactions").alias("max_reactions"),
    )
    return ranking.top_n(per_hour, [F.col("total_reactions").desc()], n, ["hour_bucket", "platform"])


def most_commented_topics(c: Community, n: int = 20) -> DataFrame:
    comments = c.comment.filter(~F.col("is_deleted")).withColumnRenamed("topic_url", "url")
    active = comments.groupBy("url").agg(
        F.countDistinct("comment_id").alias("comment_count"), F.max("commented_at").alias("last_comment_time")
    )
    authors = aggregates.distinct_counts(comments, ["url"], {"unique_commenters": "author"})
    joined = c.topic.join(active, "url").filter(F.col("comment_count") > 0).join(authors, "url")
    return ranking.top_n(joined, [F.col("comment_count").desc()], n, ["topic_id"]).select(
        "topic_id", "title", "subforum", "comment_count", "unique_commenters", "last_comment_time"
    )


def _length_stats(df: DataFrame, entity: str, text: str, reactions: Column) -> DataFrame:
    """Distinct content, reactions and mean text length as a one-row frame."""
    return df.agg(
        F.countDistinct(entity).alias("content_count"),
        reactions.cast("bigint").alias("total_reactions"),
        F.round(F.avg(F.length(text)), 2).alias("avg_content_length"),
    )


def content_volume(c: Community, longer_than: int = 10) -> DataFrame:
    """Content, reactions and mean length per platform."""
    long_messages = filters.has_text(c.messages(), "message", longer_than)
    in_range = joins.semi(c.comment, c.topic.select(F.col("url").alias("topic_url")), "topic_url")
    topic_reactions = in_range.agg(F.countDistinct("comment_id").alias("total_reactions"))
    topics = c.topic.agg(
        F.countDistinct("topic_id").alias("content_count"), F.round(F.avg(F.length("title")), 2).alias("avg_content_length")
    ).withColumn("total_reactions", topic_reactions.scalar())
    reviews = _length_stats(
        c.review.withColumn("t", F.col("part_id").cast("string")), "recommendationid", "t", F.sum("votes_up")
    )
    comments = _length_stats(c.comment, "comment_id", "topic_url", F.lit(0))
    return sets.union_tagged(
        {
            "discord": _length_stats(long_messages, "message_id", "message", sum0("reaction_count")),
            "steam_review": reviews,
            "steam_topic": topics,
            "steam_comment": comments,
        }
    )


def active_channels(c: Community, n: int = 20) -> DataFrame:
    """Channels ranked by messages + 0.5 x reactions."""
    totals = c.messages().groupBy("channel_id").agg(
        F.countDistinct("message_id").alias("message_count"),
        F.sum("reaction_count").alias("reaction_count"),
        F.min("created_at").alias("first_message_time"),
        F.max("created_at").alias("last_message_time"),
    )
    kinds = c.reaction.select("message_id", "emoji_name").distinct()
    emojis = (
        c.message.select("message_id", "channel_id")
        .join(kinds, "message_id")
        .groupBy("channel_id")
        .agg(F.countDistinct("emoji_name").alias("unique_emojis"))
    )
    authors = aggregates.distinct_counts(c.message, ["channel_id"], {"unique_authors": "author_id"})
    joined = c.channel.join(totals, "channel_id").join(authors, "channel_id").join(emojis, "channel_id", "left")
    scored = joined.withColumns(
        {
            "unique_emojis": _zero("unique_emojis"),
            "activity_score": activity_score(F.col("message_count"), F.col("reaction_count")),
        }
    )
    return ranking.top_n(scored, [F.col("activity_score").desc()], n, ["channel_id"])


def busiest_hours(events: DataFrame) -> DataFrame:
    """Mentions by hour of day over platforms; ``user_id`` may be missing for a platform."""
    placed = events.select(
        F.hour("event_time").alias("hour_of_day"), truncated("event_time", "hour").alias("bucket"),
        "platform", "event_id", "user_id",
    )
    per_bucket = aggregates.distinct_counts(
        placed, ["hour_of_day", "bucket", "platform"], {"mentions": "event_id", "authors": "user_id"}
    )
    # one row per hour and platform before names are collected
    per_platform = per_bucket.groupBy("hour_of_day", "platform").agg(
        F.sum("mentions").alias("m"), F.sum("authors").alias("a"), _rows().alias("b")
    )
    return per_platform.groupBy("hour_of_day").agg(
        F.sum("m").alias("total_mentions"),
        F.sum("a").alias("total_unique_authors"),
        _rows().alias("platform_count"),
        text_list_distinct("platform").alias("platforms"),
        F.round(F.sum("m").cast("double") / F.sum("b"), 2).alias("avg_mentions_per_hour"),
    )


# -- sentiment ---------------------------------------------------------------------


def _reaction_profile(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        _rows().alias("content_count"),
        F.sum("reaction_count").alias("total_reactions"),
        F.avg("reaction_count").alias("avg_reactions"),
        F.max("reaction_count").alias("max_reactions"),
        F.min("event_time").alias("earliest_time"),
        F.max("event_time").alias("latest_time"),
    )


def high_engagement(c: Community, message_min: int = 5, review_min: int = 10) -> DataFrame:
    """Content above an engagement limit by sentiment and platform."""
    wanted = F.when(F.col("platform") == "discord", message_min).otherwise(review_min)
    kept = c.contents().filter(F.col("platform").isin("discord", "steam_review") & (F.col("reaction_count") >= wanted))
    kind = F.when(F.col("platform") == "discord", "high_engagement").otherwise(F.col("sentiment"))
    return _reaction_profile(kept.withColumn("sentiment_type", kind), ["sentiment_type", "platform"])


def negative_volume(c: Community, message_min: int = 5) -> DataFrame:
    contents = c.contents(reviews=filters.flagged(c.review, "voted_up", wanted=False))
    kept = contents.filter((F.col("platform") != "discord") | (F.col("reaction_count") >= message_min))
    return _reaction_profile(kept, ["platform"])


def _daily_sentiment(review: DataFrame, date: str = "event_date") -> DataFrame:
    daily = review.groupBy(F.col(date).alias("review_date")).agg(
        _rows().alias("total_reviews"),
        F.count_if(~F.col("voted_up")).alias("negative_reviews"),
        F.count_if("voted_up").alias("positive_reviews"),
    )
    return daily.withColumn("negative_ratio", pct("negative_reviews", "total_reviews"))


def negative_spikes(review: DataFrame, rule: labels.SpikeRule) -> DataFrame:
    """Days on which negative reviews rose sharply, with vote details of those days.

    Vote details are aggregated per day in the same pass as the counts, so the
    spike dates need no second scan of the reviews.
    """
    daily = _daily_sentiment(review)
    negative = filters.flagged(review, "voted_up", wanted=False)
    details = negative.groupBy(F.col("event_date").alias("review_date")).agg(
        _rows().alias("spike_day_negative_count"),
        F.round(F.avg("votes_up"), 2).alias("avg_votes_up"),
        F.max("votes_up").alias("max_votes_up"),
    )
    found = windows.detect_spikes(
        daily, "review_date", "negative_reviews", "negative_ratio", "negative_growth_rate", rule
    )
    return found.filter("is_spike").drop("is_spike").join(details, "review_date", "left")


def sentiment_ratio(c: Community, longer_than: int = 5) -> DataFrame:
    """Positive and negative share per platform; messages carry no sentiment."""
    long_messages = filters.has_text(c.messages(), "message", longer_than)
    zero = F.lit(0.0)
    discord = long_messages.agg(
        F.countDistinct("message_id").alias("total_count"), sum0("reaction_count").alias("total_reactions")
    ).withColumns({"positive_ratio": zero, "negative_ratio": zero})
    by_flag = c.review.groupBy("voted_up").agg(
        F.countDistinct("recommendationid").alias("n"), F.sum("votes_up").alias("v")
    )
    shared = windows.share(by_flag, "n", "percentage", few=True)
    steam = shared.agg(
        F.sum("n").alias("total_count"),
        F.sum("v").alias("total_reactions"),
        F.coalesce(F.sum(F.when(F.col("voted_up"), F.col("percentage"))), zero).alias("positive_ratio"),
        F.coalesce(F.sum(F.when(~F.col("voted_up"), F.col("percentage"))), zero).alias("negative_ratio"),
    )
    return sets.union_tagged({"discord": discord, "steam": steam})


def keyword_sentiment(c: Community, text: str, positive: list[str], negative: list[str]) -> DataFrame:
    label = labels.sentiment_keywords(text, positive, negative).alias("sentiment")
    mix = c.messages().groupBy(label).agg(
        _rows().alias("message_count"), F.sum("reaction_count").alias("total_reactions")
    )
    return windows.share(mix, "message_count", "percentage", few=True)


def review_sentiment(review: DataFrame, apps: DataFrame) -> DataFrame:
    chosen = joins.semi(review, apps, "app_id")
    mix = chosen.groupBy(labels.sentiment_flag("voted_up").alias("sentiment")).agg(
        _rows().alias("review_count"),
        F.sum("votes_up").alias("total_upvotes"),
        F.round(F.avg(F.col("weighted_vote_score").cast("decimal(9,4)")), 4).cast("double").alias("avg_weighted_score"),
    )
    return windows.share(mix, "review_count", "percentage", few=True)


def negative_ratio_jumps(review: DataFrame, over: float) -> DataFrame:
    daily = _daily_sentiment(review).select("review_date", "total_reviews", "negative_reviews", "negative_ratio")
    return windows.jump_rows(daily, "negative_ratio", "review_date", "ratio_change", "prev_negative_ratio", over)


# -- comparison of games, platforms and periods ----------------------------------------


def game_response(c: Community, games: DataFrame) -> DataFrame:
    """Response per game on both platforms; each fact is aggregated before its join."""
    talk = c.messages().groupBy("game_code").agg(
        F.countDistinct("message_id").alias("discord_messages"), F.sum("reaction_count").alias("discord_reactions")
    )
    people = aggregates.distinct_counts(
        c.message, ["game_code"], {"discord_authors": "author_id", "discord_channels": "channel_id"}
    )
    talk = aggregates.meet(talk, people, ["game_code"])
    # one row per review with a flag for each side it was counted on
    up, counted = F.col("voted_up"), F.col("recommendationid").isNotNull()
    reviews = aggregates.two_level(
        c.review,
        ["app_id", "recommendationid"],
        {"votes": F.sum("votes_up"), "voted": F.count("votes_up"), "liked": F.max(up), "disliked": F.max(~up)},
        ["app_id"],
        {
            "steam_reviews": F.count("recommendationid"),
            "steam_votes_up": F.sum("votes"),
            "steam_avg_votes": F.round(F.try_divide(F.sum("votes").cast("double"), F.sum("voted")), 2),
            "steam_positive": F.count_if(counted & F.col("liked")),
            "steam_negative": F.count_if(counted & F.col("disliked")),
        },
    )
    joined = games.join(talk, "game_code", "left").join(reviews, "app_id", "left")
    whole = [
        "discord_messages", "discord_reactions", "discord_authors", "discord_channels",
        "steam_reviews", "steam_votes_up", "steam_positive", "steam_negative",
    ]
    filled = joined.withColumns({n: _zero(n) for n in whole}).withColumn(
        "steam_avg_votes", F.coalesce("steam_avg_votes", F.lit(0.0))
    )
    return filled.select(
        "game_name", *whole, "steam_avg_votes",
        (F.col("discord_messages") + F.col("steam_reviews")).alias("total_content"),
        (F.col("discord_reactions") + F.col("steam_votes_up")).alias("total_engagement"),
        pct("steam_positive", "steam_reviews").alias("positive_ratio"),
    )


def platform_share(c: Community) -> DataFrame:
    """Each platform's share of all reactions."""
    volume = content_volume(c, longer_than=-1).filter(F.col("platform") != "steam_comment")
    return windows.share(volume, "total_reactions", "reaction_percentage", few=True)


def event_periods(c: Community, start: str, end: str) -> DataFrame:
    """Messages and reactions before, during and after an event, per platform."""
    period = labels.period_label("event_date", start, end).alias("period")
    discord = c.messages().groupBy(period).agg(
        F.countDistinct("message_id").alias("activity_count"), F.sum("reaction_count").alias("engagement_count")
    )
    steam = c.review.groupBy(period).agg(
        F.countDistinct("recommendationid").alias("activity_count"), F.sum("votes_up").alias("engagement_count")
    )
    both = sets.union_tagged({"discord": discord, "steam": steam})
    return ranking.order_by_labels(both, ["platform"], "period", ["before", "during", "after"])


def _activity_by(c: Community, bucket: Column, name: str) -> DataFrame:
    discord = c.messages().groupBy(bucket.alias(name)).agg(
        F.countDistinct("message_id").alias("total_messages"), F.sum("reaction_count").alias("total_reactions")
    )
    dated = c.message.select(bucket.alias(name), "author_id")
    authors = aggregates.distinct_counts(dated, [name], {"total_authors": "author_id"})
    discord = aggregates.meet(discord, authors, [name])
    steam = c.review.groupBy(bucket.alias(name)).agg(
        F.countDistinct("recommendationid").alias("total_messages"), F.sum("votes_up").alias("total_reactions")
    )
    return sets.union_tagged({"discord": discord, "steam": steam}, pad=True)


def _with_changes(df: DataFrame, order: str, partition: list[str] | None) -> DataFrame:
    rated = windows.pct_change(
        df, "total_messages", order, "message_change_rate", partition, previous="prev_messages"
    )
    return windows.pct_change(
        rated, "total_reactions", order, "reaction_change_rate", partition, previous="prev_reactions"
    )


def weekly_trend(c: Community) -> DataFrame:
    weekly = _activity_by(c, F.trunc("event_date", "week"), "week_start").drop("total_authors")
    rated = _with_changes(weekly, "week_start", ["platform"])
    return rated.withColumn("change_magnitude", labels.change_magnitude("message_change_rate"))


def _daily_social(c: Community, name: str = "activity_date") -> DataFrame:
    return _activity_by(c, F.col("event_date"), name).groupBy(name).agg(
        F.sum("total_messages").alias("total_messages"),
        F.sum("total_reactions").alias("total_reactions"),
        sum0("total_authors").alias("total_authors"),
    )


def daily_trend(c: Community) -> DataFrame:
    rated = _with_changes(_daily_social(c).drop("total_authors"), "activity_date", None)
    return rated.withColumn("trend_direction", labels.change_direction("message_change_rate"))


# -- time lines ------------------------------------------------------------------------


def hourly_timeline(events: DataFrame) -> DataFrame:
    """Events per hour, platform and kind with the largest text as a sample."""
    return events.groupBy(
        truncated("event_time", "hour").alias("hour_bucket"), "platform", "event_type"
    ).agg(
        _rows().alias("event_count"),
        F.sum("reaction_count").alias("total_reactions"),
        F.max("reaction_count").alias("max_reactions"),
        F.max("content_text").alias("sample_content"),
    )


def around_instant(events: DataFrame, instant: str, span: str, n: int = 10) -> DataFrame:
    """What each channel discussed around an instant."""
    near = filters.around(events, "event_time", instant, span)
    stats = near.groupBy("channel_name").agg(
        _rows().alias("message_count"),
        F.sum("reactions").alias("total_reactions"),
        F.round(F.avg("reactions"), 2).alias("avg_reactions"),
        F.max("reactions").alias("max_reactions"),
        F.min("event_time").alias("first_message_time"),
        F.max("event_time").alias("last_message_time"),
    )
    return ranking.top_n(stats, [F.col("total_reactions").desc()], n, ["channel_name"])


def hourly_engagement(events: DataFrame, per_instant: tuple[str, ...] = ("discord",)) -> DataFrame:
    """Activity and engagement per hour and platform.

    For the platforms in ``per_instant`` all rows of one instant count as one activity.
    """
    instants = events.groupBy("event_time", "platform").agg(F.sum("engagement_count").alias("e"), _rows().alias("r"))
    counted = F.when(F.col("platform").isin(*per_instant), 1).otherwise(F.col("r"))
    return instants.groupBy(truncated("event_time", "hour").alias("time_bucket"), "platform").agg(
        F.sum(counted).alias("activity_count"), F.sum("e").alias("engagement_count")
    )


def weekly_totals(c: Community) -> DataFrame:
    weekly = _activity_by(c, F.trunc("event_date", "week"), "week_start").select(
        "week_start",
        "platform",
        F.col("total_messages").alias("activity_count"),
        F.col("total_reactions").alias("engagement_count"),
    )
    return windows.with_total(
        weekly, ["week_start"], {"total_activity": "activity_count", "total_engagement": "engagement_count"}
    )


def channel_activity(c: Community) -> DataFrame:
    """Messages, reactions and authors per channel and day."""
    keys = ["event_date", "channel_id"]
    counts = c.messages().groupBy(*keys).agg(
        F.countDistinct("message_id").alias("message_count"), F.sum("reaction_count").alias("reaction_count")
    )
    authors = aggregates.distinct_counts(c.message, keys, {"unique_authors": "author_id"})
    per_channel = aggregates.meet(counts, authors, keys)
    return per_channel.join(c.channel.select("channel_id", "channel_name"), "channel_id").drop("channel_id")


def hourly_activity(events: DataFrame) -> DataFrame:
    timed = events.select(F.hour("event_time").alias("hour"), "event_id", "user_id")
    return aggregates.distinct_counts(timed, ["hour"], {"message_count": "event_id", "unique_authors": "user_id"})


# -- traffic, wishlists and regions ------------------------------------------------------


def spike_response(traffic: DataFrame, social: DataFrame, growth: float = 30, factor: float = 1.8) -> DataFrame:
    """Social content and engagement within one day of each traffic spike.

    ``social`` is one row per (event_date, platform) with content_count and
    total_reactions. The spikes, a few days, are written once; their first and last
    day bound its scans as plain dates, so files outside them are never opened.
    """
    rated = windows.pct_change(traffic, "visits", "event_date", "growth_rate")
    high = traffic.agg((F.avg("visits") * factor).alias("level")).scalar()
    spikes = rated.filter(F.coalesce(F.col("growth_rate") >= growth, F.lit(False)) | (F.col("visits") >= high)).select(
        F.col("event_date").alias("traffic_spike_date"),
        F.col("visits").alias("traffic_visits"),
        F.col("growth_rate").alias("traffic_growth_rate"),
    )
    spikes = materialize(spikes, "traffic-spikes")
    first, last = F.min("traffic_spike_date"), F.max("traffic_spike_date")
    bounds = spikes.agg(F.date_sub(first, 1).alias("lo"), F.date_add(last, 1).alias("hi")).first()
    in_reach = social.filter(F.col("event_date").between(F.lit(bounds.lo), F.lit(bounds.hi)))
    return joins.window_totals(
        spikes, "traffic_spike_date", in_reach, "event_date", 1, 1, ["platform"],
        {"total_content": F.sum("content_count"), "total_engagement": F.sum("total_reactions")},
    )


def daily_by_platform(c: Community) -> DataFrame:
    """content_count and total_reactions per day and platform."""
    in_range = c.topic.select(F.col("url").alias("topic_url"), F.col("event_date").alias("d"))
    comments = c.comment.select("topic_url", "comment_id").join(in_range, "topic_url")
    per_day = comments.groupBy(F.col("d").alias("event_date")).agg(F.countDistinct("comment_id").alias("total_reactions"))
    topics = c.topic.groupBy("event_date").agg(F.countDistinct("topic_id").alias("content_count"))
    return sets.union_tagged(
        {
            "discord": c.messages().groupBy("event_date").agg(
                F.countDistinct("message_id").alias("content_count"), F.sum("reaction_count").alias("total_reactions")
            ),
            "steam_review": c.review.groupBy("event_date").agg(
                F.countDistinct("recommendationid").alias("content_count"), F.sum("votes_up").alias("total_reactions")
            ),
            "steam_topic": joins.align_series(topics, per_day, "event_date", ["total_reactions"]),
        }
    )


def country_response(reviews: DataFrame, wishlists: DataFrame, launched: str, n: int = 20) -> DataFrame:
    """Response speed by country with the peak hour and two ranks.

    ``reviews`` has country_name, review_id, review_time, voted_up and votes_up;
    ``wishlists`` has country_name, wishlists and units. The two facts meet only
    after each is one row per country, so neither multiplies the other.
    """
    hours = elapsed("HOUR", F.lit(launched).cast("timestamp_ntz"), F.col("review_time"))
    timed = reviews.withColumn("hours", hours)
    peaks = timed.groupBy("country_name", F.hour("review_time").alias("peak_response_hour")).agg(_rows().alias("k"))
    peak = windows.top1_per_group(
        peaks, ["country_name"], [-F.col("k"), F.col("peak_response_hour")], ["peak_response_hour"]
    )
    early = F.count_if(F.col("hours") <= 24)
    per_country = timed.groupBy("country_name").agg(
        F.countDistinct("review_id").alias("total_reviews"),
        F.round(F.avg("hours"), 2).alias("avg_response_hours"),
        F.min("hours").alias("fastest_response_hours"),
        early.alias("reviews_within_24h"),
        pct(early, _rows()).alias("response_rate_24h"),
        F.count_if("voted_up").alias("positive_reviews"),
        F.count_if(~F.col("voted_up")).alias("negative_reviews"),
        F.round(F.avg("votes_up"), 2).alias("avg_votes_up"),
    )
    wished = wishlists.groupBy("country_name").agg(
        F.sum("wishlists").alias("total_wishlists"), F.sum("units").alias("total_sales")
    )
    joined = per_country.join(peak, "country_name", "left").join(wished, "country_name", "left")
    rated = joined.withColumn("positive_ratio", pct("positive_reviews", F.col("positive_reviews") + F.col("negative_reviews")))
    ranked = windows.rank_by(rated, "response_speed_rank", F.col("avg_response_hours").asc())
    ranked = windows.rank_by(ranked, "response_rate_rank", F.col("response_rate_24h").desc())
    return ranking.top_n(ranked, [F.col("avg_response_hours").asc()], n, ["country_name"])


def regional_sales(daily: DataFrame, n: int = 10) -> DataFrame:
    """Wishlists and sales by region from (region_name, event_date, wishlists, units) rows."""
    grouped = daily.groupBy("region_name").agg(
        F.countDistinct("event_date").alias("days_tracked"),
        F.sum("wishlists").alias("total_wishlists"),
        F.sum("units").alias("total_sales"),
        F.round(F.avg("wishlists"), 2).alias("avg_daily_wishlists"),
        F.round(F.avg("units"), 2).alias("avg_daily_sales"),
        F.min("event_date").alias("period_start"),
        F.max("event_date").alias("period_end"),
    )
    return ranking.top_n(grouped, [F.col("total_sales").desc()], n, ["region_name"])


def traffic_vs_social(traffic: DataFrame, social: DataFrame) -> DataFrame:
    """Traffic and social growth side by side, with their joint movement and delay.

    ``social`` is one row per event_date: total_messages, total_reactions, total_authors.
    """
    rated = windows.pct_change(traffic, "total_visits", "event_date", "traffic_growth_rate")
    named = social.select(
        "event_date",
        F.col("total_messages").alias("social_messages"),
        F.col("total_reactions").alias("social_reactions"),
        F.col("total_authors").alias("social_authors"),
    )
    joined = joins.align_series(rated, named, "event_date", ["social_messages", "social_reactions", "social_authors"])
    moved = windows.pct_change(joined, "social_messages", "event_date", "social_growth_rate")
    known = moved.filter(F.col("traffic_growth_rate").isNotNull()).withColumn(
        "correlation_type", labels.traffic_comovement("traffic_growth_rate", "social_growth_rate")
    )
    one, two, now = labels.TIMING_LABELS
    return windows.lagged_effect(
        known, "traffic_growth_rate", "social_growth_rate", "event_date", [1, 2], [one, two], now
    )


def wishlist_vs_social(wishlist: DataFrame, social: DataFrame) -> DataFrame:
    """Wishlist change against social change; dates arrive as text and may be broken.

    ``wishlist`` has date_local, adds, deletes, purchases.
    """
    dated = wishlist.withColumn("event_date", lenient_date("date_local")).filter(F.col("event_date").isNotNull())
    net = dated.withColumn("net_wishlist_change", F.col("adds") - F.col("deletes")).drop("date_local")
    rated = windows.pct_change(net, "net_wishlist_change", "event_date", "wishlist_change_rate", guard="abs")
    named = social.select(
        "event_date",
        F.col("total_messages").alias("social_messages"),
        F.col("total_reactions").alias("social_reactions"),
        F.col("total_authors").alias("social_authors"),
    )
    joined = joins.align_series(rated, named, "event_date", ["social_messages", "social_reactions", "social_authors"])
    moved = windows.pct_change(joined, "social_messages", "event_date", "social_change_rate")
    return moved.filter(F.col("wishlist_change_rate").isNotNull()).withColumn(
        "correlation_type", labels.wishlist_comovement("wishlist_change_rate", "social_change_rate")
    )


# -- summaries -----------------------------------------------------------------------------


def platform_summary(c: Community) -> DataFrame:
    """Content and reactions per platform of the chosen days."""
    return c.contents().groupBy("platform").agg(
        F.countDistinct("content_id").alias("total_content"),
        F.sum("reaction_count").alias("total_reactions"),
        F.round(F.avg("reaction_count"), 2).alias("avg_reactions"),
        F.max("reaction_count").alias("max_reactions"),
        F.min("event_time").alias("earliest_time"),
        F.max("event_time").alias("latest_time"),
    )


def week_summary(c: Community) -> DataFrame:
    """Activity and engagement of the chosen days as one row per platform."""
    discord = c.messages().agg(
        F.countDistinct("message_id").alias("activity_count"), sum0("reaction_count").alias("engagement_count")
    )
    steam = c.review.agg(
        F.countDistinct("recommendationid").alias("activity_count"), sum0("votes_up").alias("engagement_count")
    )
    return sets.union_tagged({"discord": discord, "steam": steam})


# Texts of the statistics report.
STATISTICS_SECTIONS = ("=== 통합 소셜 반응 통계 ===", "플랫폼별 통계")
STATISTICS_WORDS = ("개 콘텐츠, ", "개 반응, ", "% 긍정 (스팀 리뷰 기준)", "개 긍정, ", "개 부정")


def statistics_text(c: Community) -> DataFrame:
    """Overall and per-platform statistics as text lines in report order."""
    contents = c.contents()
    positive, negative = F.col("sentiment") == "positive", F.col("sentiment") == "negative"
    per_content = contents.groupBy("content_id", "platform").agg(
        F.sum("reaction_count").alias("reactions"), F.count_if(positive).alias("p"), F.count_if(negative).alias("n")
    )
    # ids are unique to their platform except by chance: the total counts an id on its first platform alone
    first = F.row_number().over(Window.partitionBy("content_id").orderBy("platform")) == 1
    counted = F.col("content_id").isNotNull()
    levels = (
        per_content.withColumn("first", first & counted)
        .rollup("platform")
        .agg(
            F.grouping("platform").alias("overall"),
            F.count("content_id").alias("content"),
            F.count_if("first").alias("ids"),
            *[F.sum(c).alias(c) for c in ("reactions", "p", "n")],
        )
    )
    content, reactions, rated_positive, positives, negatives = (F.lit(w) for w in STATISTICS_WORDS)
    overall = F.col("overall") == 1
    ratio = F.coalesce(pct("p", F.col("p") + F.col("n")), F.lit(0.0)).cast("decimal(5,2)")
    lines = levels.select(
        F.when(~overall, F.col("reactions")).alias("__weight"),
        F.when(overall, STATISTICS_SECTIONS[0]).otherwise(STATISTICS_SECTIONS[1]).alias("section"),
        F.when(overall, joined_text("ids", content, "reactions", reactions, ratio, rated_positive))
        .otherwise(
            joined_text(
                "platform", F.lit(": "), "content", content, "reactions", reactions, "p", positives, "n", negatives
            )
        )
        .alias("detail"),
    )
    ordered = lines.orderBy(F.col("__weight").desc_nulls_first(), "detail")
    return ordered.drop("__weight")


def keyword_frequency(df: DataFrame, text: str, stop_words: DataFrame, n: int, min_length: int = 2) -> DataFrame:
    """Most frequent words over whole texts, without stop words.

    Words are counted per text on the map side first, so a text with many
    repeats of one word sends that word once.
    """
    words = df.select(F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("word"))
    counts = words.filter(F.length("word") >= min_length).groupBy("word").agg(_rows().alias("frequency"))
    kept = joins.remove_keys(counts, stop_words, "word")
    return ranking.top_n(kept, [F.col("frequency").desc()], n, ["word"])
