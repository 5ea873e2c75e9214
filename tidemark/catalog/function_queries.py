"""Scalar functions over the stand-in views."""

from pyspark.sql import functions as F

from tidemark.functions import dates, numbers, text
from tidemark.registry import query

_TS = "cast(o_orderdate as timestamp)"


@query(
    "h01_epoch_to_timestamp",
    "select event_id, make_timestamp(epoch_us(event_time) // 1000000 * 1000000) as seen from activity",
)
def h01(v):
    seconds = F.unix_seconds(F.col("event_time").cast("timestamp"))
    return v.activity.select("event_id", dates.from_epoch_seconds(seconds).cast("timestamp_ntz").alias("seen"))


@query(
    "h02_hour_of_day",
    "select cast(hour(event_time) as integer) as h, count(*) as n from activity group by 1",
)
def h02(v):
    return v.activity.groupBy(dates.hour_of("event_time").alias("h")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "h03_truncate",
    """select date_trunc('hour', event_time)::timestamp as hour_bucket, date_trunc('week', event_time)::timestamp as week_start,
              date_trunc('month', event_time)::timestamp as month_start, count(*) as n from activity group by 1, 2, 3""",
)
def h03(v):
    return v.activity.groupBy(
        dates.truncated("event_time", "hour").alias("hour_bucket"),
        dates.truncated("event_time", "week").alias("week_start"),
        dates.truncated("event_time", "month").alias("month_start"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("h04_date_of_timestamp", "select event_id, cast(event_time as date) as day from activity")
def h04(v):
    return v.activity.select("event_id", dates.day_of("event_time").alias("day"))


@query(
    "h05_date_shift",
    """select o_orderkey, cast(cast(o_orderdate as date) - interval 7 day as date) as week_before,
         cast(cast(o_orderdate as date) + interval 1 day as date) as day_after,
         o_orderdate + interval 90 minute as later from orders""",
)
def h05(v):
    day = dates.day_of("o_orderdate")
    return v.orders.select(
        "o_orderkey",
        dates.days_before(day, 7).alias("week_before"),
        dates.days_after(day, 1).alias("day_after"),
        (F.col("o_orderdate") + F.expr("INTERVAL 90 MINUTES")).alias("later"),
    )


@query(
    "h06_hours_between",
    "select event_id, date_sub('hour', timestamp '2024-01-01 00:30:00', event_time) as hours from activity",
)
def h06(v):
    start = F.lit("2024-01-01 00:30:00").cast("timestamp_ntz")
    return v.activity.select("event_id", dates.elapsed("HOUR", start, F.col("event_time")).alias("hours"))


@query(
    "h07_minutes_seconds_between",
    """select event_id, date_sub('minute', timestamp '2024-01-10 12:00:00', event_time) as minutes,
         date_sub('second', timestamp '2024-01-10 12:00:00', event_time) as seconds from activity""",
)
def h07(v):
    start = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    return v.activity.select(
        "event_id",
        dates.elapsed("MINUTE", start, F.col("event_time")).alias("minutes"),
        dates.elapsed("SECOND", start, F.col("event_time")).alias("seconds"),
    )


@query(
    "h08_lenient_date",
    """select o_orderkey, case when o_orderpriority <> '5-LOW' then cast(o_orderdate as date) end as parsed from orders""",
)
def h08(v):
    shown = F.date_format("o_orderdate", "yyyy-MM-dd")
    broken = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("n/a "), shown)).otherwise(shown)
    return v.orders.select("o_orderkey", dates.lenient_date(broken).alias("parsed"))


@query("h09_last_day", "select distinct cast(last_day(event_date) as date) as month_end from message")
def h09(v):
    return v.message.select(dates.month_end("event_date").alias("month_end")).distinct()


@query(
    "h10_casts",
    """select o_orderkey, cast(o_totalprice as decimal(38,2)) as price, cast(o_orderkey as varchar) as key_text,
         try_cast(split_part(o_orderpriority, '-', 1) as bigint) as level, try_cast(o_orderpriority as bigint) as broken from orders""",
)
def h10(v):
    return v.orders.select(
        "o_orderkey",
        numbers.money("o_totalprice").alias("price"),
        F.col("o_orderkey").cast("string").alias("key_text"),
        F.element_at(F.split("o_orderpriority", "-"), 1).try_cast("bigint").alias("level"),
        F.col("o_orderpriority").try_cast("bigint").alias("broken"),
    )


@query(
    "h11_round_abs",
    """select c_custkey, round(cast(c_acctbal as decimal(18,2)) / 7, 2)::double as seventh, abs(c_acctbal) as size from customer""",
)
def h11(v):
    return v.customer.select(
        "c_custkey",
        F.round(numbers.exact("c_acctbal") / 7, 2).cast("double").alias("seventh"),
        F.abs("c_acctbal").alias("size"),
    )


@query(
    "h12_coalesce_nullif",
    """select c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'other') as segment, coalesce(n, 0) as orders_placed
       from customer left join (select o_custkey, count(*) as n from orders group by 1) o on o_custkey = c_custkey""",
)
def h12(v):
    counts = v.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return v.customer.join(counts, "c_custkey", "left").select(
        "c_custkey",
        F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("other")).alias("segment"),
        F.coalesce("n", F.lit(0)).alias("orders_placed"),
    )


@query(
    "h13_safe_division",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / nullif(l_discount, 0) as per_discount from lineitem""",
)
def h13(v):
    return v.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        numbers.safe_divide("l_extendedprice", "l_discount").alias("per_discount"),
    )


@query("h14_text_length", "select doc_id, cast(length(text) as integer) as chars from documents")
def h14(v):
    return v.documents.select("doc_id", F.length("text").alias("chars"))


@query(
    "h15_joined_text",
    """select topic_id, coalesce(subforum, '') || ': ' || coalesce(title, '') || ' since ' || coalesce(cast(event_date as varchar), '') as line from topic""",
)
def h15(v):
    line = text.joined_text("subforum", F.lit(": "), "title", F.lit(" since "), "event_date")
    return v.topic.select("topic_id", line.alias("line"))


@query(
    "h16_mentions_any",
    "select doc_id, text like '%the%' or text like '%ing%' as found from documents",
)
def h16(v):
    return v.documents.select("doc_id", text.mentions_any("text", ["the", "ing"]).alias("found"))


@query(
    "h17_normalize_sql",
    r"select query_id, trim(regexp_replace(regexp_replace(upper(sql), '\s+', ' ', 'g'), ';+$', '')) as normalized from sql_text",
)
def h17(v):
    return v.sql_text.select("query_id", text.normalize_sql("sql").alias("normalized"))


@query("h18_preview", "select doc_id, substring(text, 1, 80) as shown from documents")
def h18(v):
    return v.documents.select("doc_id", text.preview("text", 80).alias("shown"))


@query(
    "h19_fiscal_year",
    """select cast(year(event_date) + case when month(event_date) >= 7 then 1 else 0 end as integer) as fiscal_year, count(*) as n
       from message group by 1""",
)
def h19(v):
    return v.message.groupBy(dates.fiscal_year("event_date").alias("fiscal_year")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "h21_stable_id",
    """select query_id, md5(cast(query_id as varchar) || chr(31) || sql) as id,
              regexp_matches(md5(cast(query_id as varchar) || chr(31) || sql), '^[0-9a-f]{32}$') as id_ok,
              false as text_ok from sql_text""",
)
def h21(v):
    made = v.sql_text.withColumn("id", text.stable_id("query_id", "sql"))
    return made.select("query_id", "id", text.is_hex_id("id").alias("id_ok"), text.is_hex_id("sql").alias("text_ok"))


@query(
    "h22_three_part_name",
    """select distinct name, len(string_split(name, '.')) = 3 and
              len(list_filter(string_split(name, '.'), lambda p: trim(p) = '')) = 0 as valid from
       (select case when p_size > 40 then p_type || '. .' || p_brand when p_size > 20 then 'main.' || p_type || '.' || p_brand
                    else p_type || '.' || p_brand end as name from part) n""",
)
def h22(v):
    size = F.col("p_size")
    name = (
        F.when(size > 40, F.concat("p_type", F.lit(". ."), "p_brand"))
        .when(size > 20, F.concat(F.lit("main."), "p_type", F.lit("."), "p_brand"))
        .otherwise(F.concat("p_type", F.lit("."), "p_brand"))
    )
    return v.part.select(name.alias("name")).distinct().withColumn("valid", text.is_three_part_name("name"))


@query(
    "h23_array_values",
    """select p_partkey, case when list_contains(string_split(p_name, ' '), 'ring') then string_split(p_name, ' ')
             else list_append(string_split(p_name, ' '), 'ring') end as added,
         list_filter(string_split(p_name, ' '), lambda w: w <> 'small') as removed from part""",
)
def h23(v):
    words = F.split("p_name", " ")
    return v.part.select(
        "p_partkey",
        text.with_value(words, F.lit("ring")).alias("added"),
        text.without_value(words, F.lit("small")).alias("removed"),
    )


@query(
    "h24_details_map",
    """select p_partkey, map {'brand': p_brand, 'size': cast(p_size as varchar)} as details from part""",
)
def h24(v):
    fields = F.create_map(
        F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"),
        F.lit("size"), F.col("p_size").cast("string"), F.lit("missing"), F.lit(None).cast("string"),
    )
    return v.part.select("p_partkey", text.details_map(fields, ["type", "table", "column"]).alias("details"))


@query(
    "h25_first_json",
    """select event_id, coalesce(json_extract_string(props, '$.name'), json_extract_string(props, '$.k')) as found from activity""",
)
def h25(v):
    return v.activity.select("event_id", text.first_json("props", "$.name", "$.nested.k", "$.k").alias("found"))


@query(
    "h26_joined_lines",
    "select query_id, replace(sql, ' ', '') as one_line from sql_text",
)
def h26(v):
    return v.sql_text.select("query_id", text.joined_lines(F.split("sql", " ")).alias("one_line"))


@query(
    "h27_year_month_name",
    """select o_orderkey, cast(year(o_orderdate) as integer) as y, cast(month(o_orderdate) as integer) as m,
              o_orderstatus || ' ' || o_orderpriority as full_name from orders""",
)
def h27(v):
    return v.orders.select(
        "o_orderkey",
        F.year("o_orderdate").alias("y"),
        F.month("o_orderdate").alias("m"),
        F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("full_name"),
    )
