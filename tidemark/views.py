"""Stand-in views: the community, KPI and run tables derived from the test tables.

``VIEW_SQL`` states each view for the check engine; ``Views`` builds the same
relation with the DataFrame API.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# anchor dates that stand for "today" in relative filters
ORDERS_AS_OF = "2001-08-01"
EVENTS_AS_OF = "2024-01-30"

VIEW_SQL: dict[str, str] = {
    "message": """
        select o_orderkey as message_id, o_custkey as author_id, o_orderdate as created_at,
               cast(o_orderdate as date) as event_date, o_orderstatus as game_code,
               c_nationkey as channel_id, concat(o_orderpriority, ' ', c_mktsegment) as message
        from orders join customer on o_custkey = c_custkey""",
    "reaction": """
        select l_orderkey as message_id, concat(l_returnflag, l_linestatus) as emoji_name,
               cast(l_quantity as bigint) as cnt
        from lineitem""",
    "channel": """
        select n_nationkey as channel_id, n_name as channel_name, n_regionkey as guild_id
        from nation""",
    "review": """
        select l_orderkey as recommendationid, l_suppkey % 3 as app_id,
               cast(l_shipdate as date) as event_date, l_returnflag <> 'R' as voted_up,
               cast(l_quantity as bigint) as votes_up, l_discount as weighted_vote_score,
               l_partkey as part_id, l_suppkey as reviewer_id, l_linenumber as revision,
               l_extendedprice as playtime
        from lineitem""",
    "topic": """
        select p_partkey as topic_id, concat('/t/', cast(p_partkey as varchar(20))) as url,
               p_name as title, p_brand as subforum,
               cast(o.d as date) as event_date
        from part left join (select l_partkey, min(l_shipdate) as d from lineitem group by l_partkey) o
          on p_partkey = o.l_partkey""",
    "comment": """
        select concat('/t/', cast(l_partkey as varchar(20))) as topic_url,
               l_orderkey as comment_id, l_suppkey as author, l_linestatus = 'F' as is_deleted,
               l_shipdate as commented_at, cast(l_shipdate as date) as event_date
        from lineitem""",
    "activity": """
        select event_id, ts as event_time, cast(ts as date) as event_date, user_id,
               event_type as platform, value as engagement, props
        from events""",
    "kpi_daily": """
        select cast(o_orderdate as date) as event_date, o_orderstatus as game_code,
               c_nationkey as country_code, c_mktsegment as user_type,
               count(distinct o_custkey) as active_user,
               count(distinct case when o_orderpriority in ('1-URGENT', '2-HIGH') then o_custkey end)
                 as cash_paying_user,
               sum(cast(o_totalprice as decimal(18,2))) as cash_revenue,
               count(*) * 30 as online_ts_mins
        from orders join customer on o_custkey = c_custkey
        group by cast(o_orderdate as date), o_orderstatus, c_nationkey, c_mktsegment""",
    "region_dim": """
        select n_nationkey as country_code, r_name as region_name
        from nation join region on n_regionkey = r_regionkey""",
    "product_sales": """
        select cast(l_shipdate as date) as sale_date, l_linestatus as platform,
               l_partkey as product_id, l_suppkey as sales_id,
               cast(l_quantity as bigint) as unit_sold,
               cast(l_extendedprice as decimal(18,2)) as paid_used
        from lineitem""",
    "product_dim": """
        select p_partkey as product_id, p_type as category, p_brand as sub_category,
               p_name as product_name
        from part""",
    "traffic": """
        select cast(ts as date) as event_date,
               cast(sum(case when event_type = 'view' then 1 else 0 end) as bigint) as visits,
               cast(sum(case when event_type = 'signup' then 1 else 0 end) as bigint) as adds,
               cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as deletes,
               cast(sum(case when event_type = 'purchase' then 1 else 0 end) as bigint) as purchases
        from events group by cast(ts as date)""",
    "bench_result": """
        select concat('run_', source) as run_id, cast(d.doc_id // 20 % 5 + 1 as int) as iteration_number,
               d.doc_id as result_id, d.doc_id // 100 % 20 as benchmark_id,
               concat('question ', cast(d.doc_id // 100 % 20 as varchar(4))) as question,
               l.quality = 1 as passed,
               case when l.quality = 1 then null when l.toxic = 1 then 'wrong_join'
                    when d.lang = 'en' then 'wrong_filter' else 'wrong_aggregation' end
                 as failure_category,
               cast(d.n_chars as double) / 100 as response_time_seconds
        from documents d join labels l on d.doc_id = l.doc_id""",
    "change_row": """
        select concat('run_src', cast(p_size % 20 as varchar(3))) as run_id,
               cast(p_partkey % 5 + 1 as int) as iteration_number, p_partkey as change_id,
               concat('add_', lower(substring(p_type, 1, 5))) as change_type,
               p_brand as target_table, p_partkey % 4 <> 0 as applied_successfully
        from part""",
    "pair_expected": """
        select o_custkey as pair_id, o_orderkey as row_key, o_orderstatus as c1, o_totalprice as c2
        from orders""",
    "pair_actual": """
        select o_custkey as pair_id, o_orderkey as row_key, lower(o_orderstatus) as c1,
               case when o_orderpriority = '1-URGENT' and o_orderstatus = 'P'
                    then o_totalprice + 5 else o_totalprice + 0.001 end as c2
        from orders where o_totalprice <= 495000""",
    "sql_text": """
        select p_partkey as query_id,
               concat('SELECT ', p_brand, ', SUM(x', cast(p_size % 3 as varchar(3)), ')  FROM t',
                      cast(p_size % 5 as varchar(3)), ' JOIN d', cast(p_size % 4 as varchar(3)),
                      ' ON t', cast(p_size % 5 as varchar(3)), '.k = d', cast(p_size % 4 as varchar(3)),
                      '.k WHERE size = ', cast(p_size as varchar(4)), ' AND kind = ''', p_type,
                      ''' GROUP BY 1', case when p_size % 2 = 0 then ' ORDER BY 2 DESC LIMIT 10;'
                                            else ';' end) as sql,
               concat('total x', cast(p_size % 3 as varchar(3)), ' by ', p_name, ' for ',
                      lower(p_type)) as question
        from part""",
}

_BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _words(sql: str) -> set[str]:
    without_text = re.sub(r"'[^']*'", "''", sql)
    return set(re.findall(r"(?:from|join|in \(table)\s+([a-z_]+)", without_text, re.I))


def with_views(sql: str) -> str:
    """Prefix a check query with the definitions of the views it mentions."""
    needed = [name for name in VIEW_SQL if name in _words(sql)]
    if not needed:
        return sql.strip()
    clause = ",\n".join(f"{name} as ({VIEW_SQL[name].strip()})" for name in needed)
    body = sql.strip()
    if body[:5].lower() == "with ":
        if body[5:15].lower() == "recursive ":
            return f"with recursive {clause},\n{body[15:]}"
        return f"with {clause},\n{body[5:]}"
    return f"with {clause}\n{body}"


class Views:
    """The base tables and stand-in views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        if name not in _BASE:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in _BASE:
            raise AttributeError(name)
        return self.table(name)

    @cached_property
    def _orders_with_customer(self) -> DataFrame:
        return self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey"))

    @cached_property
    def message(self) -> DataFrame:
        return self._orders_with_customer.select(
            F.col("o_orderkey").alias("message_id"),
            F.col("o_custkey").alias("author_id"),
            F.col("o_orderdate").alias("created_at"),
            F.to_date("o_orderdate").alias("event_date"),
            F.col("o_orderstatus").alias("game_code"),
            F.col("c_nationkey").alias("channel_id"),
            F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("message"),
        )

    @cached_property
    def reaction(self) -> DataFrame:
        return self.lineitem.select(
            F.col("l_orderkey").alias("message_id"),
            F.concat("l_returnflag", "l_linestatus").alias("emoji_name"),
            F.col("l_quantity").cast("bigint").alias("cnt"),
        )

    @cached_property
    def channel(self) -> DataFrame:
        return self.nation.select(
            F.col("n_nationkey").alias("channel_id"),
            F.col("n_name").alias("channel_name"),
            F.col("n_regionkey").alias("guild_id"),
        )

    @cached_property
    def review(self) -> DataFrame:
        return self.lineitem.select(
            F.col("l_orderkey").alias("recommendationid"),
            (F.col("l_suppkey") % 3).alias("app_id"),
            F.to_date("l_shipdate").alias("event_date"),
            (F.col("l_returnflag") != "R").alias("voted_up"),
            F.col("l_quantity").cast("bigint").alias("votes_up"),
            F.col("l_discount").alias("weighted_vote_score"),
            F.col("l_partkey").alias("part_id"),
            F.col("l_suppkey").alias("reviewer_id"),
            F.col("l_linenumber").alias("revision"),
            F.col("l_extendedprice").alias("playtime"),
        )

    @cached_property
    def topic(self) -> DataFrame:
        opened = self.lineitem.groupBy("l_partkey").agg(F.to_date(F.min("l_shipdate")).alias("event_date"))
        return self.part.join(opened, F.col("p_partkey") == F.col("l_partkey"), "left").select(
            F.col("p_partkey").alias("topic_id"),
            F.concat(F.lit("/t/"), F.col("p_partkey").cast("string")).alias("url"),
            F.col("p_name").alias("title"),
            F.col("p_brand").alias("subforum"),
            "event_date",
        )

    @cached_property
    def comment(self) -> DataFrame:
        return self.lineitem.select(
            F.concat(F.lit("/t/"), F.col("l_partkey").cast("string")).alias("topic_url"),
            F.col("l_orderkey").alias("comment_id"),
            F.col("l_suppkey").alias("author"),
            (F.col("l_linestatus") == "F").alias("is_deleted"),
            F.col("l_shipdate").alias("commented_at"),
            F.to_date("l_shipdate").alias("event_date"),
        )

    @cached_property
    def activity(self) -> DataFrame:
        return self.events.select(
            "event_id",
            F.col("ts").alias("event_time"),
            F.to_date("ts").alias("event_date"),
            "user_id",
            F.col("event_type").alias("platform"),
            F.col("value").alias("engagement"),
            "props",
        )

    @cached_property
    def kpi_daily(self) -> DataFrame:
        paying = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0)
        # one row per customer first: counting distinct customers is then a plain sum
        per_customer = self._orders_with_customer.groupBy(
            F.to_date("o_orderdate").alias("event_date"),
            F.col("o_orderstatus").alias("game_code"),
            F.col("c_nationkey").alias("country_code"),
            F.col("c_mktsegment").alias("user_type"),
            "o_custkey",
        ).agg(
            F.max(paying).alias("paying"),
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("revenue"),
            F.count(F.lit(1)).alias("n"),
        )
        return per_customer.groupBy("event_date", "game_code", "country_code", "user_type").agg(
            F.count(F.lit(1)).alias("active_user"),
            F.sum("paying").alias("cash_paying_user"),
            F.sum("revenue").cast("decimal(38,2)").alias("cash_revenue"),
            (F.sum("n") * 30).alias("online_ts_mins"),
        )

    @cached_property
    def region_dim(self) -> DataFrame:
        return self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").alias("country_code"), F.col("r_name").alias("region_name")
        )

    @cached_property
    def product_sales(self) -> DataFrame:
        return self.lineitem.select(
            F.to_date("l_shipdate").alias("sale_date"),
            F.col("l_linestatus").alias("platform"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("sales_id"),
            F.col("l_quantity").cast("bigint").alias("unit_sold"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("paid_used"),
        )

    @cached_property
    def product_dim(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("sub_category"),
            F.col("p_name").alias("product_name"),
        )

    @cached_property
    def traffic(self) -> DataFrame:
        def of(kind: str):
            return F.count_if(F.col("event_type") == kind)

        return self.events.groupBy(F.to_date("ts").alias("event_date")).agg(
            of("view").alias("visits"),
            of("signup").alias("adds"),
            of("error").alias("deletes"),
            of("purchase").alias("purchases"),
        )

    @cached_property
    def bench_result(self) -> DataFrame:
        benchmark = F.expr("(doc_id div 100) % 20")
        return self.documents.select("doc_id", "source", "lang", "n_chars").join(self.labels, "doc_id").select(
            F.concat(F.lit("run_"), "source").alias("run_id"),
            F.expr("cast((doc_id div 20) % 5 + 1 as int)").alias("iteration_number"),
            F.col("doc_id").alias("result_id"),
            benchmark.alias("benchmark_id"),
            F.concat(F.lit("question "), benchmark.cast("string")).alias("question"),
            (F.col("quality") == 1).alias("passed"),
            F.when(F.col("quality") == 1, None)
            .when(F.col("toxic") == 1, "wrong_join")
            .when(F.col("lang") == "en", "wrong_filter")
            .otherwise("wrong_aggregation")
            .alias("failure_category"),
            (F.col("n_chars").cast("double") / 100).alias("response_time_seconds"),
        )

    @cached_property
    def change_row(self) -> DataFrame:
        return self.part.select(
            F.concat(F.lit("run_src"), (F.col("p_size") % 20).cast("string")).alias("run_id"),
            (F.col("p_partkey") % 5 + 1).cast("int").alias("iteration_number"),
            F.col("p_partkey").alias("change_id"),
            F.concat(F.lit("add_"), F.lower(F.substring("p_type", 1, 5))).alias("change_type"),
            F.col("p_brand").alias("target_table"),
            (F.col("p_partkey") % 4 != 0).alias("applied_successfully"),
        )

    @cached_property
    def pair_expected(self) -> DataFrame:
        return self.orders.select(
            F.col("o_custkey").alias("pair_id"),
            F.col("o_orderkey").alias("row_key"),
            F.col("o_orderstatus").alias("c1"),
            F.col("o_totalprice").alias("c2"),
        )

    @cached_property
    def pair_actual(self) -> DataFrame:
        changed = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")
        return self.orders.filter(F.col("o_totalprice") <= 495000).select(
            F.col("o_custkey").alias("pair_id"),
            F.col("o_orderkey").alias("row_key"),
            F.lower("o_orderstatus").alias("c1"),
            F.when(changed, F.col("o_totalprice") + 5).otherwise(F.col("o_totalprice") + 0.001).alias("c2"),
        )

    @cached_property
    def sql_text(self) -> DataFrame:
        size = F.col("p_size")

        def part(modulus: int):
            return (size % modulus).cast("string")

        return self.part.select(
            F.col("p_partkey").alias("query_id"),
            F.concat(
                F.lit("SELECT "), "p_brand", F.lit(", SUM(x"), part(3), F.lit(")  FROM t"), part(5),
                F.lit(" JOIN d"), part(4), F.lit(" ON t"), part(5), F.lit(".k = d"), part(4),
                F.lit(".k WHERE size = "), size.cast("string"), F.lit(" AND kind = '"), "p_type",
                F.lit("' GROUP BY 1"),
                F.when(size % 2 == 0, " ORDER BY 2 DESC LIMIT 10;").otherwise(";"),
            ).alias("sql"),
            F.concat(
                F.lit("total x"), part(3), F.lit(" by "), "p_name", F.lit(" for "), F.lower("p_type")
            ).alias("question"),
        )
