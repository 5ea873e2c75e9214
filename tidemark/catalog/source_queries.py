"""Sources and sinks: sets written to the shared folder by Spark and read back."""

from pyspark.sql import functions as F

from tidemark.plans import tracking
from tidemark.registry import query
from tidemark.session import scratch_path
from tidemark.sources import benchmarks, suite, tables
from tidemark.sources.schemas import conform

_PAIRS = "select cast(query_id as varchar) as id, question, sql as expected_sql from sql_text"


def pairs(v):
    return v.sql_text.select(
        F.col("query_id").cast("string").alias("id"), "question", F.col("sql").alias("expected_sql")
    )


@query("a01_read_benchmarks", f"{_PAIRS} union all {_PAIRS}")
def a01(v):
    """Wrapped and bare documents side by side, one file per row batch."""
    path = scratch_path(v.spark, "benchmarks")
    item = F.struct("id", "question", "expected_sql")
    wrapped = F.to_json(F.struct(F.array(item).alias("benchmarks"), F.struct(F.lit(1).alias("total")).alias("metadata")))
    shown = pairs(v).select(F.explode(F.array(wrapped, F.to_json(F.array(item)))).alias("value"))
    # a document per line is a document per row for the line reader
    shown.write.text(path)
    return benchmarks.read_benchmarks(v.spark, path, lines=True).select("id", "question", "expected_sql")


def markdown(v):
    """One markdown text per query: a full section, one without a question, one without SQL, a second full one."""
    fence = F.concat(F.lit("```sql\n"), "sql", F.lit("\n```\n"))
    heading = F.concat(F.lit("## "), F.lit("1. 제목 "), "question", F.lit(" ✅\n\n"))
    asked = F.concat(F.lit("**Question:** "), "question", F.lit("\n\n"))
    return v.sql_text.select(
        F.concat(F.lit("doc-"), F.col("query_id").cast("string")).alias("file"),
        F.concat(
            F.lit("# Intro\n\n"), heading, asked, fence,
            F.lit("\n### 2. only sql\n"), fence,
            F.lit("\n## 3. no sql\n"), asked,
            F.lit("\n## 14. last one\ntext\n"), asked, F.lit("more\n"), fence,
        ).alias("text"),
    )


_SECTIONS = """select md5('doc-' || query_id::varchar || chr(31) || n::varchar || chr(31) || question) as id, question, sql as expected_sql,
  case n when 1 then '제목 ' || question else 'last one' end as korean_question, 'doc-' || query_id::varchar as source_file, n as question_number
  from sql_text, (select unnest([1, 14])::integer as n) k"""


@query("a02_extract_sections", _SECTIONS)
def a02(v):
    return benchmarks.extract_qa_sections(markdown(v), "text", "file")


@query(
    "a02_extract_sections_by_title",
    """select query_id, count(*) as sections from sql_text, (select unnest([1, 2, 14]) as n) k group by 1""",
)
def a02_title(v):
    found = benchmarks.extract_qa_sections(markdown(v), "text", "file", require_question=False)
    return found.groupBy(F.substring("source_file", 5, 20).cast("bigint").alias("query_id")).agg(
        F.count(F.lit(1)).alias("sections")
    )


@query(
    "a03_ingest_dir",
    """select p_type as kind, cast(count(*) * 2 as bigint) as row_count from part group by 1""",
)
def a03(v):
    path = scratch_path(v.spark, "markdown")
    kinds = v.part.select(F.concat(F.lit("doc-"), F.col("p_partkey").cast("string")).alias("file"), "p_type")
    # files of one kind and task, all sections of their texts inside; a file is read whole, so its texts are bounded.
    # both sides hold all parts: joined by sorting, never broadcast
    shown = markdown(v).join(kinds.hint("merge"), "file").select(F.regexp_replace("text", "# Intro", "").alias("value"), "p_type")
    shown.write.option("maxRecordsPerFile", 2_000).partitionBy("p_type").text(path)
    counted = benchmarks.rows_per_file(benchmarks.ingest_dir(v.spark, path))
    return counted.groupBy(F.regexp_extract("source_file", "/p_type=([^/]*)/", 1).alias("kind")).agg(
        F.sum("row_count").alias("row_count")
    )


@query(
    "a04_write_benchmarks",
    "select 'written' as part, count(*) as n from sql_text union all select 'counted', count(*) from sql_text",
)
def a04(v):
    path = scratch_path(v.spark, "set")
    benchmarks.write_benchmarks(pairs(v).withColumn("source_file", F.lit("corpus")), path)
    written = benchmarks.read_benchmarks(v.spark, f"{path}/benchmarks", lines=True)
    counted = v.spark.read.schema("source_file string, row_count bigint").json(f"{path}/metadata")
    return written.agg(F.count(F.lit(1)).alias("n")).select(F.lit("written").alias("part"), "n").unionByName(
        counted.agg(F.sum("row_count").alias("n")).select(F.lit("counted").alias("part"), "n")
    )


@query("a05_read_table", "select o_orderstatus, count(*) as n from orders group by 1")
def a05(v):
    v.orders.createOrReplaceTempView("tidemark_orders")
    held = tables.read_table(v.spark, "tidemark_orders")
    v.spark.catalog.dropTempView("tidemark_orders")  # the plan is resolved; the caller's session stays as it was
    return held.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a06_append_rows",
    """select run_id, passed, cast(count(*) * 2 as bigint) as n, cast(0 as bigint) as with_sql from bench_result group by 1, 2""",
)
def a06(v):
    path = scratch_path(v.spark, "results")
    for _ in range(2):
        tables.append_rows(v.bench_result, path, table="enhancement_benchmarks")
    back = tables.read_table(v.spark, path, table="enhancement_benchmarks")
    return back.groupBy("run_id", "passed").agg(
        F.count(F.lit(1)).alias("n"), F.count("generated_sql").alias("with_sql")
    )


@query(
    "a07_declared_schema",
    """select cast(benchmark_id as varchar) as benchmark_id, passed, count(*) as n, cast(0 as bigint) as with_time from bench_result group by 1, 2""",
)
def a07(v):
    shaped = conform(v.bench_result, "enhancement_benchmarks")
    return shaped.groupBy("benchmark_id", "passed").agg(
        F.count(F.lit(1)).alias("n"), F.count("created_at").alias("with_time")
    )


@query(
    "a08_latest_state",
    """select user_id, event_time, event_id, platform from (select *, row_number() over (partition by user_id order by event_time desc, event_id desc) as rn
       from activity) a where rn = 1""",
)
def a08(v):
    log = v.activity.select("user_id", "event_time", "event_id", "platform")
    return tables.latest_state(log, ["user_id"], ["event_time", "event_id"])


@query(
    "a09_packed_payload",
    """select event_id, '{"event_id":' || event_id::varchar || ',"platform":"' || platform || '"}' as packed, platform as again,
         cast(json_extract_string(props, '$.k') as integer) as k from activity""",
)
def a09(v):
    packed = v.activity.select("event_id", "props", tables.pack_json("event_id", "platform").alias("packed"))
    return packed.select(
        "event_id",
        "packed",
        tables.unpack_json("packed", "event_id bigint, platform string")["platform"].alias("again"),
        tables.unpack_json("props", "k int")["k"].alias("k"),
    )


@query(
    "a10_result_profile",
    """select ['event_date', 'n'] as columns, count(distinct event_date) as row_count from message""",
)
def a10(v):
    return tables.result_profile(v.message.groupBy("event_date").agg(F.count(F.lit(1)).alias("n")))


SUITE = [
    ("all", "select * from {orders}"),
    ("by_day", "select o_orderdate, count(*) as n from {orders} group by 1"),
    ("broken", "select nothing_here from {orders}"),
    ("syntax", "selec 1"),
    ("joined", "select c_name, o_orderkey from {orders} join {customer} on o_custkey = c_custkey"),
]


@query(
    "a11_run_sql_suite",
    """select 'all' as query_id, 'SUCCEEDED' as status, count(*) as row_count, 6 as width from orders
       union all select 'by_day', 'SUCCEEDED', count(distinct o_orderdate), 2 from orders
       union all select 'broken', 'FAILED', null, null union all select 'syntax', 'FAILED', null, null
       union all select 'joined', 'SUCCEEDED', count(*), 2 from orders join customer on o_custkey = c_custkey""",
)
def a11(v):
    report = suite.run_sql_suite(v.spark, SUITE, orders=v.orders, customer=v.customer)
    return report.select("query_id", "status", "row_count", F.when(F.size("columns") > 0, F.size("columns")).alias("width"))


@query(
    "a12_progress_report",
    """with c as (select run_id, iteration_number as i, failure_category as k, count(*) as n from bench_result where not passed group by 1, 2, 3),
       j as (select run_id, i, '{' || string_agg('"' || k || '":' || n::varchar, ',' order by k) || '}' as js from c group by 1, 2),
       s as (select run_id, iteration_number as i, count(*) as t, count(*) filter (passed) as p from bench_result group by 1, 2)
       select s.i as iteration, p::double / t as score, t as total_benchmarks, p as passed, t - p as failed, js as failures_by_category_json
       from s left join j on s.run_id = j.run_id and s.i = j.i""",
)
def a12(v):
    report = tables.progress_report(tracking.summarize_iteration(v.bench_result, v.change_row))
    return report.select("iteration", "score", "total_benchmarks", "passed", "failed", "failures_by_category_json")


@query(
    "a12_final_report",
    """select count(*) as runs, count(*) filter (l >= 300000) as successes from
       (select o_custkey, max_by(o_totalprice, (o_orderdate, o_orderkey)) as l from orders group by 1) x""",
)
def a12_final(v):
    runs = v.orders.groupBy(F.col("o_custkey").cast("string").alias("run_id")).agg(
        F.max("o_orderdate").alias("completed_at"),
        F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))["o_totalprice"].alias("final_score"),
    ).withColumns({
        "target_score": F.lit(300000.0), "status": F.lit("COMPLETED"), "initial_score": F.lit(0.0),
        "iterations_completed": F.lit(1), "duration_seconds": F.lit(1.0),
    })
    report = tables.final_report(runs)
    return report.agg(F.count(F.lit(1)).alias("runs"), F.count_if("success").alias("successes"))


@query(
    "a13_model_benchmarks",
    """select cast(query_id as varchar) as model_id, md5(query_id::varchar) as id, question, sql as expected_sql from sql_text""",
)
def a13(v):
    answer = F.array(
        F.struct(F.lit("TEXT").alias("format"), F.array(F.lit("see below")).alias("content")),
        F.struct(F.lit("SQL").alias("format"), F.split("sql", "(?<= )").alias("content")),
    )
    questions = F.array(
        F.struct(
            F.md5(F.col("query_id").cast("string")).alias("id"),
            F.split("question", " ").alias("question"),
            answer.alias("answer"),
        )
    )
    models = v.sql_text.select(F.col("query_id").cast("string").alias("model_id"), questions.alias("questions"))
    return benchmarks.model_benchmarks(models)
