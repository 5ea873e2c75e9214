"""Run tracking reports over the stand-in result and change tables."""

from pyspark.sql import functions as F

from tidemark.plans import tracking
from tidemark.registry import query

NOW = "2024-02-01 00:00:00"

_ITERATIONS = """it as (select run_id, iteration_number, count(*) as total_benchmarks, count(*) filter (passed) as passed,
    count(*) filter (not passed) as failed, count(*) filter (passed)::double / count(*) as score from bench_result group by 1, 2),
  nc as (select run_id, iteration_number, count(*) as n from change_row group by 1, 2),
  its as (select it.*, coalesce(nc.n, 0) as num_changes, coalesce(it.score - (select b.score from it b where b.run_id = it.run_id
      and b.iteration_number = it.iteration_number - 1), 0.0::double) as score_delta
    from it left join nc on nc.run_id = it.run_id and nc.iteration_number = it.iteration_number)"""


def iterations(v):
    return tracking.summarize_iteration(v.bench_result, v.change_row)


# runs start one hour apart by the number of their source; every third is still open
_RUNS = """rn as (select distinct source, 'run_' || source as run_id, cast(substring(source, 4) as bigint) as i from documents),
  rs as (select run_id, timestamp '2024-01-20 00:00:00' + i * interval 11 hour as started_at, i,
     case when i % 3 > 0 then timestamp '2024-01-20 00:00:00' + i * interval 11 hour + (i + 5) * interval 7 minute end as completed_at,
     case when i % 3 > 0 then 'COMPLETED' else 'RUNNING' end as status from rn)"""


def run_starts(v):
    i = F.substring("source", 4, 10).cast("bigint")
    start = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    hours = F.make_dt_interval(F.lit(0), (i * 11).cast("int"))
    return v.documents.select("source").distinct().select(
        F.concat(F.lit("run_"), "source").alias("run_id"),
        i.alias("i"),
        (start + hours).alias("started_at"),
        F.lit(0.5).alias("initial_score"),
        F.lit(0.9).alias("target_score"),
        F.lit(5).alias("max_iterations"),
    )


def run_ends(v):
    """Two completion events per finished run; the later one counts."""
    done = run_starts(v).filter(F.col("i") % 3 > 0)

    def at(minutes):
        return F.col("started_at") + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))

    final = (F.col("i") % 10).cast("double") / 10
    early = done.select("run_id", at(F.col("i")).alias("completed_at"), F.lit(0.1).alias("final_score"), F.lit("STOPPED").alias("status"))
    late = done.select("run_id", at((F.col("i") + 5) * 7).alias("completed_at"), final.alias("final_score"), F.lit("COMPLETED").alias("status"))
    return early.unionByName(late)


def runs(v):
    return tracking.complete_runs(run_starts(v), run_ends(v))


@query(
    "m01_summarize_iteration",
    f"""with {_ITERATIONS}, fc as (select run_id, iteration_number, failure_category as k, cast(count(*) as integer) as n from bench_result where not passed group by 1, 2, 3),
        fm as (select run_id, iteration_number, map_from_entries(list(struct_pack(k := k, v := n) order by k)) as m, (list(k order by n desc, k))[1] as top from fc group by 1, 2),
        cc as (select run_id, iteration_number, change_type as k, cast(count(*) as integer) as n from change_row group by 1, 2, 3),
        cm as (select run_id, iteration_number, map_from_entries(list(struct_pack(k := k, v := n) order by k)) as m from cc group by 1, 2)
        select its.*, cm.m as changes_by_type, fm.m as failures_by_category, fm.top as top_failure_category from its
        left join fm on fm.run_id = its.run_id and fm.iteration_number = its.iteration_number
        left join cm on cm.run_id = its.run_id and cm.iteration_number = its.iteration_number""",
)
def m01(v):
    return iterations(v)


def fix_fields(v):
    """Change documents of four types as string maps, one per part."""
    i = F.col("p_partkey") % 4
    source = F.concat(F.lit('{"benchmark_id":"b'), (F.col("p_partkey") % 9).cast("string"), F.lit('","question":"q"}'))
    kind = F.when(i == 0, "add_synonym").when(i == 1, "add_column_description").when(i == 2, "add_join").otherwise("other")
    fields = F.create_map(
        F.lit("type"), kind,
        F.lit("table"), F.when(i != 2, F.col("p_brand")),
        F.lit("left_table"), F.when(i == 2, F.col("p_type")),
        F.lit("column"), F.when(i < 2, F.lit("p_name")),
        F.lit("synonym"), F.when(i == 0, F.col("p_name")),
        F.lit("description"), F.when(i == 1, F.concat(F.lit('["about '), "p_name", F.lit('","more"]'))),
        F.lit("sql"), F.when(i == 2, F.lit("a = b")),
        F.lit("source_failure"), source,
    )
    return v.part.select(
        F.lit("run_x").alias("run_id"), (F.col("p_partkey") % 5 + 1).cast("int").alias("iteration_number"),
        "p_partkey", fields.alias("fields"),
    )


@query(
    "m02_explode_changes",
    """with b as (select *, p_partkey % 4 as i from part)
       select 'run_x' as run_id, cast(p_partkey % 5 + 1 as integer) as iteration_number,
         case i when 0 then 'add_synonym' when 1 then 'add_column_description' when 2 then 'add_join' else 'other' end as change_type,
         case i when 2 then p_type else p_brand end as target_table, case when i < 2 then 'p_name' end as target_column,
         case i when 0 then p_name when 1 then 'about ' || p_name when 2 then 'a = b' else '' end as change_value,
         case i when 0 then map {'synonym': p_name} when 1 then map {'description': '["about ' || p_name || '","more"]'}
            when 2 then map {'left_table': p_type, 'sql': 'a = b'} else cast(map {} as map(varchar, varchar)) end as change_details,
         'b' || (p_partkey % 9)::varchar as source_failure_benchmark_id, 'q' as source_failure_question,
         true as applied_successfully, 'valid' as validation_status from b""",
)
def m02(v):
    return tracking.explode_changes(fix_fields(v)).drop("change_id")


@query(
    "m03_flatten_results",
    """select run_id, iteration_number, cast(benchmark_id as varchar) as benchmark_id, question, passed, case when passed then 'COMPLETED' else 'FAILED' end as answer_status,
         failure_category, case when passed then 'high' else 'low' end as comparison_confidence, question as semantic_equivalence,
         case when result_id % 2 = 0 then response_time_seconds else 0.0::double end as response_time_seconds from bench_result""",
)
def m03(v):
    details = F.struct(F.when(F.col("passed"), "high").otherwise("low").alias("confidence"), F.col("question").alias("semantic_equivalence"))
    nested = v.bench_result.withColumn("comparison_details", details).withColumn(
        "response_time", F.when(F.col("result_id") % 2 == 0, F.col("response_time_seconds"))
    )
    return tracking.flatten_results(nested)


@query("m04_score_delta", f"with {_ITERATIONS} select run_id, iteration_number, score, score_delta from its")
def m04(v):
    scored = iterations(v).select("run_id", "iteration_number", "score")
    return tracking.score_delta(scored)


@query(
    "m05_complete_runs",
    f"""with {_RUNS} select run_id, started_at, completed_at, status, case when i % 3 > 0 then (i % 10)::double / 10 end as final_score,
          case when i % 3 > 0 then ((i + 5) * 7 * 60)::double end as duration_seconds, case when i % 3 > 0 then (i % 10)::double / 10 - 0.5::double end as score_improvement from rs""",
)
def m05(v):
    return runs(v).select(
        "run_id", "started_at", "completed_at", "status", "final_score", "duration_seconds", "score_improvement"
    )


@query(
    "m06_current_progress",
    f"""with {_RUNS}, {_ITERATIONS}, l as (select its.* from its where iteration_number = (select max(iteration_number) from its o where o.run_id = its.run_id))
        select rs.run_id, status, started_at, 0.5::double as initial_score, l.score as current_score, 0.9::double as target_score, l.iteration_number as current_iteration,
          5 as max_iterations, l.score - 0.5::double as score_improvement, case when l.score >= 0.9 then 'Target Reached ✅' when l.iteration_number >= 5 then 'Max Iterations'
            when status = 'RUNNING' then 'In Progress...' else status end as progress_status, l.num_changes as changes_this_iteration,
          date_sub('minute', started_at, coalesce(completed_at, timestamp '{NOW}')) as duration_minutes
        from rs left join l on l.run_id = rs.run_id""",
)
def m06(v):
    return tracking.current_progress(runs(v), iterations(v), NOW)


@query(
    "m07_change_distribution",
    """select run_id, change_type, count(*) as num_changes, count(distinct target_table) as tables_affected,
         avg(case when applied_successfully then 1.0::double else 0 end) as success_rate from change_row group by 1, 2""",
)
def m07(v):
    return tracking.change_distribution(v.change_row)


@query(
    "m08_failure_patterns",
    """select run_id, iteration_number, failure_category, question, count(*) as occurrences,
         cast(sum(count(*)) over (partition by run_id, iteration_number, failure_category) as bigint) as occurrence_count
       from bench_result where not passed group by 1, 2, 3, 4""",
)
def m08(v):
    return tracking.failure_patterns(v.bench_result)


@query(
    "m09_rollback_points",
    f"""with {_ITERATIONS} select run_id, iteration_number, score, num_changes, 'snap/' || run_id as config_snapshot_path,
          'Iteration ' || iteration_number::varchar || ': Score ' || round(score * 100, 1)::varchar || '%' as rollback_label from its where num_changes > 2""",
)
def m09(v):
    kept = iterations(v).withColumns({
        "can_rollback": F.col("num_changes") > 2,
        "status": F.lit("COMPLETED"),
        "config_snapshot_path": F.concat(F.lit("snap/"), "run_id"),
    })
    return tracking.rollback_points(kept)


@query(
    "m10_changes_in_iteration",
    "select change_id, change_type, target_table from change_row where run_id = 'run_src7' and iteration_number = 3",
)
def m10(v):
    return tracking.changes_in(v.change_row, "run_src7", 3).select("change_id", "change_type", "target_table")


@query(
    "m11_recurring_failures",
    """select benchmark_id, question, failure_category, count(*) as fail_count from bench_result where not passed group by 1, 2, 3 having count(*) >= 3""",
)
def m11(v):
    return tracking.recurring_failures(v.bench_result)


@query("m12_score_trend", f"with {_ITERATIONS} select iteration_number, score, score_delta, num_changes from its where run_id = 'run_src7'")
def m12(v):
    return tracking.score_trend(iterations(v), "run_src7")


@query("m12_average_trend", f"with {_ITERATIONS} select iteration_number, round(avg(score), 10) as avg_score from its group by 1")
def m12_average(v):
    return tracking.average_trend(iterations(v)).withColumn("avg_score", F.round("avg_score", 10))


@query(
    "m13_most_changed_tables",
    """select target_table, count(*) as change_count, count(distinct change_type) as change_types from change_row group by 1""",
)
def m13(v):
    return tracking.most_changed_tables(v.change_row)


@query("m14_effective_changes", "select change_type, count(*) as change_count from change_row where applied_successfully group by 1")
def m14(v):
    return tracking.effective_changes(v.change_row)


@query("m15_recent_runs", f"with {_RUNS} select run_id, started_at, status from rs where started_at >= timestamp '2024-01-23 00:00:00'")
def m15(v):
    return tracking.recent_runs(runs(v), "2024-01-30").select("run_id", "started_at", "status")


@query(
    "m16_daily_scores",
    f"""with {_RUNS} select cast(started_at as date) as date, round(avg((i % 10)::double / 10), 10) as avg_score, count(*) as num_runs from rs where status = 'COMPLETED' group by 1""",
)
def m16(v):
    scored = runs(v).withColumn("score", F.col("final_score"))
    return tracking.daily_scores(scored, "COMPLETED").withColumn("avg_score", F.round("avg_score", 10))


def applied_fixes(v):
    return v.change_row.select(
        "run_id", F.col("change_type").alias("category"), F.col("applied_successfully").alias("applied"),
        (F.col("change_id") % 8).cast("double").alias("score_improvement"),
    )


@query(
    "m17_fix_effectiveness",
    """select change_type as category, count(*) as fixes_applied, avg((change_id % 8)::double) as avg_improvement from change_row group by 1""",
)
def m17(v):
    return tracking.fix_effectiveness(applied_fixes(v))


@query(
    "m18_implementation_summary",
    """select run_id, count(*) as total, count(*) filter (applied_successfully) as applied, count(*) filter (not applied_successfully) as rejected,
         max((change_id % 8)::double) as final_score from change_row group by 1""",
)
def m18(v):
    return tracking.implementation_summary(applied_fixes(v).withColumnRenamed("score_improvement", "score_after"))


STAGES = "case user_id % 4 when 0 then 'score' when 1 then 'plan' when 2 then 'apply' else 'validate' end"


def stage_log(v):
    """Stage attempts from the event stream: view starts, purchase completes, error fails."""
    i = F.col("user_id") % 4
    stage = F.when(i == 0, "score").when(i == 1, "plan").when(i == 2, "apply").otherwise("validate")
    return v.activity.withColumns({"run_id": F.floor(F.col("user_id") / 4).cast("bigint"), "stage_name": stage})


@query(
    "m19_stage_output",
    f"""with s as (select user_id // 4 as run_id, {STAGES} as stage_name, event_time as completed_at, props as output_json,
              row_number() over (partition by user_id order by event_time desc, props desc) as rn from activity where platform = 'purchase')
        select run_id, stage_name, completed_at, output_json, cast(json_extract_string(output_json, '$.k') as integer) as k from s where rn = 1""",
)
def m19(v):
    log = stage_log(v).select(
        "run_id", "stage_name", F.col("event_time").alias("completed_at"), F.col("props").alias("output_json"),
        F.when(F.col("platform") == "purchase", "COMPLETED").otherwise("FAILED").alias("status"),
    )
    latest = tracking.stage_output(log, "k int")
    return latest.select("run_id", "stage_name", "completed_at", "output_json", F.col("output.k").alias("k"))


@query(
    "m20_plan_by_category",
    "select run_id, change_type as fix_category, target_table as fix_details, count(*) as occurrences from change_row group by 1, 2, 3",
)
def m20(v):
    plan = v.change_row.select("run_id", F.col("change_type").alias("fix_category"), F.col("target_table").alias("fix_details"))
    return tracking.plan_by_category(plan)


@query(
    "m21_stage_timing",
    f"""with s as (select user_id // 4 as run_id, {STAGES} as stage_name, min(event_time) as started_at from activity where platform = 'view' group by 1, 2),
        e as (select user_id // 4 as run_id, {STAGES} as stage_name, max(event_time) as completed_at from activity where platform = 'purchase' group by 1, 2),
        x as (select user_id // 4 as run_id, {STAGES} as stage_name, count(*) as n from activity where platform = 'error' group by 1, 2)
        select s.run_id, s.stage_name, started_at, completed_at, date_sub('second', started_at, completed_at)::double as duration_seconds,
          case when completed_at is null then 'RUNNING' when x.n >= 14 then 'FAILED' else 'COMPLETED' end as status
        from s left join e on e.run_id = s.run_id and e.stage_name = s.stage_name left join x on x.run_id = s.run_id and x.stage_name = s.stage_name""",
)
def m21(v):
    log = stage_log(v)
    keys = ["run_id", "stage_name"]

    def of(kind):
        return log.filter(F.col("platform") == kind).groupBy(*keys)

    starts = of("view").agg(F.min("event_time").alias("started_at"))
    errors = of("error").agg(F.when(F.count(F.lit(1)) >= 14, "too many errors").alias("error_message"))
    ends = of("purchase").agg(F.max("event_time").alias("completed_at")).join(errors, keys, "left")
    return tracking.stage_timing(starts, ends).drop("error_message")


@query(
    "m22_fixes_to_rows",
    """select p_partkey as run_id, c as fix_category, 'add_' || c as fix_type, '{"type":"add_' || c || '","source_failure":{"benchmark_id":"b1","question":"' || p_name || '"}}' as fix_details,
         'b1' as source_benchmark_id, p_name as source_question from part, (select unnest(['metadata', 'joins']) as c) k
       union all select p_partkey, 'joins', '', '{"x":1}', '', '' from part""",
)
def m22(v):
    def text(kind):
        return F.concat(
            F.lit('{"type":"add_' + kind + '","source_failure":{"benchmark_id":"b1","question":"'), "p_name", F.lit('"}}')
        )

    fixes = F.create_map(
        F.lit("metadata"), F.array(text("metadata")), F.lit("joins"), F.array(text("joins"), F.lit('{"x":1}'))
    )
    plans = v.part.select(F.col("p_partkey").alias("run_id"), F.lit(NOW).alias("created_at"), fixes.alias("fixes"))
    return tracking.fixes_to_rows(plans).drop("created_at")


@query(
    "m23_lessons_rollup",
    """select failure_category as pattern, cast(sum(coalesce(case when result_id % 2 = 0 then benchmark_id end, 1)) as bigint) as times_encountered,
         avg(case when result_id % 3 = 0 then 1.0::double else 0 end) as success_rate, max(result_id) as last_seen
       from bench_result where not passed and result_id % 5 <> 0 group by 1""",
)
def m23(v):
    i = F.col("result_id")
    lessons = v.bench_result.filter(~F.col("passed")).select(
        F.col("failure_category").alias("pattern"),
        F.when(i % 2 == 0, F.col("benchmark_id")).alias("times_encountered"),
        F.when(i % 3 == 0, True).alias("worked"),
        F.when(i % 5 == 0, "superseded").when(i % 5 == 1, "active").alias("status"),
        i.alias("updated_at"),
    )
    return tracking.lessons_rollup(lessons)
