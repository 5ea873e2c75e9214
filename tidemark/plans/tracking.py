"""Run tracking: iteration facts, change facts and dashboard reports.

Tables are append-only. What a keyed update would change is appended as a new
event, and reports read the latest event per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import days_before, elapsed
from tidemark.functions.labels import progress_label
from tidemark.functions.numbers import success_rate
from tidemark.functions.text import details_map, joined_text, stable_id
from tidemark.operators import joins
from tidemark.operators.aggregates import count_map, recurring, score_rollup, top_category, value_counts
from tidemark.operators.ranking import latest_n
from tidemark.operators.windows import latest_record

RUN = ["run_id", "iteration_number"]


def _rows() -> Column:
    return F.count(F.lit(1))


def summarize_iteration(results: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per iteration: score, counts, maps of changes and failures, delta."""
    failed = results.filter(~F.col("passed")).withColumn(
        "failure_category", F.coalesce("failure_category", F.lit("unknown"))
    )
    scored = score_rollup(results, RUN).withColumnRenamed("total", "total_benchmarks")
    numbers = changes.groupBy(*RUN).agg(_rows().alias("num_changes"))
    full = scored
    for part in (
        numbers,
        count_map(changes, RUN, "change_type", "changes_by_type"),
        count_map(failed, RUN, "failure_category", "failures_by_category"),
        top_category(failed, RUN, "failure_category", "top_failure_category"),
    ):
        full = full.join(part, RUN, "left")
    return score_delta(full.withColumn("num_changes", F.coalesce("num_changes", F.lit(0))))


def score_delta(iterations: DataFrame) -> DataFrame:
    """Change against the iteration numbered one lower, 0 where there is none.

    A self equi-join on (run, number - 1): a gap in the numbers counts as none.
    """
    before = iterations.select(
        "run_id", (F.col("iteration_number") + 1).cast("int").alias("iteration_number"), F.col("score").alias("__b")
    )
    joined = iterations.join(before, RUN, "left")
    return joined.withColumn("score_delta", F.coalesce(F.col("score") - F.col("__b"), F.lit(0.0))).drop("__b")


# Which field of a change holds its main value.
MAIN_FIELD = {
    "add_synonym": "synonym",
    "add_column_description": "description",
    "update_table_description": "description",
    "add_join": "sql",
    "fix_join": "sql",
    "add_example_query": "question",
}
CAPTURED = ["type", "table", "column", "source_failure"]


def change_value(change_type: str, fields: str) -> Column:
    """Main value of a change; an array of lines gives its first line."""
    chosen = F
    for name, field in MAIN_FIELD.items():
        chosen = chosen.when(F.col(change_type) == name, F.col(fields)[field])
    raw = F.coalesce(chosen.otherwise(F.col(fields)["value"]), F.lit(""))
    first = F.get(F.from_json(raw, "array<string>"), F.lit(0))
    return F.when(raw.startswith("["), F.coalesce(first, raw)).otherwise(raw)


def explode_changes(changes: DataFrame) -> DataFrame:
    """Change rows with target, main value and the remaining fields as a map.

    ``changes`` has run_id, iteration_number and fields map<string,string>.
    """
    fields = F.col("fields")
    typed = changes.withColumn("change_type", F.coalesce(fields["type"], F.lit("unknown")))
    source = "$.benchmark_id", "$.question"
    return typed.select(
        "run_id",
        "iteration_number",
        stable_id("run_id", "iteration_number", F.to_json("fields")).alias("change_id"),
        "change_type",
        F.coalesce(fields["table"], fields["left_table"]).alias("target_table"),
        fields["column"].alias("target_column"),
        change_value("change_type", "fields").alias("change_value"),
        details_map(fields, CAPTURED).alias("change_details"),
        F.get_json_object(fields["source_failure"], source[0]).alias("source_failure_benchmark_id"),
        F.get_json_object(fields["source_failure"], source[1]).alias("source_failure_question"),
        F.lit(True).alias("applied_successfully"),
        F.lit("valid").alias("validation_status"),
    )


def flatten_results(results: DataFrame) -> DataFrame:
    """Result rows with the nested comparison details as columns."""
    return results.select(
        "run_id",
        "iteration_number",
        F.coalesce(F.col("benchmark_id").cast("string"), F.lit("unknown")).alias("benchmark_id"),
        F.coalesce("question", F.lit("")).alias("question"),
        F.coalesce("passed", F.lit(False)).alias("passed"),
        F.when(F.col("passed"), "COMPLETED").otherwise("FAILED").alias("answer_status"),
        "failure_category",
        F.col("comparison_details.confidence").alias("comparison_confidence"),
        F.col("comparison_details.semantic_equivalence").alias("semantic_equivalence"),
        F.coalesce("response_time", F.lit(0.0)).alias("response_time_seconds"),
    )


def complete_runs(started: DataFrame, finished: DataFrame) -> DataFrame:
    """Runs with their latest completion event; runs without one stay RUNNING."""
    last = latest_record(finished, ["run_id"], ["completed_at"])
    joined = started.join(last, "run_id", "left")
    seconds = elapsed("SECOND", F.col("started_at"), F.col("completed_at")).cast("double")
    return joined.withColumns(
        {
            "status": F.coalesce("status", F.lit("RUNNING")),
            "duration_seconds": seconds,
            "score_improvement": F.col("final_score") - F.col("initial_score"),
        }
    )


def current_progress(runs: DataFrame, iterations: DataFrame, now: str) -> DataFrame:
    """Open and finished runs with their latest iteration."""
    shown = runs.filter(F.col("status").isin("RUNNING", "COMPLETED"))
    latest = joins.with_latest_child(
        shown, iterations, "run_id", ["iteration_number"], ["iteration_number", "score", "num_changes"]
    )
    until = F.coalesce("completed_at", F.lit(now).cast("timestamp_ntz"))
    return latest.select(
        "run_id", "status", "started_at", "initial_score", F.col("score").alias("current_score"), "target_score",
        F.col("iteration_number").alias("current_iteration"), "max_iterations",
        (F.col("score") - F.col("initial_score")).alias("score_improvement"),
        progress_label("score", "target_score", "iteration_number", "max_iterations", "status").alias("progress_status"),
        F.col("num_changes").alias("changes_this_iteration"),
        elapsed("MINUTE", F.col("started_at"), until).alias("duration_minutes"),
    )


def change_distribution(changes: DataFrame) -> DataFrame:
    return changes.groupBy("run_id", "change_type").agg(
        _rows().alias("num_changes"),
        F.countDistinct("target_table").alias("tables_affected"),
        success_rate("applied_successfully").alias("success_rate"),
    )


def failure_patterns(results: DataFrame) -> DataFrame:
    """A row per iteration, category and question with its failures, and those of the whole category.

    Totals are summed from the counted questions, so a hot category is combined
    on the map side and no list of questions is built.
    """
    keys = [*RUN, "failure_category"]
    asked = value_counts(results.filter(~F.col("passed")), [*keys, "question"])
    totals = asked.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.sum("occurrences").alias("occurrence_count"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return asked.join(totals, on[0] & on[1] & on[2]).drop(*[f"__{k}" for k in keys])


def rollback_points(iterations: DataFrame) -> DataFrame:
    percent = F.round(F.col("score") * 100, 1)
    label = joined_text(F.lit("Iteration "), "iteration_number", F.lit(": Score "), percent, F.lit("%"))
    usable = iterations.filter(F.col("can_rollback") & (F.col("status") == "COMPLETED"))
    return usable.select(*RUN, "score", "num_changes", "config_snapshot_path", label.alias("rollback_label"))


def changes_in(changes: DataFrame, run_id: str, iteration: int) -> DataFrame:
    """Changes of one iteration; both filters prune partitions of the change table."""
    return changes.filter((F.col("run_id") == run_id) & (F.col("iteration_number") == iteration))


def recurring_failures(results: DataFrame, at_least: int = 3) -> DataFrame:
    failed = results.filter(~F.col("passed"))
    return recurring(failed, ["benchmark_id", "question", "failure_category"], at_least)


def score_trend(iterations: DataFrame, run_id: str) -> DataFrame:
    chosen = iterations.filter(F.col("run_id") == run_id)
    return chosen.select("iteration_number", "score", "score_delta", "num_changes").orderBy("iteration_number")


def average_trend(iterations: DataFrame) -> DataFrame:
    return iterations.groupBy("iteration_number").agg(F.avg("score").alias("avg_score"))


def most_changed_tables(changes: DataFrame, run_id: str | None = None) -> DataFrame:
    chosen = changes if run_id is None else changes.filter(F.col("run_id") == run_id)
    return chosen.groupBy("target_table").agg(
        _rows().alias("change_count"), F.countDistinct("change_type").alias("change_types")
    )


def effective_changes(changes: DataFrame) -> DataFrame:
    return changes.filter("applied_successfully").groupBy("change_type").agg(_rows().alias("change_count"))


def recent_runs(runs: DataFrame, as_of: str, days: int = 7, n: int | None = None) -> DataFrame:
    recent = runs.filter(F.col("started_at") >= days_before(as_of, days).cast("timestamp_ntz"))
    return recent if n is None else latest_n(recent, "started_at", n, ["run_id"])


def daily_scores(runs: DataFrame, status: str) -> DataFrame:
    """Mean score and run count per day of the runs with a status."""
    chosen = runs.filter(F.col("status") == status)
    return chosen.groupBy(F.to_date("started_at").alias("date")).agg(
        F.avg("score").alias("avg_score"), _rows().alias("num_runs")
    )


def fix_effectiveness(fixes: DataFrame) -> DataFrame:
    return fixes.groupBy("category").agg(
        _rows().alias("fixes_applied"), F.avg("score_improvement").alias("avg_improvement")
    )


def implementation_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_id").agg(
        _rows().alias("total"),
        F.count_if("applied").alias("applied"),
        F.count_if(~F.col("applied")).alias("rejected"),
        F.max("score_after").alias("final_score"),
    )


def stage_output(stages: DataFrame, schema: str | None = None) -> DataFrame:
    """Output of the latest completed attempt of every run and stage."""
    done = stages.filter(F.col("status") == "COMPLETED").select("run_id", "stage_name", "completed_at", "output_json")
    latest = latest_record(done, ["run_id", "stage_name"], ["completed_at"])
    return latest if schema is None else latest.withColumn("output", F.from_json("output_json", schema))


def stage_timing(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Stages with duration and status; an error text makes a stage FAILED."""
    joined = starts.join(ends, ["run_id", "stage_name"], "left")
    status = F.when(F.col("completed_at").isNull(), "RUNNING").when(
        F.coalesce("error_message", F.lit("")) != "", "FAILED"
    ).otherwise("COMPLETED")
    seconds = elapsed("SECOND", F.col("started_at"), F.col("completed_at")).cast("double")
    return joined.withColumns({"status": status, "duration_seconds": seconds})


def plan_by_category(plan: DataFrame) -> DataFrame:
    """A row per run, category and planned fix with how often it is planned."""
    return value_counts(plan, ["run_id", "fix_category", "fix_details"])


def fixes_to_rows(plans: DataFrame) -> DataFrame:
    """One row per fix from grouped plans, for one append instead of one insert per fix.

    ``plans`` has run_id, created_at and fixes map<string, array<string>> of
    JSON texts by category.
    """
    by_category = plans.select("run_id", "created_at", F.explode("fixes").alias("fix_category", "texts"))
    rows = by_category.select("run_id", "created_at", "fix_category", F.explode("texts").alias("fix_details"))

    def field(path: str) -> Column:
        return F.coalesce(F.get_json_object("fix_details", path), F.lit(""))

    return rows.select(
        "run_id",
        "fix_category",
        field("$.type").alias("fix_type"),
        "fix_details",
        field("$.source_failure.benchmark_id").alias("source_benchmark_id"),
        field("$.source_failure.question").alias("source_question"),
        "created_at",
    )


def lessons_rollup(lessons: DataFrame) -> DataFrame:
    """Times seen and success rate per pattern over active lessons."""
    active = lessons.filter(F.coalesce("status", F.lit("active")) == "active")
    return active.groupBy("pattern").agg(
        F.sum(F.coalesce("times_encountered", F.lit(1))).alias("times_encountered"),
        success_rate("worked").alias("success_rate"),
        F.max("updated_at").alias("last_seen"),
    )
