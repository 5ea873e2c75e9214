"""Declared schemas and partition columns of the tracking and job-state tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Table:
    columns: str
    partitions: tuple[str, ...] = ()
    comment: str = ""

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.columns)


BENCHMARK = (
    "id string, question string, korean_question string, expected_sql string, category string, "
    "difficulty string, source_file string, question_number int"
)

TABLES: dict[str, Table] = {
    "enhancement_runs": Table(
        "run_id string, space_id string, space_name string, started_at timestamp_ntz, completed_at timestamp_ntz, "
        "status string, target_score double, max_iterations int, llm_endpoint string, benchmark_source string, "
        "initial_score double, final_score double, score_improvement double, iterations_completed int, "
        "total_changes_applied bigint, duration_seconds double, error_message string, triggered_by string, "
        "created_at timestamp_ntz, updated_at timestamp_ntz, started_date date",
        ("started_date",),
        "one row per run",
    ),
    "enhancement_iterations": Table(
        "run_id string, iteration_number int, started_at timestamp_ntz, completed_at timestamp_ntz, "
        "duration_seconds double, score double, score_delta double, total_benchmarks bigint, passed bigint, "
        "failed bigint, num_changes bigint, changes_by_type map<string,int>, failures_by_category map<string,int>, "
        "top_failure_category string, llm_calls int, llm_tokens_used int, llm_cost_estimate double, "
        "config_snapshot_path string, can_rollback boolean, status string, error_message string, "
        "created_at timestamp_ntz",
        ("run_id",),
        "one row per iteration of a run",
    ),
    "enhancement_changes": Table(
        "run_id string, iteration_number int, change_id string, change_type string, target_table string, "
        "target_column string, change_value string, change_details map<string,string>, "
        "source_failure_benchmark_id string, source_failure_question string, applied_successfully boolean, "
        "validation_status string, error_message string, created_at timestamp_ntz",
        ("run_id", "change_type"),
        "one row per change",
    ),
    "enhancement_benchmarks": Table(
        "run_id string, iteration_number int, benchmark_id string, question string, expected_sql string, "
        "passed boolean, generated_sql string, answer_status string, failure_category string, failure_reason string, "
        "comparison_confidence string, semantic_equivalence string, response_time_seconds double, "
        "created_at timestamp_ntz",
        ("run_id", "passed"),
        "one row per benchmark and iteration",
    ),
    "enhancement_lessons_learned": Table(
        "lesson_id string, run_id string, iteration_number int, pattern string, description string, fix_type string, "
        "example_question string, before_sql string, after_sql string, times_encountered int, success_rate double, "
        "status string, superseded_by string, created_at timestamp_ntz, updated_at timestamp_ntz, created_by string",
        (),
        "what earlier runs taught",
    ),
    "job_runs": Table(
        "run_id string, space_id string, status string, current_stage string, config string, "
        "created_at timestamp_ntz, updated_at timestamp_ntz, completed_at timestamp_ntz"
    ),
    "job_stage_results": Table(
        "run_id string, stage_name string, stage_number int, status string, input_json string, output_json string, "
        "error_message string, started_at timestamp_ntz, completed_at timestamp_ntz, duration_seconds double"
    ),
    "job_benchmark_results": Table(
        "run_id string, stage string, benchmark_id string, question string, expected_sql string, "
        "generated_sql string, passed boolean, failure_category string, failure_reason string, "
        "response_time double, scored_at timestamp_ntz"
    ),
    "job_enhancement_plans": Table(
        "run_id string, fix_category string, fix_type string, fix_details string, source_benchmark_id string, "
        "source_question string, created_at timestamp_ntz"
    ),
    "job_implementation_results": Table(
        "run_id string, fix_category string, fix_type string, fix_details string, applied boolean, "
        "rejection_reason string, score_before double, score_after double, applied_at timestamp_ntz"
    ),
    "progress": Table(
        "iteration int, timestamp timestamp_ntz, space_id string, score double, score_delta double, "
        "total_benchmarks bigint, passed bigint, failed bigint, num_changes bigint, changes_json string, "
        "failures_by_category_json string, duration_seconds double, config_json string"
    ),
    "final": Table(
        "timestamp timestamp_ntz, space_id string, success boolean, final_status string, initial_score double, "
        "final_score double, score_improvement double, iterations int, total_duration_seconds double"
    ),
}

# Defaults set at write; plain parquet tables keep none.
DEFAULTS = {
    "enhancement_lessons_learned": {"times_encountered": 1, "status": "active"},
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Rows in a table's declared shape: columns cast, missing ones NULL or default."""
    defaults = DEFAULTS.get(table, {})
    columns = []
    for field in TABLES[table].schema.fields:
        c = F.col(field.name) if field.name in df.columns else F.lit(None)
        if field.name in defaults:
            c = F.coalesce(c.cast(field.dataType), F.lit(defaults[field.name]))
        columns.append(c.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def ensure_tables(spark: SparkSession, database: str, names: list[str] | None = None) -> list[str]:
    """Create the declared tables that do not exist yet."""
    made = []
    for name in names or list(TABLES):
        table, full = TABLES[name], f"{database}.{name}"
        if spark.catalog.tableExists(full):
            continue
        writer = spark.createDataFrame([], table.schema).write.format("parquet").mode("append")
        if table.partitions:
            writer = writer.partitionBy(*table.partitions)
        writer.saveAsTable(full)
        made.append(full)
    return made
