"""Append-only tables: reading, appending, current state and packed payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.windows import latest_record
from tidemark.sources.schemas import TABLES, conform


def read_table(spark: SparkSession, name: str, table: str | None = None) -> DataFrame:
    """A lazy scan of a catalog table, or of a parquet folder when given a path.

    ``table`` names a declared schema, which keeps partition values in their types.
    """
    if "/" not in name:
        return spark.table(name)
    reader = spark.read.schema(TABLES[table].schema) if table else spark.read
    return reader.parquet(name)


def append_rows(df: DataFrame, target: str, table: str | None = None, partitions: tuple[str, ...] = ()) -> None:
    """Append rows to a table or folder in one write.

    With ``table`` the rows take that declared shape and partitioning. The
    rebalance hint groups rows by their partition values, splitting large values
    over several tasks, so writes make few files and no hot task.
    """
    if table:
        df, partitions = conform(df, table), TABLES[table].partitions
    if partitions:
        df = df.hint("rebalance", *[F.col(p) for p in partitions])
    writer = df.write.mode("append").format("parquet")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.save(target) if "/" in target else writer.saveAsTable(target)


def latest_state(event_log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Current row per key of an append-only log; stands for keyed updates."""
    return latest_record(event_log, keys, order)


def pack_json(*columns: str | Column) -> Column:
    return F.to_json(F.struct(*columns))


def unpack_json(c: str, schema: str) -> Column:
    """Typed payload of a text column; NULL fields where the text is broken."""
    return F.from_json(F.col(c), schema)


def result_profile(df: DataFrame) -> DataFrame:
    """Result envelope: column names and row count, without moving the rows."""
    names = F.array(*[F.lit(c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(names.alias("columns"), "row_count")


def progress_report(iterations: DataFrame) -> DataFrame:
    """Tracked iterations as flat rows with JSON text columns."""
    flat = iterations.withColumns(
        {
            "iteration": F.col("iteration_number"),
            "changes_json": F.to_json("changes_by_type"),
            "failures_by_category_json": F.to_json("failures_by_category"),
        }
    )
    return conform(flat, "progress")


def final_report(runs: DataFrame) -> DataFrame:
    """One summary row per finished run."""
    done = runs.filter(F.col("completed_at").isNotNull()).withColumns(
        {
            "timestamp": F.col("completed_at"),
            "success": F.col("final_score") >= F.col("target_score"),
            "final_status": F.col("status"),
            "score_improvement": F.col("final_score") - F.col("initial_score"),
            "iterations": F.col("iterations_completed"),
            "total_duration_seconds": F.col("duration_seconds"),
        }
    )
    return conform(done, "final")
