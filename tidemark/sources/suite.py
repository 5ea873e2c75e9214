"""Run a set of query texts as concurrent Spark jobs and report on each."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT = "query_id string, status string, row_count bigint, columns array<string>, error string, seconds double"


def _cells(df: DataFrame, query_id: str) -> DataFrame:
    shown = [F.col(f"`{c}`").cast("string") for c in df.columns]
    return df.select(F.lit(query_id).alias("pair_id"), F.array(*shown).alias("cells"))


def run_sql_suite(
    spark: SparkSession, suite: list[tuple[str, str]], into: str | None = None, concurrent: int = 10, **relations
) -> DataFrame:
    """Status, row count, columns and error of each text; errors become rows.

    Each text is one distributed job; only counts come back. The jobs name a
    scheduler pool each, which shares the cluster between them only where the
    session runs with ``spark.scheduler.mode=FAIR``. With ``into`` the result rows are written below that folder in the
    (pair_id, cells) shape that result comparison reads, one folder per text.
    """

    def run(item: tuple[str, str]) -> tuple:
        query_id, text = item
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"suite-{query_id}")
        start = time.monotonic()
        try:
            df = spark.sql(text, **relations)
            if into:
                target = f"{into}/query={query_id}"
                _cells(df, query_id).write.mode("overwrite").parquet(target)
                n = spark.read.parquet(target).count()
            else:
                n = df.count()
            return (query_id, "SUCCEEDED", n, df.columns, None, time.monotonic() - start)
        except PySparkException as e:
            condition = e.getCondition() or type(e).__name__
            return (query_id, "FAILED", None, None, f"{condition}: {e}", time.monotonic() - start)

    with ThreadPoolExecutor(max_workers=concurrent) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(run), suite))
    return spark.createDataFrame(rows, REPORT)
