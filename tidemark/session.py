"""Session settings every query relies on.

Only runtime SQL settings are touched, so a session handed in by a caller keeps
its cluster, memory and shuffle sizing.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    # results compare equal across engines only with one fixed time zone
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # one key may hold a third of all rows: split such join partitions even
    # where that costs one more shuffle for the operator above
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = 8, app: str = "tidemark", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
    )
    for key, value in {**RUNTIME_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Read from ``spark.checkpoint.dir``. Only a local session may lack it; it then
    gets a temporary folder of its own.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-", dir=os.environ.get("TMPDIR", "/tmp"))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, folders: list[str] | None = None) -> DataFrame:
    """Write once below the shared folder and read back.

    For a frame with several readers: it is computed once, survives lost
    executors, and each reader still prunes columns. ``folders`` names columns of
    few values; a reader that filters on them opens their folders alone.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").partitionBy(*(folders or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# rows to a task where each row takes a fraction of a millisecond and more, and the fewest worth a task of their own
SPREAD_ROWS, SPREAD_LEAST = 25_000, 500


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the cluster, for narrow rows ahead of costly work on each.

    A file is read by a task per row group at most, so a table of millions of
    narrow rows may come in one task, and all row-local work would stay in it.
    """
    rows = df.count()
    tasks = max(min(3 * df.sparkSession.sparkContext.defaultParallelism, rows // SPREAD_LEAST), -(-rows // SPREAD_ROWS))
    return df.repartition(tasks) if tasks > 1 else df
