"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import prepare

#: a word as the mixing contract counts it
WORD = r"[^\x20\x09-\x0D]+"

_SETTINGS = {
    # whole texts travel in these batches: few rows keep a worker's memory small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def tuned(spark: SparkSession) -> SparkSession:
    """The library's runtime settings and small Arrow batches."""
    prepare(spark)
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{folder}/{name}.parquet")


def rows_held(df: DataFrame) -> DataFrame:
    """Each row as one struct ``row``, so that no input name meets a working name."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"))


def word_count(text: Column) -> Column:
    """Words of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def salted_hash(*cols: Column) -> Column:
    return F.xxhash64(*cols)


def unit_hash(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) from the columns' text and a seed, the same in every run."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function that is built once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            step = step or make()
            out = step(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)
