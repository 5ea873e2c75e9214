"""Unions of differently shaped sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(*parts: DataFrame, pad: bool = False) -> DataFrame:
    """Union by column name; ``pad`` fills missing columns with NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=pad), parts)


def union_tagged(parts: dict[str, DataFrame], tag: str = "platform", pad: bool = False) -> DataFrame:
    """Union of sources, each row tagged with the name of its source."""
    return union_all(*[df.withColumn(tag, F.lit(name)) for name, df in parts.items()], pad=pad)


def union_distinct(*parts: DataFrame) -> DataFrame:
    return union_all(*parts).distinct()
