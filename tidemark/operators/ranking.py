"""Top-n and presentation orders; every limit sorts by a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import position_in


def top_n(df: DataFrame, order: list[Column], n: int, ties: list[str]) -> DataFrame:
    """First ``n`` rows by ``order``; ``ties`` are appended so the cut is repeatable.

    Sort and limit stay adjacent: Spark keeps n rows per task and merges them.
    """
    return df.orderBy(*order, *[F.col(t).asc_nulls_last() for t in ties]).limit(n)


def latest_n(df: DataFrame, time: str, n: int, ties: list[str]) -> DataFrame:
    return top_n(df, [F.col(time).desc_nulls_last()], n, ties)


def order_by_labels(df: DataFrame, first: list[str], c: str, labels: list[str]) -> DataFrame:
    return df.orderBy(*first, position_in(c, labels))


def canonical_array(array: str | Column, key: str) -> Column:
    """Array of structs sorted by a text field, ignoring case.

    The lower-cased key leads the sort; the field itself and the old position
    break ties, which keeps equal keys in their order.
    """
    array = F.col(array) if isinstance(array, str) else array
    keyed = F.transform(
        array, lambda x, i: F.struct(F.lower(F.coalesce(x[key], F.lit(""))).alias("k"), i.alias("i"), x.alias("x"))
    )
    ordered = F.array_sort(
        keyed,
        lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(a["i"] - b["i"]),
    )
    return F.transform(ordered, lambda s: s["x"])
