"""Grouped aggregations. All of them combine on the map side before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profile(df: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Count, sum, mean, smallest and largest value per group."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(measure).alias("total"),
        F.avg(measure).alias("mean"),
        F.min(measure).alias("smallest"),
        F.max(measure).alias("largest"),
    )


def distinct_counts(df: DataFrame, keys: list[str], columns: dict[str, str], approximate: bool = False) -> DataFrame:
    """Several distinct counts per group; {output name: column}.

    Exact counts come from one narrow grouping per column, each reading the keys and
    its column alone, and meet as one row per group. Asked for in one grouping, Spark
    would copy every row once per column, with all columns of the others as blanks.
    A sketch has no such copies and takes all columns in one pass.
    """
    if approximate or len(columns) == 1 or not keys:
        counter = F.approx_count_distinct if approximate else F.countDistinct
        return df.groupBy(*keys).agg(*[counter(c).alias(name) for name, c in columns.items()])
    parts = [df.groupBy(*keys).agg(F.countDistinct(c).alias(name)) for name, c in columns.items()]
    return reduce(lambda left, right: meet(left, right, keys), parts)


def meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two groupings over the same rows side by side; NULL is a group like any other."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(renamed, on).drop(*[f"__{k}" for k in keys])


def two_level(
    df: DataFrame, entity: list[str], inner: dict[str, Column], group: list, outer: dict[str, Column]
) -> DataFrame:
    """Aggregate to the entity, then to the group."""
    per_entity = df.groupBy(*entity).agg(*[c.alias(n) for n, c in inner.items()])
    return per_entity.groupBy(*group).agg(*[c.alias(n) for n, c in outer.items()])


def pivot_max(df: DataFrame, keys: list[str], category: str, values: list[str], measures: dict[str, str]) -> DataFrame:
    """One column per (category value, measure): ``{value}_{name}``."""
    picked = [
        F.max(F.when(F.col(category) == v, F.col(m))).alias(f"{v}_{name}".lower())
        for name, m in measures.items()
        for v in values
    ]
    return df.groupBy(*keys).agg(*picked)


def count_map(df: DataFrame, keys: list[str], category: str, name: str) -> DataFrame:
    """Counts per category as one map per group, entries sorted by category.

    Rows are first reduced to one per (group, category), so the collected list
    is as long as the category list.
    """
    counts = df.filter(F.col(category).isNotNull()).groupBy(*keys, category).agg(
        F.count(F.lit(1)).cast("int").alias("__n")
    )
    entries = F.array_sort(F.collect_list(F.struct(F.col(category).alias("k"), F.col("__n").alias("v"))))
    return counts.groupBy(*keys).agg(F.map_from_entries(entries).alias(name))


def top_category(df: DataFrame, keys: list[str], category: str, name: str) -> DataFrame:
    """Most frequent category per group; equal counts go to the first name."""
    counts = df.filter(F.col(category).isNotNull()).groupBy(*keys, category).agg(F.count(F.lit(1)).alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col(category).alias("c")))["c"]
    return counts.groupBy(*keys).agg(best.alias(name))


def score_rollup(results: DataFrame, keys: list[str], passed: str = "passed") -> DataFrame:
    """Total, passed, failed and score; the score of nothing is 0."""
    ok = F.count_if(F.col(passed))
    total = F.count(F.lit(1))
    score = F.coalesce(F.try_divide(ok.cast("double"), total.cast("double")), F.lit(0.0))
    return results.groupBy(*keys).agg(
        total.alias("total"), ok.alias("passed"), (total - ok).alias("failed"), score.alias("score")
    )


def recurring(df: DataFrame, keys: list[str], at_least: int, name: str = "fail_count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) >= at_least)


def value_counts(df: DataFrame, keys: list[str], name: str = "occurrences") -> DataFrame:
    """One row per combination of keys with its number of rows, however large a group is."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def first_examples(df: DataFrame, keys: list[str], value: str, n: int, name: str) -> DataFrame:
    """Up to ``n`` example values per group, most frequent first.

    The limit on the row number holds below the shuffle as well: each task passes
    on n values of a group at most, and lists are made of those alone.
    """
    counts = df.groupBy(*keys, value).agg((-F.count(F.lit(1))).alias("__n"))
    order = Window.partitionBy(*keys).orderBy("__n", F.col(value).asc_nulls_first())
    top = counts.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= n)
    listed = F.array_sort(F.collect_list(F.struct("__rank", F.col(value).alias("v"))))
    return top.groupBy(*keys).agg(F.transform(listed, lambda s: s["v"]).alias(name))
