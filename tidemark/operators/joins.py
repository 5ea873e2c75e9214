"""Joins that keep every row and do not multiply measures.

No broadcast hints: Spark broadcasts a side when its measured size is below the
session's limit and sort-merges otherwise, with skewed partitions split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tidemark.functions.dates import day
from tidemark.operators.sliced import next_row, running_number


def join_children(parent: DataFrame, child: DataFrame, key: str, measures: dict[str, Column]) -> DataFrame:
    """Left join of parents with child measures, aggregated to the key first.

    A key with a third of all children is combined on the map side and reaches
    the join as one row.
    """
    grouped = child.groupBy(key).agg(*[c.alias(n) for n, c in measures.items()])
    return parent.join(grouped, key, "left")


def join_dimensions(fact: DataFrame, *dims: tuple[DataFrame, str | list[str]]) -> DataFrame:
    """Left join chain to dimensions; each is (dimension, key or keys)."""
    return reduce(lambda left, d: left.join(d[0], d[1], "left"), dims, fact)


def with_region(fact: DataFrame, region: DataFrame, key: str = "country_code") -> DataFrame:
    return fact.join(region, key, "left")


def cast_key(dim: DataFrame, key: str, to: str) -> DataFrame:
    """Bring a key to the other side's type once; text that does not fit becomes NULL."""
    return dim.withColumn(key, F.col(key).try_cast(to))


def semi(df: DataFrame, keys: DataFrame, key: str | list[str]) -> DataFrame:
    return df.join(keys, key, "left_semi")


def remove_keys(df: DataFrame, keys: DataFrame, key: str | list[str]) -> DataFrame:
    return df.join(keys, key, "left_anti")


def child_count(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, counted: str, name: str):
    """Distinct children per parent, 0 for parents without any."""
    counts = child.groupBy(F.col(child_key).alias(parent_key)).agg(F.countDistinct(counted).alias(name))
    return parent.join(counts, parent_key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def window_totals(
    events: DataFrame,
    event_date: str,
    series: DataFrame,
    series_date: str,
    before: int,
    after: int,
    by: list[str],
    measures: dict[str, Column],
) -> DataFrame:
    """Totals of the series rows from ``before`` days earlier to ``after`` days later, per event and ``by``.

    An event without any series row keeps one row with NULL in ``by`` and the
    measures over nothing. The day offsets are exploded on the event side, which
    turns the range condition into an equi-join with a fixed factor of
    before + after + 1, and both sides are read once: days without series rows
    stay in the join as an empty group of their event, which is dropped wherever
    the event has another group. Equal events count together.
    """
    offsets = F.sequence(F.date_sub(event_date, before), F.date_add(event_date, after))
    spread = events.withColumn("__day", F.explode_outer(offsets))
    dated = series.withColumnRenamed(series_date, "__day").withColumn("__hit", F.lit(True))
    grouped = (
        spread.join(dated, "__day", "left")
        .groupBy(*events.columns, *by, F.col("__hit").isNotNull().alias("__met"))
        .agg(*[c.alias(n) for n, c in measures.items()])
    )
    # a row per event and group by now
    met = F.max("__met").over(Window.partitionBy(*events.columns))
    return grouped.withColumn("__any", met).filter(F.col("__met") | ~F.col("__any")).drop("__met", "__any")


def bounded_by(df: DataFrame, c: str, spikes: DataFrame, spike_date: str, pad: int) -> DataFrame:
    """Rows between the first and the last spike date, padded.

    Both bounds are fields of one scalar subquery, so the spikes are found once.
    """
    ends = F.struct(F.date_sub(F.min(spike_date), pad).alias("lo"), F.date_add(F.max(spike_date), pad).alias("hi"))
    bounds = spikes.agg(ends.alias("bounds")).scalar()
    return df.filter((F.col(c) >= bounds["lo"]) & (F.col(c) <= bounds["hi"]))


def literal_dim(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small table of fixed rows.

    Made from literals, its size is known and it is broadcast; that of a table
    made from Python objects is not, and a join with it would sort the facts by a
    key of few values.
    """
    kind = StructType.fromDDL(schema)
    items = [F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(row, kind.fields)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*items).cast(ArrayType(kind))))


def align_series(a: DataFrame, b: DataFrame, date: str, filled: list[str], how: str = "left") -> DataFrame:
    """Two daily series side by side; missing measures of ``b`` become 0."""
    joined = a.join(b, date, how)
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in filled})


def with_latest_child(
    parent: DataFrame, child: DataFrame, key: str, order: list[str], carry: list[str]
) -> DataFrame:
    """Each parent with its latest child: a map-side combined maximum, no window."""
    top = F.max(F.struct(F.struct(*order).alias("o"), F.struct(*carry).alias("v")))["v"].alias("v")
    latest = child.groupBy(key).agg(top).select(key, "v.*")
    return parent.join(latest, key, "left")


def pair_by_id(*phases: DataFrame, key: str = "benchmark_id") -> DataFrame:
    """Rows of several phases paired by id rather than by position."""
    return reduce(lambda left, right: left.join(right, key), phases)


def safe_join_agg(facts: list[tuple[DataFrame, dict[str, Column]]], keys: list[str], how: str = "left") -> DataFrame:
    """Aggregate every fact to the join grain, then join: no measure is multiplied."""
    grouped = [df.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()]) for df, measures in facts]
    return reduce(lambda left, right: left.join(right, keys, how), grouped)


def sequence_next(df: DataFrame, entity: str, order: list[str], carry: list[str], slices: int | None = None) -> DataFrame:
    """Each row with the next row of the same entity (fields prefixed ``next_``)."""
    moved = next_row(df, [entity], order, carry, "__next", slices)
    return moved.filter(F.col("__next").isNotNull()).select(
        *df.columns, *[F.col(f"__next.{c}").alias(f"next_{c}") for c in carry]
    )


def later_row_count(df: DataFrame, entity: str, order: list[str], name: str, slices: int | None = None) -> DataFrame:
    """How many later rows of the entity each row precedes, without emitting the pairs."""
    totals = df.groupBy(entity).agg(F.count(F.lit(1)).alias("__total"))
    numbered = running_number(df, [entity], order, "__number", slices)
    return numbered.join(totals, entity).withColumn(name, F.col("__total") - F.col("__number")).drop(
        "__total", "__number"
    )


def left_join_since(fact: DataFrame, dim: DataFrame, key: str, date: str, since: str) -> DataFrame:
    """Left join whose one-sided date condition sits in ON: older facts stay, unmatched.

    The condition blanks the key of older facts, so the join stays an equi-join.
    """
    recent = F.when(F.to_date(date) >= day(since), F.col(key))
    other = dim.withColumnRenamed(key, "__recent_key")
    return fact.withColumn("__key", recent).join(
        other, F.col("__key") == F.col("__recent_key"), "left"
    ).drop("__key", "__recent_key")


def day_lag(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Previous value per key; for rows already reduced to one per key and day."""
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))
