"""Ordered operators over groups too large for one task.

A window over a key holds the whole group of that key in one task. Here each
group is cut into slices of its order columns; the window runs per (key, slice),
and a second, small window over one summary row per slice carries the result
across slice borders.

Slices come from approximate quantiles of the first order column, each quantile
range being cut again evenly, so a key with a third of all rows spreads over
about a third of the slices. A value that fills a quantile range by itself is
cut by the second order column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

_SLICE = "__slice"
RANGES = 64  # quantile ranges; finer slices come from even cuts within a range
SLICE_ROWS = 200_000  # rows that a slice is meant to hold


def _order(columns: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in columns]


def _number(df: DataFrame, c: str) -> Column | None:
    """A number that sorts as the column does, None for types without one."""
    kind = dict(df.dtypes)[c]
    if kind == "date":
        return F.unix_date(F.col(c)).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return F.col(c).cast("double")
    return None


def _placed(df: DataFrame, value: str, cuts: str, per_range: Column, name: str) -> DataFrame:
    """Add the slot of a value and whether the value is a repeated quantile.

    A slot is the quantile range and an even share of that range; the last slot
    of a range is kept for repeated quantiles. The range is found by comparing
    with every eighth cut and then with the cuts between, as plain arithmetic
    that Spark compiles.
    """
    v, c = F.col(value), F.col(cuts)
    step, below, equal = f"{name}_step", f"{name}_below", f"{name}_repeated"

    def smaller(*indexes) -> Column:
        flags = [(F.get(c, i if isinstance(i, Column) else F.lit(i)) < v).cast("int") for i in indexes]
        return sum(flags[1:], flags[0])

    searched = df.withColumn(step, smaller(*range(8, RANGES, 8)) * 8)
    searched = searched.withColumn(below, F.col(step) + smaller(*[F.col(step) + i for i in range(1, 8)]))
    low, high, after = (F.get(c, F.col(below) + i) for i in (0, 1, 2))
    # the cuts are sorted: a repeated one meets its equal right beside it
    twice = F.coalesce((high == v) & (after == v), F.lit(False)) | F.coalesce((low == v) & (high == v), F.lit(False))
    share = F.floor(F.try_divide(v - low, high - low) * per_range).cast("int")
    inside = F.greatest(F.lit(0), F.least(per_range - 1, F.coalesce(share, F.lit(0))))
    return searched.withColumn(equal, twice).withColumn(
        name, F.col(below) * (per_range + 1) + F.when(F.col(equal), per_range).otherwise(inside)
    )


def sliced(df: DataFrame, order: list[str], slices: int | None = None) -> DataFrame:
    """Add the slice number of the order columns (monotone in their order).

    Without ``slices`` their number follows the number of rows, which comes with
    the quantiles from one pass.
    """
    lead = _number(df, order[0])
    if lead is None:
        raise TypeError(f"cannot slice by {order[0]}: its type has no numeric order")
    second = _number(df, order[1]) if len(order) > 1 else None
    steps = [i / RANGES for i in range(RANGES + 1)]
    quantiles = [F.percentile_approx(lead, steps, 2000).alias("a"), F.count(F.lit(1)).alias("n")]
    if second is not None:
        quantiles.append(F.percentile_approx(second, steps, 2000).alias("b"))
    cuts = df.agg(F.struct(*quantiles).alias("cuts")).scalar()
    held = df.withColumns({"__cuts": cuts, "__lead": lead})
    wanted = F.lit(slices) if slices else F.col("__cuts.n") / SLICE_ROWS
    per_range = F.greatest(F.lit(1), F.ceil(wanted / RANGES).cast("int"))
    placed = _placed(held, "__lead", "__cuts.a", per_range, "__p")
    number = F.col("__p") * F.lit(RANGES + 3).cast("bigint")
    if second is not None:
        # searched only for rows with a repeated first value
        placed = placed.withColumn("__second", second)
        within = F.size(F.filter("__cuts.b", lambda cut: cut < F.col("__second"))) + 1
        known = F.col("__p_repeated") & F.col("__second").isNotNull()
        number = number + F.when(known, within).otherwise(0)
    unknown = F.col("__lead").isNull() | F.col("__cuts.a").isNull()
    helpers = [c for c in placed.columns if c not in df.columns]
    return placed.withColumn(_SLICE, F.when(unknown, -1).otherwise(number)).drop(*helpers)


def _slice_summary(df: DataFrame, keys: list[str], summaries: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys, _SLICE).agg(*[c.alias(n) for n, c in summaries.items()])


def _with_summary(df: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    on = [df[k].eqNullSafe(summary[k]) for k in (*keys, _SLICE)]
    joined = df.join(summary, _all(on), "left")
    for k in (*keys, _SLICE):
        joined = joined.drop(summary[k])
    return joined


def _all(conditions: list[Column]) -> Column:
    result = conditions[0]
    for c in conditions[1:]:
        result = result & c
    return result


def running_number(df: DataFrame, keys: list[str], order: list[str], name: str, slices: int | None = None) -> DataFrame:
    """1, 2, 3 ... per key in the given order (which must be total)."""
    cut = sliced(df, order, slices)
    before = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    summary = _slice_summary(cut, keys, {"__n": F.count(F.lit(1))}).withColumn(
        "__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))
    ).drop("__n")
    local = F.row_number().over(Window.partitionBy(*keys, _SLICE).orderBy(*_order(order)))
    numbered = cut.withColumn("__local", local)
    return _with_summary(numbered, summary, keys).withColumn(
        name, F.col("__local") + F.col("__offset")
    ).drop("__local", "__offset", _SLICE)


def best_before(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str, slices: int | None = None
) -> DataFrame:
    """Largest value among the earlier rows of the key; NULL for the first row."""
    cut = sliced(df, order, slices)
    before = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    summary = _slice_summary(cut, keys, {"__top": F.max(value)}).withColumn(
        "__carried", F.max("__top").over(before)
    ).drop("__top")
    inside = (
        Window.partitionBy(*keys, _SLICE).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = cut.withColumn("__inside", F.max(value).over(inside))
    return _with_summary(numbered, summary, keys).withColumn(
        name, F.greatest("__inside", "__carried")
    ).drop("__inside", "__carried", _SLICE)


def value_ranks(
    df: DataFrame, keys: list[str], by: str, name: str, descending: bool = False, slices: int | None = None
) -> DataFrame:
    """One row per key and value of ``by`` with the competition rank of that value."""
    counts = df.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("__n"))
    # read for the ranks within a slice and for the totals of all slices
    cut = materialize(sliced(counts, [by], slices), "value-slices")
    group = Window.partitionBy(*keys)
    before = group.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    summary = _slice_summary(cut, keys, {"__held": F.sum("__n")}).withColumns(
        {"__offset": F.coalesce(F.sum("__held").over(before), F.lit(0)), "__all": F.sum("__held").over(group)}
    ).drop("__held")
    inside = (
        Window.partitionBy(*keys, _SLICE).orderBy(*_order([by])).rowsBetween(Window.unboundedPreceding, 0)
    )
    reached = cut.withColumn("__local", F.sum("__n").over(inside))
    up_to = F.col("__offset") + F.col("__local")
    rank = F.col("__all") - up_to + 1 if descending else up_to - F.col("__n") + 1
    return _with_summary(reached, summary, keys).select(*keys, by, rank.alias(name))


def competition_ranks(
    df: DataFrame, keys: list[str], ranks: dict[str, tuple[str, bool]], slices: int | None = None
) -> DataFrame:
    """Ranks per key, {name: (column, descending)}; equal values share a rank and the next ones are skipped.

    Rows are first reduced to one per value with its number of rows, so a value
    that a third of all rows share is one row when values are put in order, and no
    task orders more than a slice of the values. NULL counts as smaller than any
    value, as in Spark's own sort orders. A column must be of a type with a number.
    ``df`` is read for each rank, so hand over a written table.
    """
    result = df
    for name, (by, descending) in ranks.items():
        found = value_ranks(df, keys, by, name, descending, slices)
        renamed = found.withColumnsRenamed({k: f"__of_{k}" for k in (*keys, by)})
        on = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in (*keys, by)]
        result = result.join(renamed, _all(on)).drop(*[f"__of_{k}" for k in (*keys, by)])
    return result


def next_row(
    df: DataFrame, keys: list[str], order: list[str], carry: list[str], name: str, slices: int | None = None
) -> DataFrame:
    """A struct of ``carry`` columns of the next row of the key, NULL for the last row."""
    cut = sliced(df, order, slices)
    held = F.struct(*carry)
    first = F.min(F.struct(F.struct(*order).alias("o"), held.alias("v")))["v"]
    after = Window.partitionBy(*keys).orderBy(_SLICE)
    summary = _slice_summary(cut, keys, {"__first": first}).withColumn(
        "__following", F.lead("__first").over(after)
    ).drop("__first")
    window = Window.partitionBy(*keys, _SLICE).orderBy(*_order(order))
    moved = cut.withColumn("__lead", F.lead(held).over(window))
    return _with_summary(moved, summary, keys).withColumn(
        name, F.coalesce("__lead", "__following")
    ).drop("__lead", "__following", _SLICE)
