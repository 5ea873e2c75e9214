"""Row filters. They stay plain column predicates so that scans can prune on them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import day, days_before, month_end, previous_period_bounds


def between_dates(df: DataFrame, c: str, lo: str, hi: str) -> DataFrame:
    return df.filter(F.col(c).between(day(lo), day(hi)))


def last_n_days(df: DataFrame, c: str, n: int, as_of: str | Column) -> DataFrame:
    return df.filter(F.col(c) >= days_before(as_of, n))


def last_n_months(df: DataFrame, c: str, n: int, as_of: str | Column) -> DataFrame:
    """From the start of the month ``n`` months before the anchor's month."""
    return df.filter(F.col(c) >= F.add_months(F.trunc(day(as_of), "month"), -n))


def on_day(df: DataFrame, c: str, d: str) -> DataFrame:
    return df.filter(F.col(c) == day(d))


def around(df: DataFrame, c: str, instant: str, span: str) -> DataFrame:
    """Rows within ``span`` (such as ``1 hour``) of an instant, both ends included."""
    at, width = F.lit(instant).cast("timestamp_ntz"), F.expr(f"INTERVAL {span}")
    return df.filter(F.col(c).between(at - width, at + width))


def one_of(df: DataFrame, c: str, values: list) -> DataFrame:
    return df.filter(F.col(c).isin(values))


def has_text(df: DataFrame, c: str, longer_than: int = 0) -> DataFrame:
    return df.filter(F.col(c).isNotNull() & (F.length(c) > longer_than))


def flagged(df: DataFrame, c: str, wanted: bool = True) -> DataFrame:
    return df.filter(F.col(c) if wanted else ~F.col(c))


def month_end_only(df: DataFrame, end: str, month_to_date: bool = False) -> DataFrame:
    """Only rows of complete months; month-to-date rows too when asked for."""
    return df if month_to_date else df.filter(F.col(end) == month_end(end))


def last_complete_month(df: DataFrame, end: str, as_of: str | Column) -> DataFrame:
    return df.filter(F.col(end) == F.last_day(F.add_months(day(as_of), -1)))


def previous_period(df: DataFrame, c: str, unit: str, as_of: str | Column) -> DataFrame:
    """The whole calendar month or quarter before the anchor."""
    start, end = previous_period_bounds(unit, as_of)
    return df.filter((F.col(c) >= start) & (F.col(c) < end))


def above_mean(df: DataFrame, c: str, factor: float) -> DataFrame:
    """Rows at or above ``factor`` times the column mean (a scalar subquery)."""
    mean = df.agg(F.avg(c).alias("mean")).scalar()
    return df.filter(F.col(c) >= mean * factor)


def with_label(df: DataFrame, **labels) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in labels.items()})


def rename(df: DataFrame, **names: str) -> DataFrame:
    return df.withColumnsRenamed({old: new for new, old in names.items()})


def keep_active(
    parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, flag: str, compat: bool = False
) -> DataFrame:
    """Parents with their children that are not deleted.

    Deleted children go before the left join, so a parent keeps its row when all
    its children are deleted. ``compat`` filters after the join instead, which
    loses such parents.
    """
    on = F.col(parent_key) == F.col(child_key)
    if compat:
        joined = parent.join(child, on, "left")
        return joined.filter(F.col(child_key).isNull() | ~F.col(flag))
    return parent.join(child.filter(~F.col(flag)), on, "left")


def having(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


PARAMETER_TYPES = {"STRING": str, "INTEGER": int, "DATE": lambda v: dt.date.fromisoformat(str(v)[:10])}
# Type hints accepted only under another name.
TYPE_HINT_ALIASES = {"LONG": "INTEGER", "DOUBLE": "INTEGER", "TIMESTAMP": "DATE", "BOOLEAN": "STRING"}


def run_template(spark: SparkSession, sql: str, parameters: dict[str, tuple[str, object]], **relations) -> DataFrame:
    """Run a query text with ``:name`` markers bound to typed values.

    ``parameters`` maps a marker to (type hint, value). Values are bound, never
    pasted into the text. Relations are passed by name and referred to as
    ``{name}``.
    """
    bound = {}
    for name, (hint, value) in parameters.items():
        hint = TYPE_HINT_ALIASES.get(hint.upper(), hint.upper())
        bound[name] = PARAMETER_TYPES[hint](value)
    return spark.sql(sql, args=bound, **relations)
