"""Ratios, percentages and change rates that are NULL where they are undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.dates import to_col


def safe_divide(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(to_col(a), to_col(b))


def money(c: str | Column, scale: int = 2) -> Column:
    return to_col(c).cast(f"decimal(38,{scale})")


def exact(c: str | Column) -> Column:
    """Cents as a decimal: sums no longer depend on the order of the rows."""
    return to_col(c).cast("decimal(18,2)")


def sum0(c: str | Column) -> Column:
    return F.coalesce(F.sum(to_col(c)), F.lit(0))


def rounded(c: str | Column, digits: int = 2) -> Column:
    return F.round(to_col(c).cast("double"), digits)


def exact_quotient(num: Column, den: Column, scale: int = 2) -> Column:
    """Quotient rounded half up from decimals, so a tie never depends on binary fractions."""
    return F.try_divide(num.cast("decimal(30,6)"), den.cast("decimal(18,0)")).cast(f"decimal(38,{scale})")


def ratio(num: str | Column, den: str | Column, scale: int = 2) -> Column:
    """Ratio of a sum to a sum of counts: sum first, divide once."""
    return exact_quotient(F.sum(to_col(num)), F.sum(to_col(den)), scale)


def mean(c: str | Column, digits: int = 2) -> Column:
    """Mean rounded half up, independent of the order of the rows."""
    return exact_quotient(F.sum(to_col(c)), F.count(to_col(c)), digits).cast("double")


def avg_ratio(num: str | Column, den: str | Column, digits: int = 2) -> Column:
    """Mean of the row ratios, which is not the ratio of the sums."""
    per_row = F.try_divide(to_col(num).cast("double"), to_col(den).cast("double"))
    return F.round(F.avg(per_row), digits)


def pct(part: str | Column, whole: str | Column, digits: int = 2) -> Column:
    part, whole = to_col(part).cast("double"), to_col(whole).cast("double")
    return F.round(F.try_divide(part * 100.0, whole), digits)


def percent_change(current: str | Column, previous: str | Column, guard: str = "positive", digits: int = 2) -> Column:
    """Change in percent of the previous value.

    ``positive``  NULL unless the previous value is above zero
    ``nonzero``   NULL only where the previous value is zero or missing
    ``abs``       as ``nonzero``, divided by the absolute previous value
    """
    now, before = to_col(current).cast("double"), to_col(previous).cast("double")
    base = F.abs(before) if guard == "abs" else before
    rate = F.round(F.try_divide((now - before) * 100.0, base), digits)
    return F.when(before > 0, rate) if guard == "positive" else rate


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def sum_if(condition: Column, c: str | Column) -> Column:
    return F.sum(F.when(condition, to_col(c)))


def count_distinct_if(condition: Column, c: str | Column) -> Column:
    return F.countDistinct(F.when(condition, to_col(c)))


def success_rate(flag: str | Column) -> Column:
    """Share of true flags; a missing flag counts as a failure."""
    return F.avg(F.when(to_col(flag), 1.0).otherwise(0.0))


def activity_score(messages: Column, reactions: Column, weight: float = 0.5) -> Column:
    return messages.cast("double") + reactions.cast("double") * weight
