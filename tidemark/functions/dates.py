"""Date and time column functions. Every relative date takes its anchor as an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day(value: str | Column) -> Column:
    """An ISO date text or a column as a DATE column."""
    return F.lit(value).cast("date") if isinstance(value, str) else value


def from_epoch_seconds(c: str | Column) -> Column:
    return F.timestamp_seconds(to_col(c))


def hour_of(c: str | Column) -> Column:
    return F.hour(to_col(c))


def truncated(c: str | Column, unit: str) -> Column:
    """Start of the hour, ISO week, month, quarter ... without a zone shift."""
    return F.date_trunc(unit, to_col(c)).cast("timestamp_ntz")


def start_date(c: str | Column, unit: str) -> Column:
    """Start of the week, month or quarter as a DATE."""
    return F.trunc(to_col(c), unit)


def day_of(c: str | Column) -> Column:
    return F.to_date(to_col(c))


def days_before(anchor: str | Column, n: int) -> Column:
    return F.date_sub(day(anchor), n)


def days_after(anchor: str | Column, n: int) -> Column:
    return F.date_add(day(anchor), n)


def elapsed(unit: str, start: Column, end: Column) -> Column:
    """Whole elapsed units between two instants (not crossed unit borders)."""
    return F.timestamp_diff(unit, start, end)


def lenient_date(c: str | Column, pattern: str = "yyyy-MM-dd") -> Column:
    """NULL instead of an error for text that is no date."""
    return F.try_to_date(to_col(c), pattern)


def month_end(c: str | Column) -> Column:
    return F.last_day(to_col(c))


def fiscal_year(c: str | Column, first_month: int = 7) -> Column:
    """The fiscal year is named after the calendar year it ends in."""
    c = to_col(c)
    return F.year(c) + F.when(F.month(c) >= first_month, 1).otherwise(0)


def previous_period_bounds(unit: str, as_of: str | Column) -> tuple[Column, Column]:
    """Half-open [start, end) of the calendar month or quarter before ``as_of``."""
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    end = F.trunc(day(as_of), unit)
    return F.add_months(end, -months), end
