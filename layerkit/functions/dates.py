"""Date and time functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def year(c: Column) -> Column:
    return F.year(c)


def month(c: Column) -> Column:
    return F.month(c)


def day(c: Column) -> Column:
    return F.dayofmonth(c)


def day_of_week(c: Column, first_day: int = 0, zero_based: bool = False) -> Column:
    """Day number in the week. ``first_day`` counts from Sunday = 0."""
    return F.pmod(F.dayofweek(c) - 1 - first_day, F.lit(7)) + (0 if zero_based else 1)


def day_of_year(c: Column) -> Column:
    return F.dayofyear(c)


def to_date(c: Column, fmt: str | None = None, on_error: str = "raise") -> Column:
    if on_error == "null":
        return (F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)).cast("date")
    return F.to_date(c, fmt) if fmt else F.to_date(c)


def to_datetime(c: Column, fmt: str | None = None, on_error: str = "raise") -> Column:
    if on_error == "null":
        return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
    return F.to_timestamp(c, fmt) if fmt else F.to_timestamp(c)


def add_days(c: Column, n: int | Column) -> Column:
    return F.date_add(c, n)


def add_months(c: Column, n: int | Column) -> Column:
    return F.add_months(c, n)


def add_years(c: Column, n: int) -> Column:
    """Calendar years: 29 February plus one year is 28 February."""
    return F.add_months(c, 12 * n)


def now() -> Column:
    return F.current_timestamp()
