"""Number and general functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_to(c: Column, digits: int = 0, mode: str = "half_up") -> Column:
    """Round with ties away from zero (``half_up``) or to even (``half_even``)."""
    return {"half_up": F.round, "half_even": F.bround}[mode](c, digits)


def round_down(c: Column) -> Column:
    return F.floor(c)


def round_up(c: Column) -> Column:
    return F.ceil(c)


def absolute(c: Column) -> Column:
    return F.abs(c)


def to_number(c: Column, on_error: str = "raise") -> Column:
    return c.try_cast("double") if on_error == "null" else c.cast("double")


def to_int64(c: Column, on_error: str = "raise") -> Column:
    return c.try_cast("bigint") if on_error == "null" else c.cast("bigint")


def is_even(c: Column) -> Column:
    return c % 2 == 0


def is_odd(c: Column) -> Column:
    return c % 2 != 0


def divide(a: Column, b: Column) -> Column:
    """Divide; by zero gives null rather than an error."""
    return F.try_divide(a, b)


def first_present(*columns: Column) -> Column:
    """The ``??`` operator."""
    return F.coalesce(*columns)


def key_hash(*columns: Column) -> Column:
    """SHA-256 of the key values joined by ``||``, with nulls marked.

    Equal to hashing the joined text when no value is null; a marked null keeps
    ``('a', null)`` and ``(null, 'a')`` apart.
    """
    marked = [F.coalesce(c.cast("string"), F.lit("\u0000")) for c in columns]
    return F.sha2(F.concat_ws("||", *marked), 256)
