"""Row conditions. All follow SQL's three-valued logic: null drops the row."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, functions as F

_COMPARE = {
    "=": operator.eq,
    "<>": operator.ne,
    ">": operator.gt,
    "<": operator.lt,
    ">=": operator.ge,
    "<=": operator.le,
}


def compare(left: Column, op: str, right) -> Column:
    """Compare with any column or value on the right; ``= null`` tests for null."""
    if right is None:
        if op == "=":
            return left.isNull()
        if op == "<>":
            return left.isNotNull()
        raise ValueError(f"null has no order: {op}")
    return _COMPARE[op](left, right)


def all_of(*conditions: Column) -> Column:
    return reduce(operator.and_, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(operator.or_, conditions)


def negate(condition: Column) -> Column:
    return ~condition


def contains(text: Column, part) -> Column:
    return text.contains(part)


def starts_with(text: Column, part) -> Column:
    return text.startswith(part)


def ends_with(text: Column, part) -> Column:
    return text.endswith(part)


def one_of(value: Column, allowed) -> Column:
    return value.isin(list(allowed))


def in_range(value: Column, low=None, high=None) -> Column:
    """Inclusive on both ends; an end left out is open."""
    tests = []
    if low is not None:
        tests.append(value >= low)
    if high is not None:
        tests.append(value <= high)
    return all_of(*tests) if tests else F.lit(True)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)
