"""Text functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Characters the regex engine gives a meaning to; used to quote a delimiter.
_SPECIAL = re.compile(r"([\\^$.|?*+()\[\]{}-])")


def quote(literal: str) -> str:
    """Quote ``literal`` for use inside a regular expression."""
    return _SPECIAL.sub(r"\\\1", literal)


def upper(c: Column) -> Column:
    return F.upper(c)


def lower(c: Column) -> Column:
    return F.lower(c)


def proper(c: Column) -> Column:
    return F.initcap(c)


def trim(c: Column, whitespace: bool = False) -> Column:
    """Strip spaces; with ``whitespace`` also tabs and line ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "") if whitespace else F.trim(c)


def trim_start(c: Column) -> Column:
    return F.ltrim(c)


def trim_end(c: Column) -> Column:
    return F.rtrim(c)


def length(c: Column) -> Column:
    return F.length(c)


def start(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def end(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def replace(c: Column, old: str, new: str) -> Column:
    """Replace ``old`` taken literally, not as a pattern."""
    return F.replace(c, F.lit(old), F.lit(new))


def combine(columns: list[Column], separator: str = "") -> Column:
    """Join texts with a separator; nulls are left out."""
    return F.concat_ws(separator, *columns)


def concat(*columns: Column) -> Column:
    """The ``&`` operator: null in, null out."""
    return F.concat(*columns)


def split(c: Column, delimiter: str) -> Column:
    return F.split(c, quote(delimiter))


def pad_start(c: Column, n: int, fill: str = " ") -> Column:
    """Pad on the left; a text already long enough is kept whole."""
    return F.when(F.length(c) < n, F.lpad(c, n, fill)).otherwise(c)


def pad_end(c: Column, n: int, fill: str = " ") -> Column:
    return F.when(F.length(c) < n, F.rpad(c, n, fill)).otherwise(c)


def reverse(c: Column) -> Column:
    return F.reverse(c)


def to_text(c: Column) -> Column:
    return c.cast("string")


def before_delimiter(c: Column, delimiter: str, from_end: bool = False) -> Column:
    """Text before the first (or last) delimiter; the whole text when absent."""
    if not from_end:
        return F.substring_index(c, delimiter, 1)
    tail = F.length(F.substring_index(c, delimiter, -1)) + len(delimiter)
    return F.when(c.contains(delimiter), F.left(c, F.length(c) - tail)).otherwise(c)


def after_delimiter(c: Column, delimiter: str) -> Column:
    """Text after the first delimiter; empty when absent."""
    at = F.instr(c, delimiter)
    rest = F.substring(c, at + F.lit(len(delimiter)), F.length(c))
    return F.when(c.isNull(), None).when(at > 0, rest).otherwise(F.lit(""))


def split_on_last(c: Column, delimiter: str = "_") -> tuple[Column, Column]:
    """Split ``name_2020`` into name and digits on the last delimiter; empty texts when it does not fit."""
    pattern = rf"^(.+){quote(delimiter)}(\d+)$"
    return F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
