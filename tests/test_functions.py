import datetime

import pytest
from pyspark.sql import functions as F

from layerkit.functions import dates as D, numbers as N, text as T


@pytest.fixture(scope="module")
def value(spark):
    def run(column):
        return spark.range(1).select(column.alias("v")).collect()[0][0]

    return run


def text(v):
    return F.lit(v).cast("string")


@pytest.mark.parametrize(
    "column, expected",
    [
        (T.trim(text(" \ta\n ")), "\ta\n"),
        (T.trim(text(" \ta\n "), whitespace=True), "a"),
        (T.trim_start(text("  a ")), "a "),
        (T.trim_end(text("  a ")), "  a"),
        (T.start(text("abcdef"), 2), "ab"),
        (T.end(text("abcdef"), 2), "ef"),
        (T.end(text("a"), 5), "a"),
        (T.replace(text("a.b.c"), ".", "|"), "a|b|c"),
        (T.combine([text("a"), text(None), text("c")], "-"), "a-c"),
        (T.concat(text("a"), text(None)), None),
        (T.split(text("a.b|c"), "."), ["a", "b|c"]),
        (T.split(text("a||b"), "||"), ["a", "b"]),
        (T.split(text("a[-b"), "[-"), ["a", "b"]),
        (T.pad_start(text("abcdef"), 3, "0"), "abcdef"),
        (T.pad_start(text("7"), 3, "0"), "007"),
        (T.pad_end(text("7"), 3, "0"), "700"),
        (T.reverse(text("abc")), "cba"),
        (T.proper(text("jane DOE")), "Jane Doe"),
        (T.before_delimiter(text("a - b - c"), " - "), "a"),
        (T.before_delimiter(text("a - b - c"), " - ", from_end=True), "a - b"),
        (T.before_delimiter(text("abc"), "_", from_end=True), "abc"),
        (T.before_delimiter(text("abc"), "_"), "abc"),
        (T.after_delimiter(text("a_b_c"), "_"), "b_c"),
        (T.after_delimiter(text("abc"), "_"), ""),
        (T.after_delimiter(text(None), "_"), None),
        (T.split_on_last(text("births_male_2020"))[0], "births_male"),
        (T.split_on_last(text("births_male_2020"))[1], "2020"),
        (T.split_on_last(text("births"))[0], ""),
        (T.length(text("añb")), 3),
    ],
)
def test_text(value, column, expected):
    assert value(column) == expected


def day(v):
    return F.lit(v).cast("date")


@pytest.mark.parametrize(
    "column, expected",
    [
        (D.day_of_week(day("2024-01-07")), 1),
        (D.day_of_week(day("2024-01-07"), zero_based=True), 0),
        (D.day_of_week(day("2024-01-07"), first_day=1), 7),
        (D.day_of_week(day("2024-01-08"), first_day=1, zero_based=True), 0),
        (D.add_years(day("2024-02-29"), 1), datetime.date(2025, 2, 28)),
        (D.add_months(day("2024-01-31"), 1), datetime.date(2024, 2, 29)),
        (D.add_days(day("2024-12-31"), 1), datetime.date(2025, 1, 1)),
        (D.to_date(text("31/12/2020"), "dd/MM/yyyy"), datetime.date(2020, 12, 31)),
        (D.to_date(text("12/31/2020"), "dd/MM/yyyy", on_error="null"), None),
        (D.to_date(text("n/a"), on_error="null"), None),
        (D.to_datetime(text("2020-01-02 03:04:05"), on_error="null"), datetime.datetime(2020, 1, 2, 3, 4, 5)),
        (D.year(day("2024-02-03")) * 10000 + D.month(day("2024-02-03")) * 100 + D.day(day("2024-02-03")), 20240203),
        (D.day_of_year(day("2024-03-01")), 61),
    ],
)
def test_dates(value, column, expected):
    assert value(column) == expected


def test_now_is_a_timestamp(value):
    assert isinstance(value(D.now()), datetime.datetime)


@pytest.mark.parametrize(
    "column, expected",
    [
        (N.round_to(F.lit(2.5)), 3.0),
        (N.round_to(F.lit(2.5), mode="half_even"), 2.0),
        (N.round_to(F.lit(-2.5)), -3.0),
        (N.round_to(F.lit(1.256), 2), 1.26),
        (N.round_down(F.lit(-1.2)), -2),
        (N.round_up(F.lit(-1.2)), -1),
        (N.absolute(F.lit(-3)), 3),
        (N.to_number(text("x"), on_error="null"), None),
        (N.to_int64(text("12")), 12),
        (N.is_even(F.lit(-2)), True),
        (N.is_odd(F.lit(-3)), True),
        (N.divide(F.lit(1), F.lit(0)), None),
        (N.first_present(text(None), text("b")), "b"),
    ],
)
def test_numbers(value, column, expected):
    assert value(column) == expected


def test_key_hash_marks_nulls_and_equals_the_plain_hash(value):
    assert value(N.key_hash(text("a"), text(None))) != value(N.key_hash(text(None), text("a")))
    assert value(N.key_hash(text("a"), text(None))) != value(N.key_hash(text("a")))
    assert value(N.key_hash(F.lit(1), text("b"))) == value(F.sha2(F.concat_ws("||", F.lit("1"), F.lit("b")), 256))
