"""Column statistics of a table in a fixed number of passes, whatever its number of columns."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from layerkit.functions.columns import as_list, col, require, unused_name
from layerkit.session import stage
from layerkit.sources.sinks import export_csv, export_json

# Text patterns in order of preference, and the share that must match.
PATTERNS = [
    ("email", r"@.+\..+"),
    ("phone", r"^\+?\d[\d\s\-\(\)]+$"),
    ("url", r"^https?://|^www\."),
]
PATTERN_SHARE = 0.8

# Most frequent values listed, and the most distinct values a listed column has.
TOP_VALUES = 5
LISTED_DISTINCT = 10


def type_name(kind: T.DataType) -> str:
    """Profile type of a Spark type."""
    if isinstance(kind, T.IntegralType):
        return "bigint"
    if isinstance(kind, T.NumericType):
        return "decimal"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime2"
    if isinstance(kind, T.BooleanType):
        return "bit"
    return "nvarchar"


def as_text(field: T.StructField) -> Column:
    """A column's value as text, one text per distinct value."""
    c, kind = col(field.name), field.dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(c == 0, F.lit(0.0)).otherwise(c).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


class _Part(NamedTuple):
    """A table to profile: its rows, and its columns under numbers unique over all tables."""

    table: str
    df: DataFrame
    fields: list[tuple[int, T.StructField]]


def _parts(
    tables: Mapping[str, DataFrame], columns: Mapping[str, Iterable[str]] | None = None
) -> tuple[list[_Part], DataFrame]:
    """The tables to profile, and one row per column of them."""
    parts, rows = [], []
    for table, df in tables.items():
        wanted = as_list((columns or {}).get(table, df.columns))
        require(df, wanted)
        fields = []
        for position, field in enumerate(df.schema.fields):
            if field.name in wanted:
                fields.append((len(rows), field))
                rows.append({
                    "id": len(rows), "table_name": table, "position": position, "column_name": field.name,
                    "data_type": type_name(field.dataType),
                })
        parts.append(_Part(table, df.select(*[col(f.name) for _, f in fields]), fields))
    # One row per column: a literal, whatever their number.
    listed = F.from_json(
        F.lit(json.dumps(rows)),
        "array<struct<id:int,table_name:string,position:int,column_name:string,data_type:string>>",
    )
    return parts, parts[0].df.sparkSession.range(0, 1, 1, 1).select(F.inline(listed))


def _is_exact(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.IntegralType, T.DecimalType))


def _column_stats(i: int, field: T.StructField, distinct_error: float | None) -> Column:
    """All that one pass over a column gives without moving its values."""
    c, value, kind = col(field.name), as_text(field), field.dataType
    none = lambda t: F.lit(None).cast(t)
    number = c.cast("double") if isinstance(kind, T.NumericType) else None
    width = F.length(value) if isinstance(kind, T.StringType) else None
    ends = type_name(kind) == "datetime2" or _is_exact(kind)
    return F.struct(
        F.lit(i).alias("id"),
        F.count(F.lit(1)).alias("__total"),
        F.count(c).alias("__present"),
        (F.approx_count_distinct(value, distinct_error) if distinct_error else none("bigint")).alias("__near"),
        (F.min(number) if number is not None else none("double")).alias("__low"),
        (F.max(number) if number is not None else none("double")).alias("__high"),
        (F.avg(number) if number is not None else none("double")).alias("__mean"),
        (F.min(width) if width is not None else none("int")).alias("__short"),
        (F.max(width) if width is not None else none("int")).alias("__long"),
        (F.avg(width) if width is not None else none("double")).alias("__width"),
        (F.min(c).cast("string") if ends else none("string")).alias("__first"),
        (F.max(c).cast("string") if ends else none("string")).alias("__last"),
        *[(F.count_if(value.rlike(regex)) if width is not None else none("bigint")).alias(f"__{name}") for name, regex in PATTERNS],
    )


def _stats(parts: list[_Part], distinct_error: float | None) -> DataFrame:
    """One row per column, by one aggregate per table: only its results are shuffled."""
    each = [p.df.agg(F.array(*[_column_stats(i, f, distinct_error) for i, f in p.fields]).alias("s")).select(F.inline("s")) for p in parts if p.fields]
    return reduce(DataFrame.union, each)


def _distinct_counts(parts: list[_Part]) -> DataFrame:
    """Distinct values of each column, told apart by digests of 128 bits: long values are never moved."""

    def cell(i: int, field: T.StructField) -> Column:
        value = as_text(field)
        return F.struct(F.lit(i).alias("id"), F.xxhash64(value).alias("a"), F.xxhash64(value, F.lit(i)).alias("b"), value.isNull().alias("none"))

    stacked = [p.df.select(F.inline(F.array(*[cell(i, f) for i, f in p.fields]))) for p in parts if p.fields]
    found = reduce(DataFrame.union, stacked).where(~F.col("none")).select("id", "a", "b").distinct()
    return found.groupBy(F.col("id").alias("__counted")).agg(F.count(F.lit(1)).alias("__distinct"))


def _value_counts(parts: list[_Part]) -> DataFrame:
    """Rows per (column, value) over columns of few values."""
    cell = lambda i, f: F.struct(F.lit(i).alias("id"), as_text(f).alias("value"))
    stacked = [p.df.select(F.inline(F.array(*[cell(i, f) for i, f in p.fields]))) for p in parts if p.fields]
    return reduce(DataFrame.union, stacked).where("value is not null").groupBy("id", "value").agg(F.count(F.lit(1)).alias("count"))


def _percentages(total: Column, present: Column, distinct: Column) -> list[Column]:
    """Null counts are shares of all rows, distinct values of the non-null ones."""
    return [
        F.when(total > 0, (total - present) / total * 100).otherwise(0.0).alias("null_percentage"),
        distinct.alias("distinct_count"),
        F.when(present > 0, distinct / present * 100).otherwise(0.0).alias("cardinality_percentage"),
    ]


def key_profile(tables: Mapping[str, DataFrame], columns: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """The part of a profile that finding keys needs: null and distinct counts, of all columns or of those named."""
    parts, listed_columns = _parts(tables, columns)
    counts = [
        p.df.agg(F.array(*[
            F.struct(F.lit(i).alias("id"), F.count(F.lit(1)).alias("__total"), F.count(col(f.name)).alias("__present")) for i, f in p.fields
        ]).alias("s")).select(F.inline("s"))
        for p in parts if p.fields
    ]
    found = reduce(DataFrame.union, counts).join(_distinct_counts(parts), F.col("id") == F.col("__counted"), "left").drop("__counted")
    total, present, distinct = (F.coalesce(c, F.lit(0)).cast("bigint") for c in ("__total", "__present", "__distinct"))
    return listed_columns.join(found, "id", "left").select(
        "table_name", "position", "column_name", "data_type", total.alias("total_count"),
        *_percentages(total, present, distinct),
    )


def profile_all(
    tables: Mapping[str, DataFrame],
    distinct_error: float | None = None,
    columns: Mapping[str, Iterable[str]] | None = None,
) -> DataFrame:
    """Profiles of several tables, by one plan over all of them: see :func:`profile`."""
    parts, listed_columns = _parts(tables, columns)
    if not any(p.fields for p in parts):
        raise ValueError("no columns to profile")
    stats = _stats(parts, distinct_error)
    if not distinct_error:
        stats = stats.join(_distinct_counts(parts), F.col("id") == F.col("__counted"), "left").drop("__counted")
    else:
        stats = stats.withColumn("__distinct", F.col("__near"))
    stats = stage(stats, "profile")
    # One row per column comes to the driver; twice the limit allows for an estimate's error.
    few = {r[0] for r in stats.filter(F.col("__distinct") <= LISTED_DISTINCT * (2 if distinct_error else 1)).select("id").collect()}
    counted = [p._replace(fields=[(i, f) for i, f in p.fields if i in few]) for p in parts]
    found = listed_columns.join(stats, "id", "left")
    if any(p.fields for p in counted):
        # At most twice ten rows per column.
        counts = _value_counts(counted)
        frequent = Window.partitionBy("id").orderBy(F.col("count").desc(), F.col("value"))
        ranked = counts.withColumn("__rank", F.row_number().over(frequent)).withColumn("__exact", F.count(F.lit(1)).over(Window.partitionBy("id")))
        top = ranked.groupBy(F.col("id").alias("__kept")).agg(
            F.max("__exact").alias("__exact"),
            F.array_sort(F.collect_list(F.when(F.col("__rank") <= TOP_VALUES, F.struct("__rank", "value", "count")))).alias("__top"),
        )
        found = found.join(top, F.col("id") == F.col("__kept"), "left")
        found = found.withColumn("__top", F.when(F.col("__exact") <= LISTED_DISTINCT, F.col("__top")))
    else:
        nothing = "array<struct<__rank:int,value:string,count:bigint>>"
        found = found.withColumns({"__exact": F.lit(None).cast("bigint"), "__top": F.lit(None).cast(nothing)})
    first, last = F.col("__first"), F.col("__last")
    is_date = F.col("data_type") == "datetime2"

    total = F.coalesce("__total", F.lit(0)).cast("bigint")
    present = F.coalesce("__present", F.lit(0)).cast("bigint")
    distinct = F.coalesce("__exact", "__distinct", F.lit(0)).cast("bigint")
    pattern = F.lit(None).cast("string")
    for name, _ in reversed(PATTERNS):
        pattern = F.when(F.col(f"__{name}") > PATTERN_SHARE * present, F.lit(name)).otherwise(pattern)
    shown = F.transform("__top", lambda v: F.struct(v["value"].alias("value"), v["count"].alias("count")))
    return found.select(
        "table_name", "position", "column_name", "data_type",
        total.alias("total_count"),
        present.alias("non_null_count"),
        (total - present).alias("null_count"),
        *_percentages(total, present, distinct),
        F.col("__low").alias("min_value"), F.col("__high").alias("max_value"), F.col("__mean").alias("avg_value"),
        F.when(is_date, first).alias("min_date"), F.when(is_date, last).alias("max_date"),
        F.col("__short").cast("bigint").alias("min_length"),
        F.col("__long").cast("bigint").alias("max_length"),
        F.col("__width").alias("avg_length"),
        pattern.alias("pattern"),
        shown.alias("top_values"),
        # Whole numbers and decimals to the last digit, which the doubles above may not hold.
        F.when(~is_date, first).alias("min_exact"), F.when(~is_date, last).alias("max_exact"),
    )


def profile(
    df: DataFrame,
    table: str,
    columns: str | Iterable[str] | None = None,
    distinct_error: float | None = None,
) -> DataFrame:
    """One row per column: counts, distinct values, range, lengths, pattern and top values.

    Counts, ranges, lengths and patterns come from one aggregate, which moves
    none of the values. Distinct values are counted by digests of fixed width;
    ``distinct_error`` (a relative standard deviation) estimates them in that
    aggregate instead, without moving anything. Only columns that hold few values
    are then grouped by value. Runs one job, whose result is staged.
    """
    return profile_all({table: df}, distinct_error, None if columns is None else {table: as_list(columns)})


def save_profile(profile: DataFrame, path: str, fmt: str = "json") -> None:
    """Write a profile as JSON, or as CSV with the top values as JSON text."""
    if fmt == "json":
        export_json(profile, path)
    elif fmt == "csv":
        export_csv(profile.withColumn("top_values", F.to_json("top_values")), path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def sample_fraction(df: DataFrame, fraction: float, keys: str | Iterable[str] | None = None) -> DataFrame:
    """Rows whose key hash falls in the first ``fraction`` of its range: the same rows on every run."""
    names = df.columns if keys is None else as_list(keys)
    steps = 1_000_000
    return df.filter(F.pmod(F.xxhash64(*[col(n) for n in names]), F.lit(steps)) < int(fraction * steps))


def sample_rows(df: DataFrame, n: int, by: str | Iterable[str] = (), keys: str | Iterable[str] | None = None, seed: str = "sample") -> DataFrame:
    """Exactly ``n`` rows of each stratum (a value of ``by``), or all where it has fewer: those with the smallest hashes.

    The hash is that of ``seed`` and ``keys``, by default of all columns, so the
    sample is the same on every run, and a sample of fewer rows is part of one of
    more. Each task passes on at most ``n`` rows of a stratum, however many it has.
    """
    names, by = df.columns if keys is None else as_list(keys), as_list(by)
    require(df, [*names, *by])
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        raise ValueError("a sample this large is taken by share: sample_fraction")
    place = unused_name(df, "__place")
    text = [F.coalesce(col(k).cast("string"), F.lit("")) for k in names]
    order = [F.md5(F.concat_ws("|", F.lit(seed), *text)), *[col(k).asc_nulls_first() for k in names]]
    ranked = df.withColumn(place, F.row_number().over(Window.partitionBy(*[col(b) for b in by]).orderBy(*order)))
    return ranked.filter(col(place) <= n).drop(place)


def profile_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Compare two profiles by column name."""
    shown = ["data_type", "total_count", "null_percentage", "distinct_count", "cardinality_percentage"]
    a = before.select(F.col("column_name").alias("__a"), *[F.col(c).alias(f"{c}_before") for c in shown])
    b = after.select(F.col("column_name").alias("__b"), *[F.col(c).alias(f"{c}_after") for c in shown])
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed")
    return a.join(b, F.col("__a") == F.col("__b"), "full").select(
        F.coalesce("__a", "__b").alias("column_name"),
        change.when(F.col("data_type_before") != F.col("data_type_after"), "retyped").otherwise("kept").alias("change"),
        "data_type_before", "data_type_after",
        (F.col("total_count_after") - F.col("total_count_before")).alias("rows_delta"),
        (F.col("null_percentage_after") - F.col("null_percentage_before")).alias("null_percentage_delta"),
        (F.col("distinct_count_after") - F.col("distinct_count_before")).alias("distinct_delta"),
    )
