"""Grouping and reshaping."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from layerkit.functions.columns import SortKey, as_list, col, require, sort_keys

# Aggregates of the source language; an unknown name is "first".
AGGREGATES = {
    "List.Sum": "sum",
    "List.Average": "avg",
    "List.Min": "min",
    "List.Max": "max",
    "List.Count": "count",
    "List.Distinct": "distinct",
    "List.First": "first",
    "List.Last": "last",
    "Table.RowCount": "rows",
}


def _order_value(keys: Sequence[SortKey], df: DataFrame) -> Column:
    """Sort keys as one ordered value, smallest first."""
    parts = []
    for key in keys:
        c = col(key.name)
        if key.descending:
            kind = df.schema[key.name].dataType
            if isinstance(kind, T.NumericType):
                c = -c
            elif isinstance(kind, T.DateType):
                c = -F.unix_date(c)
            elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
                c = -F.unix_micros(c.cast("timestamp"))
            else:
                raise ValueError(f"first/last cannot run down a {kind.simpleString()} column; use dedup_latest")
        parts.append(c)
    return F.struct(*parts)


def aggregate(df: DataFrame, how: str, column: str | None = None, order_by=None, approximate: bool = False) -> Column:
    """One aggregate by name. ``first`` and ``last`` need ``order_by``."""
    how = AGGREGATES.get(how, how)
    if how == "rows":
        return F.count(F.lit(1))
    c = col(column)
    if how == "distinct":
        return F.approx_count_distinct(c) if approximate else F.count_distinct(c)
    simple = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}
    if how in simple:
        return simple[how](c)
    if order_by is None:
        raise ValueError(f"{how} needs order_by: a group has no row order of its own")
    order = _order_value(sort_keys(order_by), df)
    return F.max_by(c, order) if how == "last" else F.min_by(c, order)


def group(df: DataFrame, keys: str | Iterable[str] = (), aggregates: Mapping[str, object] | None = None) -> DataFrame:
    """Group by ``keys``; without aggregates count rows.

    A value of ``aggregates`` is a Column, ``(name, column)`` or
    ``(name, column, order_by)``. Without keys the whole table is one group.
    """
    keys = as_list(keys)
    require(df, keys)
    grouped = df.groupBy(*[col(k) for k in keys])
    if not aggregates:
        return grouped.agg(F.count(F.lit(1)).alias("count"))
    return grouped.agg(
        *[
            (spec if isinstance(spec, Column) else aggregate(df, *spec)).alias(name)
            for name, spec in aggregates.items()
        ]
    )


def _as_texts(df: DataFrame, values: list) -> list[str]:
    """Values as Spark writes them in texts and column names."""
    if not values:
        return []
    row = df.sparkSession.range(1).select(*[F.lit(v).cast("string") for v in values]).first()
    return list(row)


# Columns that a pivot over values found in the data makes at most, unless the caller says more.
MOST_PIVOTED = 2000


def pivot(
    df: DataFrame,
    column: str,
    value: str,
    values: Sequence | None = None,
    keys: Iterable[str] | None = None,
    how: str = "first",
    order_by=None,
    null_name: str = "null",
    most_values: int = MOST_PIVOTED,
) -> DataFrame:
    """Turn the values of ``column`` into columns.

    ``keys`` default to every other column. Without ``values`` they are found
    with one extra job; a null among them becomes the column ``null_name``. They
    may be ``most_values`` at most: no task passes on more of them and one, and a column that
    has more, such as a key taken by mistake, raises before any comes to the driver.
    ``first`` takes the smallest value of a cell unless ``order_by`` says otherwise.
    """
    require(df, [column, value])
    if keys is None:
        keys = [c for c in df.columns if c not in (column, value)]
    if values is None:
        # As many rows as the result gets columns, and one that tells of more.
        found = [r[0] for r in df.select(col(column)).distinct().limit(most_values + 1).collect()]
        if len(found) > most_values:
            raise ValueError(f"{column} has more than {most_values} values to pivot by; pass most_values for a wider result")
        values = sorted(v for v in found if v is not None)
        if None in found:
            if null_name in map(str, values) or null_name in keys:
                raise ValueError(f"{column} holds both null and {null_name!r}; pass another null_name")
            text = F.coalesce(col(column).cast("string"), F.lit(null_name))
            df, values = df.withColumn(column, text), [*_as_texts(df, values), null_name]
    how = AGGREGATES.get(how, how)
    if how == "first" and order_by is None:
        how = "min"
    cell = aggregate(df, how, value, order_by) if order_by else aggregate(df, how, value)
    return df.groupBy(*[col(k) for k in keys]).pivot(column, list(values)).agg(cell)


def unpivot(
    df: DataFrame,
    value_columns: Sequence[str],
    name: str = "Attribute",
    value: str = "Value",
    type: str | None = None,
    drop_nulls: bool = False,
) -> DataFrame:
    """Turn the named columns into rows of (``name``, ``value``); other columns repeat."""
    require(df, value_columns)
    ids = [c for c in df.columns if c not in value_columns]
    return unpivot_other(df, ids, name, value, type, drop_nulls)


def unpivot_other(
    df: DataFrame,
    keep: Sequence[str],
    name: str = "Attribute",
    value: str = "Value",
    type: str | None = None,
    drop_nulls: bool = False,
) -> DataFrame:
    """Turn all columns but ``keep`` into rows; ``type`` brings their values to one type first."""
    require(df, keep)
    rest = [c for c in df.columns if c not in keep]
    if type is not None:
        df = df.withColumns({c: col(c).cast(type) for c in rest})
    out = df.unpivot([col(c) for c in keep], [col(c) for c in rest], name, value)
    return out.filter(col(value).isNotNull()) if drop_nulls else out
