"""Filters, projections, value clean-up and column naming."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.storagelevel import StorageLevel

from layerkit.functions.columns import as_list, col, require, unused_name
from layerkit.functions.types import spark_type


def select_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Keep rows where ``condition`` is true; null drops the row."""
    return df.filter(condition)


def add_column(df: DataFrame, name: str, value, type: str | T.DataType | None = None) -> DataFrame:
    value = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(name, value.cast(spark_type(type)) if type is not None else value)


def case(branches: Iterable[tuple[Column, object]], default=None) -> Column:
    """First branch whose condition holds, else ``default``."""
    out = None
    for condition, value in branches:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    if out is None:
        return F.lit(default)
    return out.otherwise(default)


def rename(df: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    require(df, pairs)
    return df.withColumnsRenamed(dict(pairs))


def remove_columns(df: DataFrame, names: str | Iterable[str], strict: bool = False) -> DataFrame:
    names = as_list(names)
    if strict:
        require(df, names)
    return df.drop(*names)


def select_columns(df: DataFrame, names: str | Iterable[str]) -> DataFrame:
    names = as_list(names)
    require(df, names)
    return df.select(*[col(n) for n in names])


def cast_types(df: DataFrame, types: Mapping[str, str | T.DataType], on_error: str = "raise") -> DataFrame:
    """Cast many columns in one projection; ``on_error="null"`` turns bad values into nulls."""
    require(df, types)

    def cast(name, target):
        return col(name).try_cast(target) if on_error == "null" else col(name).cast(target)

    return df.withColumns({n: cast(n, spark_type(t)) for n, t in types.items()})


def duplicate_column(df: DataFrame, source: str, name: str | None = None) -> DataFrame:
    require(df, [source])
    return df.withColumn(name or f"{source}_copy", col(source))


def transform_columns(df: DataFrame, functions: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    require(df, functions)
    return df.withColumns({n: fn(col(n)) for n, fn in functions.items()})


def replace_value(df: DataFrame, old, new, columns: str | Iterable[str], mode: str = "value") -> DataFrame:
    """Replace in ``columns``.

    ``mode="text"`` replaces every literal occurrence inside a text,
    ``mode="value"`` replaces a whole value. With ``old=None`` nulls are filled,
    and empty texts too where the replacement is a text.
    """
    names = as_list(columns)
    require(df, names)

    def replaced(name):
        c = col(name)
        if old is None:
            if isinstance(new, str):
                return F.when(c.isNull() | (c == ""), F.lit(new)).otherwise(c)
            return F.coalesce(c, F.lit(new))
        if mode == "text":
            return F.replace(c, F.lit(old), F.lit(new))
        if mode == "value":
            return F.when(c == F.lit(old), F.lit(new)).otherwise(c)
        raise ValueError(f"unknown mode: {mode}")

    return df.withColumns({n: replaced(n) for n in names})


_KEEP = object()


def map_values(df: DataFrame, column: str, mapping: Mapping | DataFrame, default=_KEEP) -> DataFrame:
    """Decode values; without ``default`` an unmapped value stays as it is. A null may be a key.

    A long mapping comes as a table of two columns, old value and new one, with
    each old value once; it is joined, and by Spark's choice broadcast.
    """
    require(df, [column])
    c = col(column)
    if not isinstance(mapping, DataFrame):
        out = case([(c.eqNullSafe(F.lit(k)), F.lit(v)) for k, v in mapping.items()], c if default is _KEEP else default)
        return df.withColumn(column, out)
    if len(mapping.columns) != 2:
        raise ValueError("a mapping has two columns: old value and new one")
    old, new, found = (unused_name(df, n) for n in ("__old", "__new", "__found"))
    pairs = mapping.toDF(old, new).withColumn(found, F.lit(True))
    twice = pairs.groupBy(old).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"mapped twice: {twice[0][0]!r}")
    joined = df.join(pairs, c.eqNullSafe(col(old)), "left")
    other = c if default is _KEEP else F.lit(default)
    return joined.withColumn(column, F.when(col(found), col(new)).otherwise(other)).select(*[col(n) for n in df.columns])


def fill_nulls(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace nulls; raises where a value does not fit its column, which Spark would pass over."""
    require(df, values)
    for name, value in values.items():
        kind = df.schema[name].dataType
        fits = (
            isinstance(kind, T.BooleanType) if isinstance(value, bool)
            else isinstance(kind, T.NumericType) if isinstance(value, (int, float))
            else isinstance(kind, T.StringType) and isinstance(value, str)
        )
        if not fits:
            raise ValueError(f"{value!r} does not fit {name}, which is {kind.simpleString()}")
    return df.fillna(dict(values))


def _checked(df: DataFrame, names: list[str]) -> DataFrame:
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"two columns would both be named: {', '.join(clashes)}")
    return df.toDF(*names)


def snake_name(name: str) -> str:
    """Words in lower case, joined by ``_``: a word ends at white space or before a capital behind a small letter."""
    words, last = [""], ""
    for ch in name:
        if ch.isspace():
            words.append("")
        elif ch == "_" or (ch.isascii() and ch.isalnum()):
            if ch.isupper() and last.islower():
                words.append("")
            words[-1] += ch.lower()
        else:
            continue  # other signs vanish, and what stood beside them meets
        last = ch
    return "_".join(filter(None, words)).strip("_")


def snake_case(df: DataFrame) -> DataFrame:
    """Rename every column to snake_case; raises when two names collide."""
    return _checked(df, [snake_name(n) for n in df.columns])


# What each symbol becomes in a database-safe name.
SYMBOL_WORDS = {
    " ": "_", "-": "_", "(": "", ")": "", "[": "", "]": "",
    "{": "", "}": "", "/": "_", "\\": "_", ".": "_", ",": "",
    "&": "and", "%": "pct", "#": "num", "@": "at", "$": "dollar",
    "+": "plus", "=": "eq", "*": "", "?": "", "!": "", "'": "",
    '"': "", ":": "_", ";": "_", "<": "lt", ">": "gt",
}


def safe_name(name: str) -> str:
    """Database-safe identifier: symbols in words, single underscores, no leading digit."""
    spelled = str(name).translate(str.maketrans(SYMBOL_WORDS))
    kept = "".join(ch for ch in spelled if ch == "_" or (ch.isascii() and ch.isalnum()))
    joined = "_".join(part for part in kept.split("_") if part) or "column"
    return ("_" + joined if joined[0].isdigit() else joined).lower()


def safe_names(df: DataFrame) -> DataFrame:
    return _checked(df, [safe_name(n) for n in df.columns])


def name_mapping(df: DataFrame) -> DataFrame:
    """One row per column: its name, its database-safe name, and whether they differ."""
    rows = [(i, n, safe_name(n), n != safe_name(n)) for i, n in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(
        rows, "position int, original_name string, safe_name string, changed boolean"
    )


# Names of the lineage columns.
RAW_LINEAGE = ["_load_timestamp", "_source_file", "_load_id"]


def add_load_lineage(df: DataFrame, load_id: str, source: str | Column | None = None, loaded_at: Column | None = None):
    """Add load time, source file and load id; the file defaults to the one the row came from."""
    if source is None:
        source = F.col("_metadata.file_path")
    elif isinstance(source, str):
        source = F.lit(source)
    return df.select(
        "*",
        (loaded_at if loaded_at is not None else F.current_timestamp()).alias("_load_timestamp"),
        source.alias("_source_file"),
        F.lit(load_id).alias("_load_id"),
    )


def to_clean_lineage(df: DataFrame, load_id: str, built_at: Column | None = None) -> DataFrame:
    """Swap the raw lineage columns for those of the cleaned layer."""
    return df.drop(*RAW_LINEAGE).withColumns(
        {
            "_silver_timestamp": built_at if built_at is not None else F.current_timestamp(),
            "_load_id": F.lit(load_id),
        }
    )


def buffer(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Keep a table that is used more than once; the caller unpersists it."""
    return df.persist(level)


def tidy(
    df: DataFrame,
    names: Iterable[str] = (),
    emails: Iterable[str] = (),
    money: Iterable[str] = (),
    keys: Iterable[str] = (),
) -> DataFrame:
    """Usual clean-ups: title-case names, lower-case e-mails, decimal money, no null keys."""
    changes = {n: F.initcap(F.trim(col(n))) for n in names}
    changes |= {n: F.lower(F.trim(col(n))) for n in emails}
    changes |= {n: col(n).cast(T.DecimalType(18, 2)) for n in money}
    out = df.withColumns(changes) if changes else df
    for key in keys:
        out = out.filter(col(key).isNotNull())
    return out
