"""Distinct rows and combined tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from layerkit.functions.columns import as_list


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def distinct_by(df: DataFrame, keys: str | Iterable[str]) -> DataFrame:
    """One row per key, whichever comes; use ``dedup_latest`` where the rows differ."""
    return df.dropDuplicates(as_list(keys))


def combine(tables: Iterable[DataFrame]) -> DataFrame:
    """Stack tables by column name; a column a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), list(tables))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: its name and number of rows."""
    return combine(
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    )
