"""Profiles that grow with their table: one row of mergeable statistics per column and load.

A new load is profiled from its own rows alone. Its states lie beside those of
the loads before, and the profile of the whole table, or of any of its loads, is
an aggregate over states: the table itself is not read again.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from layerkit.functions.columns import as_list, col, require
from layerkit.profiling.profile import as_text, type_name

# Size of a distinct-value sketch: 16,384 registers, so a count is off by about 0.8 %.
SKETCH_BITS = 14
# Error of a distinct count that is exceeded about once in a thousand columns.
DISTINCT_ERROR = 0.03


def column_states(df: DataFrame, table: str, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per column: rows, values, sum, ends, lengths and a sketch of the distinct values.

    One scan and one aggregate; tasks pass on one state per column, and no value is shuffled.
    ``low`` and ``high`` are numbers, dates and times in seconds; ``first`` and ``last`` the ends of text columns.
    """
    names = df.columns if columns is None else as_list(columns)
    require(df, names)
    fields = [df.schema[n] for n in names]
    aggregates, rows = [], []
    for i, f in enumerate(fields):
        c, text, kind = col(f.name), as_text(f), type_name(f.dataType)
        plain = isinstance(f.dataType, T.StringType)
        moment = isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
        number = F.unix_micros(c.cast("timestamp")) / 1_000_000 if moment else c.cast("double") if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")
        own = {
            "present": F.count(c), "total": F.sum(F.lit(None).cast("double") if moment else number), "low": F.min(number), "high": F.max(number),
            "short": F.min(F.length(text)), "long": F.max(F.length(text)), "width": F.sum(F.length(text).cast("bigint")),
            "first": F.min(c) if plain else F.lit(None).cast("string"), "last": F.max(c) if plain else F.lit(None).cast("string"),
            "sketch": F.hll_sketch_agg(text, F.lit(SKETCH_BITS)),
        }
        aggregates += [a.alias(f"{m}{i}") for m, a in own.items()]
        rows.append(F.struct(
            F.lit(table).alias("table_name"), F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.lit(kind).alias("data_type"),
            F.col("rows"), *[F.col(f"{m}{i}").alias(m) for m in own],
        ))
    return df.agg(F.count(F.lit(1)).alias("rows"), *aggregates).select(F.inline(F.array(*rows)))


def add_load(df: DataFrame, table: str, load: str, path: str, columns: Iterable[str] | None = None) -> None:
    """Profile one load and keep its states under ``path``; a load of the same name is replaced."""
    states = column_states(df, table, columns).withColumn("load", F.lit(load))
    states.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(path)


def load_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged_profile(states: DataFrame) -> DataFrame:
    """Profile of all loads in ``states`` together, one row per column.

    ``distinct_estimate`` comes from the union of the sketches, so values that several loads hold count once; all
    else is exact. A column of other types in other loads has a row per type.
    """
    found = states.groupBy("table_name", "column_name", "data_type").agg(
        F.min("position").alias("position"), F.count(F.lit(1)).alias("loads"),
        F.sum("rows").alias("total_count"), F.sum("present").alias("non_null_count"),
        F.sum("total").alias("__total"), F.min("low").alias("min_value"), F.max("high").alias("max_value"),
        F.min("first").alias("min_text"), F.max("last").alias("max_text"),
        F.min("short").alias("min_length"), F.max("long").alias("max_length"), F.sum("width").alias("__width"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("__near"),
    )
    total, present = F.col("total_count"), F.col("non_null_count")
    return found.select(
        "table_name", "position", "column_name", "data_type", "loads", "total_count", "non_null_count",
        (total - present).alias("null_count"), F.try_divide((total - present) * 100.0, total).alias("null_percentage"),
        # An estimate may come out above the values there are.
        F.least("__near", present).alias("distinct_estimate"),
        F.try_divide(F.least("__near", present) * 100.0, total).alias("cardinality_estimate"),
        "min_value", "max_value", F.try_divide("__total", present).alias("avg_value"), "min_text", "max_text",
        "min_length", "max_length", F.try_divide(F.col("__width").cast("double"), present).alias("avg_length"),
    )
