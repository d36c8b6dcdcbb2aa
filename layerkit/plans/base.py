"""Registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from layerkit.session import configure, estimated_bytes, fit_shuffles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The Parquet tables of one folder, by attribute: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.sizes: dict[str, int] = {}

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        # Shuffles fit all tables that the query has read so far.
        self.sizes[name] = estimated_bytes(df) or 0
        fit_shuffles(self.spark, sum(self.sizes.values()))
        return df


def query(sql: str | None = None, name: str | None = None):
    """Register a function of :class:`Tables` under its name, with its SQL twin if it has one."""

    def register(fn: Callable[[Tables], DataFrame]):
        key = name or fn.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(configure(spark), folder))

        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn

    return register


def exact_sum(c: Column) -> Column:
    """Sum of money in cents, so that the order of rows cannot change the last digit."""
    return F.sum(c.cast("decimal(18,2)")).cast("double")
