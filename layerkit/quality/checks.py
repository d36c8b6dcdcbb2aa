"""Checks on one table, between tables, and on a whole layer.

Every check gives one row ``(check, table_name, column_name, passed, observed,
expected)``. All per-row checks of a table share one aggregation over one scan;
a uniqueness check adds one grouping by its keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from layerkit.functions.columns import as_list, col, require
from layerkit.functions.types import spark_type
from layerkit.operators.joins import join_on

REPORT_COLUMNS = ["check", "table_name", "column_name", "passed", "observed", "expected"]


class CheckFailed(AssertionError):
    """Raised by :func:`assert_checks`."""


@dataclass(frozen=True)
class Check:
    name: str
    columns: tuple[str, ...]
    expected: str
    passes: Callable[[Column], Column]
    # Aggregate giving the observed value; none for a uniqueness check.
    observed: Column | None = None
    # Condition a failing row meets; none for checks on the table as a whole.
    bad_row: Column | None = field(default=None)

    @property
    def label(self) -> str:
        return ", ".join(self.columns)


def _count() -> Column:
    return F.count(F.lit(1)).cast("double")


def _no_bad_rows(name: str, column: str, bad: Column, expected: str) -> Check:
    return Check(name, (column,), expected, lambda seen: seen == 0, F.count_if(bad).cast("double"), bad)


def min_rows(n: int = 1) -> Check:
    return Check("min_rows", (), f">= {n}", lambda seen: seen >= n, _count())


def rows_between(low: int, high: int) -> Check:
    return Check("rows_between", (), f"{low}..{high}", lambda seen: seen.between(low, high), _count())


def row_drift(expected: int, tolerance: float = 0.20) -> Check:
    """Row count within ``tolerance`` of an earlier count; both bounds are cut to whole rows."""
    low, high = int(expected * (1 - tolerance)), int(expected * (1 + tolerance))
    return Check("row_drift", (), f"{low}..{high}", lambda seen: seen.between(low, high), _count())


def not_null(column: str) -> Check:
    return _no_bad_rows("not_null", column, col(column).isNull(), "0 nulls")


def null_share(column: str, limit: float = 0.10) -> Check:
    share = F.coalesce(F.try_divide(F.count_if(col(column).isNull()), F.count(F.lit(1))), F.lit(0.0))
    return Check(
        "null_share", (column,), f"<= {limit}", lambda seen: seen <= limit, share.cast("double"), col(column).isNull()
    )


def unique(*columns: str) -> Check:
    return Check("unique", tuple(columns), "0 duplicates", lambda seen: seen == 0)


def non_negative(column: str) -> Check:
    return _no_bad_rows("non_negative", column, col(column) < 0, ">= 0")


def in_range(column: str, low, high) -> Check:
    c = col(column)
    return _no_bad_rows("in_range", column, (c < F.lit(low)) | (c > F.lit(high)), f"{low}..{high}")


def accepted(column: str, values: Sequence) -> Check:
    shown = ", ".join(str(v) for v in values)
    return _no_bad_rows("accepted", column, ~col(column).isin(list(values)), f"in ({shown})")


def castable(column: str, type: str | T.DataType) -> Check:
    target = spark_type(type)
    bad = col(column).isNotNull() & col(column).try_cast(target).isNull()
    return _no_bad_rows("castable", column, bad, target.simpleString())


def rule(name: str, column: str, bad: Column, expected: str = "0 rows") -> Check:
    """A business rule, given as the condition that a bad row meets."""
    return _no_bad_rows(name, column, bad, expected)


def _report_row(check: str, table: str, column: str, passed: Column, observed: Column, expected: str) -> Column:
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(table).alias("table_name"),
        F.lit(column).alias("column_name"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        observed.alias("observed"),
        F.lit(expected).alias("expected"),
    )


def _finished(df: DataFrame, check: str, table: str, column: str, passed: Column, expected: str) -> DataFrame:
    return df.select(_report_row(check, table, column, passed, F.col("observed"), expected).alias("r")).select("r.*")


def run_checks(df: DataFrame, table: str, checks: Iterable[Check]) -> DataFrame:
    """Report of all checks on one table."""
    checks = list(checks)
    for check in checks:
        require(df, check.columns)
    shared = [c for c in checks if c.observed is not None]
    parts = []
    if shared:
        seen = df.agg(*[c.observed.alias(f"c{i}") for i, c in enumerate(shared)])
        rows = [
            _report_row(c.name, table, c.label, c.passes(F.col(f"c{i}")), F.col(f"c{i}"), c.expected)
            for i, c in enumerate(shared)
        ]
        parts.append(seen.select(F.inline(F.array(*rows))))
    for c in checks:
        if c.observed is None:
            sizes = df.groupBy(*[col(k) for k in c.columns]).agg(F.count(F.lit(1)).alias("n"))
            surplus = F.coalesce(F.sum("n") - F.count(F.lit(1)), F.lit(0)).cast("double")
            seen = sizes.agg(surplus.alias("observed"))
            parts.append(_finished(seen, c.name, table, c.label, c.passes(F.col("observed")), c.expected))
    return reduce(DataFrame.unionByName, parts)


def failing_rows(df: DataFrame, check: Check) -> DataFrame:
    """The rows that make a check fail."""
    if check.name == "unique":
        raise ValueError("use duplicates() for the rows behind a uniqueness check")
    if check.bad_row is None:
        raise ValueError(f"{check.name} is about the table, not about rows")
    return df.filter(check.bad_row)


def duplicates(df: DataFrame, keys: str | Iterable[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    keys = as_list(keys)
    return df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("row_count")).filter(F.col("row_count") > 1)


def _join_keys(left: DataFrame, fk: str, right: DataFrame, pk: str):
    sizes = left.groupBy(col(fk).alias("__fk")).agg(F.count(F.lit(1)).alias("__n"))
    keys = right.select(col(pk).alias("__pk")).distinct()
    return sizes, keys


def referential(df: DataFrame, table: str, links: Iterable[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Rows whose key a dimension lacks; links are ``(key, dimension, dimension key, dimension name)``.

    The table is counted per key before the join, so a frequent key costs one
    row. A null key counts as missing.
    """
    parts = []
    for fk, dimension, pk, name in links:
        sizes, keys = _join_keys(df, fk, dimension, pk)
        lost = sizes.join(keys, F.col("__fk") == F.col("__pk"), "left_anti")
        seen = lost.agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("double").alias("observed"))
        parts.append(_finished(seen, "referential", table, fk, F.col("observed") == 0, f"in {name}.{pk}"))
    return reduce(DataFrame.unionByName, parts)


def orphans(df: DataFrame, fk: str, dimension: DataFrame, pk: str) -> DataFrame:
    """Rows whose key the dimension lacks."""
    return join_on(df, dimension, fk, pk, "left_anti")


def has_types(df: DataFrame, table: str, types: Mapping[str, str | T.DataType]) -> DataFrame:
    """Compare column types with the expected ones; a missing column fails. Reads no data."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    rows = []
    for name, wanted in types.items():
        wanted = spark_type(wanted)
        same = actual.get(name) == wanted
        rows.append(("type", table, name, same, 0.0 if same else 1.0, wanted.simpleString()))
    return df.sparkSession.createDataFrame(
        rows, "check string, table_name string, column_name string, passed boolean, observed double, expected string"
    )


def _two_sides(left: DataFrame, left_value: Column, right: DataFrame, right_value: Column) -> DataFrame:
    both = left.agg(left_value.alias("a")).select("a", F.lit(None).cast("decimal(38,6)").alias("b"))
    return both.union(right.agg(right_value.alias("b")).select(F.lit(None).cast("decimal(38,6)"), "b")).agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")
    )


def same_rows(source: DataFrame, target: DataFrame, table: str) -> DataFrame:
    """Target has as many rows as its source; observed is the difference."""
    n = F.count(F.lit(1)).cast("decimal(38,6)")
    seen = _two_sides(source, n, target, n).select((F.col("b") - F.col("a")).cast("double").alias("observed"))
    return _finished(seen, "same_rows", table, "", F.col("observed") == 0, "as many rows as the source")


def totals_match(
    left: DataFrame, left_column: str, right: DataFrame, right_column: str, table: str, tolerance: float = 0.01
) -> DataFrame:
    """Two tables' totals differ by less than ``tolerance``."""

    def total(name):
        return F.sum(col(name).cast("decimal(28,6)")).cast("decimal(38,6)")

    seen = _two_sides(left, total(left_column), right, total(right_column)).select(
        F.abs(F.col("a") - F.col("b")).cast("double").alias("observed")
    )
    return _finished(seen, "totals_match", table, right_column, F.col("observed") < tolerance, f"< {tolerance}")


def grain_kept(raw: DataFrame, clean: DataFrame, keys: str | Iterable[str], table: str) -> DataFrame:
    """The cleaned table has one row per key of its source: nothing was aggregated away."""
    distinct = raw.select(*[col(k) for k in as_list(keys)]).distinct()
    return same_rows(distinct, clean, table).withColumns(
        {"check": F.lit("grain_kept"), "expected": F.lit("one row per source key")}
    )


def batch_statistics(df: DataFrame) -> DataFrame:
    """Rows, load batches, earliest and latest load of a raw table."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct("_load_id").alias("load_batches"),
        F.min("_load_timestamp").alias("earliest_load"),
        F.max("_load_timestamp").alias("latest_load"),
    )


def table_status(counts: DataFrame, expected_min: Mapping[str, int] | None = None) -> DataFrame:
    """FAIL for an empty table, WARN below its expected minimum, else PASS."""
    minimum = F.lit(0)
    for name, n in (expected_min or {}).items():
        minimum = F.when(F.col("table_name") == name, n).otherwise(minimum)
    return counts.withColumn(
        "status",
        F.when(F.col("row_count") == 0, "FAIL").when(F.col("row_count") < minimum, "WARN").otherwise("PASS"),
    )


def required_checks(layer: str, keys: Sequence[str] = (), surrogate_key: str | None = None) -> list[Check]:
    """Checks every table of a layer needs: raw, clean, dimension or fact.

    Type checks (raw, clean) and referential checks (fact) need further inputs:
    see :func:`has_types` and :func:`referential`.
    """
    if layer == "bronze":
        return [min_rows(1)]
    if layer == "silver":
        return [*[not_null(k) for k in keys], unique(*keys)]
    if layer == "dimension":
        key = surrogate_key or keys[0]
        return [unique(key), *[not_null(k) for k in dict.fromkeys([key, *keys])]]
    if layer == "fact":
        return [min_rows(1)]
    raise ValueError(f"unknown layer: {layer}")


def assert_checks(report: DataFrame) -> None:
    """Raise with every failed check; the report has one row per check."""
    failed = report.filter(~F.col("passed")).collect()
    if failed:
        raise CheckFailed(
            "; ".join(f"{r['table_name']}.{r['column_name']} {r['check']}: {r['observed']} (expected {r['expected']})" for r in failed)
        )
