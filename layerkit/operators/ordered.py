"""Operators that depend on row order.

None of them sends a whole table, or a whole group, through one task: global
positions come from a range partitioning whose partitions are numbered alone and
then shifted by the sizes of those before them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from layerkit.functions.columns import (
    SortKey, as_list, col, require, row_hash, sort_columns, sort_keys, unused_name,
)
from layerkit.session import estimated_bytes, stage, task_count

# Bytes that one task may take in when the tops of other tasks are merged. It picks
# the plan only: every plan follows the same total order and keeps the same rows.
TOP_BYTES = 1 << 30

# Bytes a scan gives one task, and the tasks assumed for a table of unknown size.
_SCAN_BYTES = 128 << 20
_UNKNOWN_TASKS = 10_000

# monotonically_increasing_id: partition number above, row number in it below.
_LOCAL_BITS = 33


def partition_no(tag: str):
    return F.shiftright(F.col(tag), _LOCAL_BITS)


def row_no(tag: str):
    return F.col(tag).bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))


def sort(df: DataFrame, order_by) -> DataFrame:
    """Sort by several keys; nulls come first ascending and last descending."""
    return df.orderBy(*sort_columns(sort_keys(order_by)))


def range_sorted(df: DataFrame, leading: list[str], order_by, partitions: int | None, label: str):
    """Stage ``df`` range-partitioned and sorted, with a tag giving each row's place.

    Ties end in a hash of the row, which spreads a hot order value over several
    partitions and makes the result repeatable.
    """
    n = partitions or task_count(df)
    tie, tag = unused_name(df, "__tie"), unused_name(df, "__tag")
    order = [*[col(c).asc_nulls_first() for c in leading], *sort_columns(sort_keys(order_by)), F.col(tie).asc()]
    placed = (
        df.withColumn(tie, row_hash(df))
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .drop(tie)
        .withColumn(tag, F.monotonically_increasing_id())
    )
    return stage(placed, label), tag


def add_index(
    df: DataFrame, name: str, order_by, start: int = 0, step: int = 1, partitions: int | None = None
) -> DataFrame:
    """Number all rows consecutively along ``order_by``.

    Sorts once by range, writes that, counts per partition, and adds to each row
    the size of all partitions before its own. Runs one job.
    """
    keys = sort_keys(order_by)
    require(df, [k.name for k in keys])
    placed, tag = range_sorted(df, [], keys, partitions, "index")
    sizes = placed.groupBy(partition_no(tag).alias("__p")).agg((F.max(row_no(tag)) + 1).alias("__n"))
    # As many rows as range partitions: one task and a broadcast hold them.
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("__p").alias("__part"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    position = F.col("__before") + row_no(tag)
    return placed.join(F.broadcast(offsets), partition_no(tag) == F.col("__part")).select(
        *[col(c) for c in df.columns], (position * step + start).cast("bigint").alias(name)
    )


def sequential_key(df: DataFrame, name: str, order_by, partitions: int | None = None) -> DataFrame:
    """Keys 1, 2, 3 ... along an explicit sort."""
    return add_index(df, name, order_by, start=1, partitions=partitions)


def _total(df: DataFrame, keys) -> tuple[DataFrame, list[SortKey], str]:
    """``df`` with a hash of the row, and the keys ended by it: a total order but for equal rows."""
    tie = unused_name(df, "__tie")
    return df.withColumn(tie, row_hash(df)), [*keys, SortKey(tie)], tie


def _row_bytes(df: DataFrame) -> int:
    """Bytes of a row as the planner reckons them."""
    return max(16, df._jdf.schema().defaultSize())


def _top(df: DataFrame, n: int, keys) -> DataFrame | None:
    """The first ``n`` rows by merging each task's first ``n``; none when that is too much for one task.

    With many tasks their tops are merged in groups first, whose number is the
    square root of the number of tasks.
    """
    size = estimated_bytes(df)
    tasks = _UNKNOWN_TASKS if size is None else max(1, size // _SCAN_BYTES)
    order, most = sort_columns(keys), TOP_BYTES // _row_bytes(df)
    if n * tasks <= most:
        return df.orderBy(*order).limit(n)
    groups = math.isqrt(tasks) + 1
    if n * groups > most:
        return None
    group, place = unused_name(df, "__group"), unused_name(df, "__place")
    # Any grouping of rows serves; that by scan task lets each task drop all but n rows before the shuffle.
    tops = df.withColumn(group, F.pmod(F.spark_partition_id(), F.lit(groups)))
    tops = tops.withColumn(place, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return tops.filter(F.col(place) <= n).drop(group, place).orderBy(*order).limit(n)


def first_n(df: DataFrame, n: int, order_by) -> DataFrame:
    """The first ``n`` rows along ``order_by``; ties go by a hash of the row, so the rows are the same each time."""
    keys = sort_keys(order_by)
    require(df, [k.name for k in keys])
    whole, total, tie = _total(df, keys)
    top = _top(whole, n, total)
    if top is not None:
        return top.drop(tie)
    place = unused_name(df, "__place")
    return add_index(df, place, keys).filter(F.col(place) < n).drop(place)


def last_n(df: DataFrame, n: int, order_by) -> DataFrame:
    """The last ``n`` rows along ``order_by``."""
    return first_n(df, n, [k.reversed() for k in sort_keys(order_by)])


def skip(df: DataFrame, n: int, order_by) -> DataFrame:
    """All rows but those that ``first_n`` gives.

    Finds the ``n``-th sort position with a top-k and filters behind it, so the
    table is neither sorted nor shuffled and the filter on the order reaches the
    scan. Ties go by a hash of the row; of rows equal to the last one that goes
    as many go as make up ``n``. Runs two small jobs.
    """
    if n <= 0:
        return df
    keys = sort_keys(order_by)
    require(df, [k.name for k in keys])
    whole, total, tie = _total(df, keys)
    head = _top(whole.select(*[col(k.name) for k in total]), n, total)
    if head is None:
        place = unused_name(df, "__place")
        return add_index(df, place, keys).filter(F.col(place) >= n).drop(place)
    edge = head.orderBy(*sort_columns([k.reversed() for k in total])).limit(1).collect()
    if not edge:
        return df

    behind, tied = F.lit(False), F.lit(True)
    for key, value in zip(total, edge[0]):
        value = F.lit(value).cast(whole.schema[key.name].dataType)
        behind = behind | (tied & key.follows(value))
        tied = tied & col(key.name).eqNullSafe(value)
    gone = head.filter(tied).count()
    left = whole.filter(tied).count() - gone
    rest = whole.filter(behind).drop(tie)
    # What is tied in everything is equal in everything.
    return rest.union(whole.filter(tied).limit(left).drop(tie)) if left else rest


def remove_last(df: DataFrame, n: int, order_by) -> DataFrame:
    """All rows but the last ``n`` along ``order_by``."""
    return skip(df, n, [k.reversed() for k in sort_keys(order_by)])


def promote_headers(df: DataFrame, order_by) -> DataFrame:
    """Take the first row along ``order_by`` as column names; empty ones keep the old name.

    Raises when the first place is tied, as then no row is the header. For files
    use ``read_csv_skip``, which finds the header at the scan.
    """
    keys = sort_keys(order_by)
    first = first_n(df, 2, keys).collect()
    if not first:
        return df
    if len({tuple(r[k.name] for k in keys) for r in first}) < len(first):
        raise ValueError(f"two rows share the first place along {', '.join(k.name for k in keys)}")
    header = first_n(df, 1, keys).first()
    names = [str(v) if v not in (None, "") else c for v, c in zip(header, df.columns)]
    return skip(df, 1, keys).toDF(*names)


def dedup_latest(df: DataFrame, keys: str | Iterable[str], order_by) -> DataFrame:
    """The newest row of each key: last along ``order_by``, which must be a total order.

    Spark keeps one row per key and task before the shuffle, so a hot key stays small.
    """
    keys = as_list(keys)
    require(df, keys)
    rank = unused_name(df, "__rank")
    newest = Window.partitionBy(*[col(k) for k in keys]).orderBy(
        *sort_columns([k.reversed() for k in sort_keys(order_by)])
    )
    return df.withColumn(rank, F.row_number().over(newest)).filter(F.col(rank) == 1).drop(rank)


def fill_down(
    df: DataFrame,
    columns: str | Iterable[str],
    order_by,
    partition_by: str | Iterable[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Replace nulls by the last value before them along ``order_by``, within ``partition_by``.

    The table is cut into ranges of the order, so that one long group spans many
    tasks. Each range fills itself; the first group of a range also takes over
    the value its earlier ranges ended with. Runs one job.
    """
    columns, groups = as_list(columns), as_list(partition_by)
    require(df, [*columns, *groups])
    placed, tag = range_sorted(df, groups, order_by, partitions, "fill")
    part = unused_name(df, "__part")
    placed = placed.withColumn(part, partition_no(tag))

    # Last value of each group in each range, then the last one of the ranges before.
    ends = placed.groupBy(part, *[col(g) for g in groups]).agg(
        *[F.max_by(col(c), F.when(col(c).isNotNull(), F.col(tag))).alias(f"__end{i}") for i, c in enumerate(columns)]
    )
    earlier = Window.partitionBy(*[col(g) for g in groups]).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        F.col(part).alias("__cpart"),
        *[col(g).alias(f"__g{i}") for i, g in enumerate(groups)],
        *[F.last(f"__end{i}", ignorenulls=True).over(earlier).alias(f"__carry{i}") for i in range(len(columns))],
    ).filter(F.greatest(*[F.col(f"__carry{i}").isNotNull() for i in range(len(columns))], F.lit(False)))

    # Only the first group of a range can go on from an earlier one: at most one row per range.
    same = F.col(part) == F.col("__cpart")
    for i, g in enumerate(groups):
        same = same & col(g).eqNullSafe(F.col(f"__g{i}"))
    within = (
        Window.partitionBy(part, *[col(g) for g in groups])
        .orderBy(tag)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    filled = placed.withColumns({c: F.last(col(c), ignorenulls=True).over(within) for c in columns})
    # One row per range at most, of any width: Spark broadcasts it where it is small.
    out = filled.join(carried, same, "left")
    carry = {c: F.coalesce(col(c), F.col(f"__carry{i}")) for i, c in enumerate(columns)}
    return out.select(*[carry.get(c, col(c)).alias(c) for c in df.columns])


def fill_up(
    df: DataFrame,
    columns: str | Iterable[str],
    order_by,
    partition_by: str | Iterable[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Replace nulls by the next value after them along ``order_by``."""
    back = [k.reversed() for k in sort_keys(order_by)]
    return fill_down(df, columns, back, partition_by, partitions)


def top_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The ``n`` most frequent non-null values, ties by value."""
    return first_n(
        df.filter(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("count")),
        n,
        [("count", "desc"), "value"],
    )
