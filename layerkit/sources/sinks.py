"""Partitioned and clustered writes, exports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from layerkit.functions.columns import as_list, col, require, row_hash, unused_name
from layerkit.session import sized_files, stage


def write_partitioned(df: DataFrame, path: str, columns: str | Iterable[str], mode: str = "overwrite") -> None:
    """Write one folder per value. Spark evens out the tasks: small values share one, a big one is split."""
    columns = as_list(columns)
    require(df, columns)
    with sized_files(df.sparkSession):
        df.hint("rebalance", *[col(c) for c in columns]).write.mode(mode).partitionBy(*columns).parquet(path)


def export_csv(df: DataFrame, path: str, limit: int | None = None) -> None:
    """Write CSV with a header, in parallel; ``limit`` is for extracts."""
    out = df.limit(limit) if limit is not None else df
    out.write.option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def clustered(df: DataFrame, columns: str | Iterable[str], files: int) -> DataFrame:
    """Rows arranged so that each of ``files`` files holds one range of ``columns``."""
    columns = as_list(columns)
    require(df, columns)
    tie = unused_name(df, "__tie")
    order = [col(c).asc() for c in columns]
    # The hash lets a value too frequent for one file spread over several.
    return (
        df.withColumn(tie, row_hash(df)).repartitionByRange(files, *order, F.col(tie).asc())
        .sortWithinPartitions(*order).drop(tie)
    )


def recluster(df: DataFrame, path: str, columns: str | Iterable[str], files: int) -> DataFrame:
    """Compact and cluster a table into a new folder."""
    clustered(df, columns, files).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def recluster_partitions(
    spark: SparkSession, path: str, partition_by: str | Iterable[str], predicate: Column,
    columns: str | Iterable[str], files: int,
) -> None:
    """Compact and cluster the partitions that ``predicate`` picks, leaving the others untouched.

    ``predicate`` may only use partition columns. The rows are staged first,
    because a folder cannot be read and overwritten at once.
    """
    partition_by = as_list(partition_by)
    picked = stage(spark.read.parquet(path).filter(predicate), "recluster")
    arranged = clustered(picked, [*partition_by, *as_list(columns)], files)
    arranged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


# Bits of a rank at most, those of them that a tree of comparisons settles, and values a column's ranges are drawn from.
_RANK_BITS, _TREE_BITS, _RANGE_SAMPLE = 12, 5, 50_000


def _ranges(df: DataFrame, columns: list[str], bits: int) -> dict[str, list]:
    """For each column up to 2^bits - 1 values, ascending, that part it into ranges of about equal rows.

    They come from a sample of rows whose size does not grow with the table. They decide the layout alone: no row
    and no value depends on them.
    """
    n = df.count()
    picked = df.select(*[col(c) for c in columns]) if n <= _RANGE_SAMPLE else df.select(*[col(c) for c in columns]).where(
        F.pmod(F.xxhash64(*[col(c) for c in columns], F.monotonically_increasing_id()), F.lit(n)) < _RANGE_SAMPLE
    )
    lists = picked.agg(*[F.sort_array(F.collect_list(col(c))).alias(f"c{i}") for i, c in enumerate(columns)])
    places = [F.array(*[F.get(F.col(f"c{i}"), (F.size(f"c{i}") * k / (1 << bits)).cast("int")) for k in range(1, 1 << bits)]).alias(f"r{i}") for i in range(len(columns))]
    row = lists.select(*places).first()
    out = {}
    for i, c in enumerate(columns):
        kept = []
        for v in row[f"r{i}"]:
            if v is not None and v == v and (not kept or v != kept[-1]):
                kept.append(v)
        out[c] = kept
    return out


def _rank(c: Column, bounds: list, kind: T.DataType) -> Column:
    """How many of the ascending ``bounds`` a value reaches; a null reaches none.

    A tree of comparisons finds the group of bounds, a filter over its few counts the rest.
    """
    literal = lambda v: F.lit(v).cast(kind)
    if not bounds:
        return F.lit(0)
    step = max(1, -(-len(bounds) // (1 << _TREE_BITS)))
    heads = list(range(0, len(bounds), step))

    def within(at: int) -> Column:
        rest = bounds[at : at + step]
        if len(rest) == 1:
            return F.when(c >= literal(rest[0]), at + 1).otherwise(at)
        return F.lit(at) + F.size(F.filter(F.array(*map(literal, rest)), lambda b: b <= c))

    def tree(low: int, high: int) -> Column:
        if high - low == 1:
            return within(heads[low])
        middle = (low + high) // 2
        return F.when(c < literal(bounds[heads[middle]]), tree(low, middle)).otherwise(tree(middle, high))

    return F.when(c.isNull(), 0).otherwise(tree(0, len(heads)))


def interleaved(ranks: list[Column], bits: int) -> Column:
    """Morton key: the bits of all ranks by turns, the highest first."""
    key = F.lit(0).cast("long")
    for b in range(bits):
        for j, rank in enumerate(ranks):
            bit = F.shiftright(rank.cast("long"), b).bitwiseAND(F.lit(1))
            key = key.bitwiseOR(F.shiftleft(bit, b * len(ranks) + len(ranks) - 1 - j))
    return key


def z_clustered(df: DataFrame, columns: str | Iterable[str], files: int) -> DataFrame:
    """Rows arranged so that each of ``files`` files is narrow in every one of ``columns``.

    Each column is cut into ranges of equal rows; the ranks of a row's ranges are interleaved bit by bit, and
    files are cut along that key. A filter on any of the columns then skips files, where sorting by several
    columns serves the first alone. With k columns a file covers about the k-th root of the files' share of each.
    Nulls lie with the smallest values; a value too frequent for one file spreads by a hash of the row.
    """
    columns = as_list(columns)
    require(df, columns)
    if len(columns) * 2 > 60:
        raise ValueError("too many columns to cluster by")
    bits = min(_RANK_BITS, 60 // len(columns), max(1, -(-files.bit_length() // len(columns)) + 2))
    bounds = _ranges(df, columns, bits)
    key, tie = unused_name(df, "__key"), unused_name(df, "__tie")
    ranks = [_rank(col(c), bounds[c], df.schema[c].dataType) for c in columns]
    placed = df.withColumns({tie: row_hash(df), key: interleaved(ranks, bits)})
    return placed.repartitionByRange(files, F.col(key), F.col(tie)).sortWithinPartitions(key, *[col(c) for c in columns]).drop(key, tie)


def z_recluster(df: DataFrame, path: str, columns: str | Iterable[str], files: int) -> DataFrame:
    """Compact a table into a new folder, clustered by all of ``columns`` at once."""
    z_clustered(df, columns, files).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def file_pruning(df: DataFrame, probes: dict) -> DataFrame:
    """For each probed column (``{column: value}``) the rows and files of a table, and how many files its ends exclude."""
    ends = [f for i, c in enumerate(probes) for f in (F.min(col(c)).alias(f"low{i}"), F.max(col(c)).alias(f"high{i}"))]
    held = df.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"), *ends)
    shares = []
    for i, (c, v) in enumerate(probes.items()):
        v = v if isinstance(v, Column) else F.lit(v)
        outside = (v < F.col(f"low{i}")) | (v > F.col(f"high{i}")) | F.col(f"low{i}").isNull()
        shares.append(F.struct(F.lit(c).alias("column_name"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("files"), F.count_if(outside).alias("excluded")))
    return held.agg(F.array(*shares).alias("found")).select(F.inline("found"))
