"""Scans."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from layerkit.functions.columns import col


def _reader(spark: SparkSession, schema, options: Mapping[str, object]):
    reader = spark.read.options(**options)
    return reader.schema(schema) if schema is not None else reader


def read_csv(spark: SparkSession, path, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header. Without a schema the types are inferred, which reads the data twice."""
    options = {"header": True, **options}
    if schema is None:
        options.setdefault("inferSchema", True)
    return _reader(spark, schema, options).csv(path)


def read_parquet(spark: SparkSession, path, merge_schema: bool = False) -> DataFrame:
    return spark.read.option("mergeSchema", merge_schema).parquet(path)


def read_json(spark: SparkSession, path, schema: T.StructType | str | None = None, **options) -> DataFrame:
    return _reader(spark, schema, options).json(path)


def read_xml(spark: SparkSession, path, row_tag: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    return _reader(spark, schema, {"rowTag": row_tag, **options}).format("xml").load(path)


def read_folder(
    spark: SparkSession,
    folder: str,
    glob: str = "*",
    fmt: str = "csv",
    schema: T.StructType | str | None = None,
    recursive: bool = True,
    **options,
) -> DataFrame:
    """All files of a folder whose name fits ``glob``, as one table."""
    options = {"pathGlobFilter": glob, "recursiveFileLookup": recursive, **options}
    if fmt == "csv":
        options.setdefault("header", True)
    return _reader(spark, schema, options).format(fmt).load(folder)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int | None = None,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A database table, read over ``partitions`` connections when a partition column is given.

    ``table`` may be a query in parentheses with an alias. Rows outside
    ``bounds`` are read too: the bounds only set where the ranges lie.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **(properties or {}))
    if partition_column is not None:
        if bounds is None or not partitions:
            raise ValueError("a partitioned read needs bounds and a number of partitions")
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]),
            numPartitions=partitions,
        )
    return reader.load()


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.table(name)


class Sources:
    """Named storage roots, so that paths in code stay relative."""

    def __init__(self, roots: Mapping[str, str]):
        self.roots = dict(roots)

    def path(self, key: str, relative: str) -> str:
        if key not in self.roots:
            raise KeyError(f"no source named {key}; known: {', '.join(sorted(self.roots))}")
        return f"{self.roots[key].rstrip('/')}/{relative.lstrip('/')}"


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """One row per file: path, folder, name, extension, size and time. Does not open the files."""
    path = F.col("path")
    name = F.substring_index(path, "/", -1)
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(folder)
    )
    return listed.select(
        path,
        F.left(path, F.length(path) - F.length(name)).alias("folder_path"),
        name.alias("name"),
        F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("extension"),
        F.col("modificationTime").alias("modified_at"),
        F.col("length").alias("size"),
    )


def read_since(df: DataFrame, column: str, value) -> DataFrame:
    """Rows strictly above a load watermark; the condition reaches the scan."""
    return df.filter(col(column) > (value if isinstance(value, Column) else F.lit(value)))


# A line that ends inside a quoted cell.
_OPEN_QUOTE = r'(^|,)\s*"([^"]|"")*$'


def _drop_head_lines(n: int, names: list[str] | None, strict: bool):
    """Drop the first ``n`` lines of every file; later blocks of a file pass through.

    ``head`` is the file's hash in its first block and 0 elsewhere. Rows of a
    block arrive together and in file order, as the scan gives them. With
    ``names`` the last line dropped is the header: it must give them in this
    order, or, unless ``strict``, at least not in another one.
    """

    def check(line: str) -> None:
        found = next(csv.reader([line]), [])
        if found != names and (strict or sorted(found) == sorted(names)):
            raise ValueError(f"a file has the columns {', '.join(found)}, not {', '.join(names)}")

    def drop(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = 0, 0
        for batch in batches:
            if pc.any(pc.match_substring_regex(batch.column(0), _OPEN_QUOTE)).as_py():
                raise ValueError("a quoted cell spans lines; read such files with read_csv and multiLine")
            head = np.asarray(batch.column(1))
            keep = np.ones(len(head), dtype=bool)
            edges = [0, *(np.flatnonzero(np.diff(head)) + 1), len(head)]
            for begin, end in zip(edges[:-1], edges[1:]):
                if begin == end:
                    continue
                if head[begin] != current:
                    current, seen = head[begin], 0
                if current != 0:
                    if names and seen < n <= seen + end - begin:
                        check(batch.column(0)[int(begin + n - 1 - seen)].as_py())
                    keep[begin : begin + max(0, min(n - seen, end - begin))] = False
                    seen += end - begin
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep))], names=["value"])

    return drop


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def read_csv_skip(
    spark: SparkSession, path, skip: int, schema: T.StructType | None = None, glob: str = "*", header: bool = True
) -> DataFrame:
    """CSV files with ``skip`` lines before the header, split and read in parallel.

    Without a schema the header of the first file names the columns, all text,
    and a file with another header raises as it is read. With a schema columns
    go by position, and a header that has its names in another order raises.
    Cells may not span lines; one that does raises. Nothing is shuffled.
    """
    strict = schema is None
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    if schema is None:
        first = list_files(spark, path, glob).orderBy("path").limit(1).collect()[0]["path"]
        top = spark.read.text(first).filter(F.col("_metadata.file_block_start") == 0).limit(skip + 1).collect()
        if len(top) <= skip:
            raise ValueError(f"{first} has no line after the first {skip}")
        names = next(csv.reader([top[skip][0]]))
        if not header:
            names = [f"col_{i}" for i in range(len(names))]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    head = F.when(F.col("_metadata.file_block_start") == 0, F.xxhash64("_metadata.file_path")).otherwise(F.lit(0))
    rows = lines.select("value", head.cast("bigint").alias("head")).mapInArrow(
        _drop_head_lines(skip + int(header), schema.names if header else None, strict), "value string"
    )
    return rows.filter(F.length(F.trim("value")) > 0).select(F.from_csv("value", _ddl(schema), {"escape": '"'}).alias("r")).select("r.*")
