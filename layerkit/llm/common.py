"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from layerkit.session import RUNTIME_SETTINGS, estimated_bytes, fit_shuffles

# Rows and bytes of one batch that travels to a Python task, so that a batch of
# very long texts stays small.
BATCH_ROWS = 2000
BATCH_BYTES = "8m"
_ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Settings for a session that runs these operators; returns the session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    fit_shuffles(spark, None)
    # Python workers on machines that hold this package at the same place find it there.
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([p for p in [*paths, _ROOT] if p])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


# What the operators remember in a Python worker, by operator, and the one at work.
_MEMORIES: dict[str, Callable[[], None]] = {}
_AT_WORK: list[str] = []


def remember(operator: str, forget: Callable[[], None]) -> None:
    """Name the way to free what an operator remembers from task to task."""
    _MEMORIES[operator] = forget


def begin(operator: str) -> None:
    """Free what other operators remember: a worker lives on from stage to stage, and serves one operator at a time."""
    if _AT_WORK != [operator]:
        for name, forget in _MEMORIES.items():
            if name != operator:
                forget()
        _AT_WORK[:] = [operator]
        pa.default_memory_pool().release_unused()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def partitions(df: DataFrame, task_bytes: int = 64 << 20) -> int:
    """Tasks for a full shuffle of ``df``: by its estimated size, and no fewer than the session's number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (estimated_bytes(df) or 0) // task_bytes)


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from fitting: crc32 of the id as text leaves no remainder by 5; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows at most, the same ones each time: those whose hash of ``key`` falls under a share.

    Runs one count. All rows are kept where there are no more than ``rows``.
    """
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(key.cast("string"), F.lit("sample")), F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; empty batches are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    return [b"" if t is None else t for t in batch.column(name).cast(pa.binary()).to_pylist()]


def whole_components(column: str, scale: int) -> Column:
    """A vector's components as floor(scale * component); null where it or one of its components is null or not finite."""
    wide = F.transform(F.col(column), lambda x: x.cast("double"))
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(wide, lambda x: F.floor(x * scale).cast("long")))


def matrix_of(lists: pa.ListArray, dims: int | None = None) -> np.ndarray:
    """Integer vectors as rows, as wide as ``dims`` or the longest; shorter ones end in zeros."""
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    dims = int(lengths.max(initial=0)) if dims is None else dims
    out = np.zeros((len(lists), dims), np.int64)
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lists)), lengths), within] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def widest(x: np.ndarray) -> int:
    """The largest absolute value, also where it is 2^63."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def crc32_of(ids: np.ndarray, start: int = 0) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"), start)


def blocks(batches: Iterator[pa.RecordBatch], size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``size`` bytes; empty ones are left out."""
    held, held_bytes = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        held_bytes += batch.nbytes
        if held_bytes >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, held_bytes = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def runs(texts: pa.Array, size: int = 1 << 20) -> Iterator[pa.Array]:
    """A text column in consecutive pieces of about ``size`` bytes, or of one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield texts.slice(start, stop - start)
        start = stop
