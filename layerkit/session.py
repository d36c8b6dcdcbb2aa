"""Session helpers: settings, the shared working folder, and staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators count on. Skewed join partitions are split at
# run time even where that costs one more shuffle.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Whole workbooks travel to Python tasks as single values.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


# Shuffled bytes that one task takes in: behind a shuffle rows may grow thirtyfold, as by two hashed keys.
SHUFFLE_TASK_BYTES = 16 << 20
# Input bytes per partition of a shuffle, while there are few; a map task holds no rows for up to as many partitions.
_PARTITION_BYTES, _FEW_PARTITIONS = 256 << 10, 200

_ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
# Where the size that the session gave to a partition is kept.
_FILE_BYTES = "layerkit.fileBytes"


def _setting_bytes(spark: SparkSession, key: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`RUNTIME_SETTINGS` to a session, and :data:`SHUFFLE_TASK_BYTES` where it has more; return it."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    given = _setting_bytes(spark, _ADVISORY)
    if given > SHUFFLE_TASK_BYTES:
        spark.conf.set(_FILE_BYTES, str(given))
        spark.conf.set(_ADVISORY, str(SHUFFLE_TASK_BYTES))
    return spark


@contextmanager
def sized_files(spark: SparkSession) -> Iterator[None]:
    """While a table is written by rebalanced partitions: files as large as the session had them before :func:`configure`."""
    now, given = spark.conf.get(_ADVISORY), spark.conf.get(_FILE_BYTES, None)
    if given is None or now != str(SHUFFLE_TASK_BYTES):
        yield
        return
    spark.conf.set(_ADVISORY, given)
    try:
        yield
    finally:
        spark.conf.set(_ADVISORY, now)


def fit_shuffles(spark: SparkSession, size: int | None) -> None:
    """Let shuffles start with partitions by the bytes of a query's input; small ones are merged at run time.

    With a fixed number, what one task sorts and groups would grow with the
    input. Without a size, the session's number of partitions holds.
    """
    if size is None:
        spark.conf.unset(_INITIAL)
        return
    wanted = max(min(_FEW_PARTITIONS, size // _PARTITION_BYTES), size // SHUFFLE_TASK_BYTES)
    spark.conf.set(_INITIAL, str(max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions")))))


# Temporary folders of local-mode applications that name none.
_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor reaches, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder; on a cluster
    a machine-local folder would be lost with its machine, so that raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="layerkit-")
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for this application under the shared folder."""
    return f"{shared_dir(spark)}/layerkit/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame reading it back.

    Cuts the lineage, fixes non-deterministic columns for every later use, and
    survives the loss of executors. Runs one job. :func:`clear_scratch` frees
    the space once no result that reads it is needed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete everything this application has staged."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(
        f"{shared_dir(spark)}/layerkit/{spark.sparkContext.applicationId}"
    )
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate; none where it has no idea."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else None


# Bytes one task of a full sort should hold.
_TASK_BYTES = 256 << 20


def task_count(df: DataFrame) -> int:
    """Number of partitions for a full shuffle of ``df``: by size, but one per core at least."""
    size = estimated_bytes(df)
    if size is None:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(df.sparkSession.sparkContext.defaultParallelism, size // _TASK_BYTES)


def spread(df: DataFrame, tasks: int | None) -> DataFrame:
    """Rows dealt out to ``tasks`` tasks, where a scan would give its rows to fewer; without ``tasks``, as they are.

    For heavy work per row over few, large row groups. A table whose scan has
    as many tasks already is left alone, so at most ``tasks`` splits are shuffled.
    """
    size = estimated_bytes(df)
    split = _setting_bytes(df.sparkSession, "spark.sql.files.maxPartitionBytes")
    if not tasks or size is None or size >= tasks * split:
        return df
    return df.repartition(tasks)
