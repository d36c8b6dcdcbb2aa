"""Streams that append new files to a raw table and merge batches into a cleaned one."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from layerkit.functions.columns import as_list, sort_keys
from layerkit.operators.ordered import dedup_latest
from layerkit.operators.project import add_load_lineage
from layerkit.sources.changes import merge_table
from layerkit.sources.store import TableStore


def stream_folder(
    spark: SparkSession, folder: str, schema: T.StructType | str, fmt: str = "parquet", glob: str = "*",
    files_per_batch: int | None = None, **options,
) -> DataFrame:
    """Files of a folder as a stream, with the schema declared."""
    reader = spark.readStream.format(fmt).schema(schema).options(pathGlobFilter=glob, recursiveFileLookup=True, **options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def ingest_bronze(
    store: TableStore, stream: DataFrame, name: str, load_id: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append a stream of files to a raw table with lineage; each file is taken once.

    A batch is a load named after its checkpoint and number, so a batch that is
    replayed after a failure replaces its own rows.
    """
    if not name.startswith(store.RAW):
        raise ValueError(f"raw tables are named {store.RAW}...")
    owner = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def append(batch: DataFrame, batch_id: int) -> None:
        store.write_bronze(batch, name, f"stream-{owner}-{batch_id}")

    writer = add_load_lineage(stream, load_id).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def merge_silver(
    store: TableStore, stream: DataFrame, name: str, keys, order_by, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Merge each micro-batch into a cleaned table, the newest row per key winning.

    Beside each version of the table lies a note of the last batch that every
    checkpoint has brought to it. So a batch replayed after a failure changes
    nothing, and several streams, each with a checkpoint of its own, may feed one
    table.
    """
    keys, order = as_list(keys), sort_keys(order_by)
    owner = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def apply(batch: DataFrame, batch_id: int) -> None:
        before = store.state(name)
        notes = before.notes if before else {}
        if int(notes.get(owner, -1)) >= batch_id:
            return
        newest = dedup_latest(batch, keys, order)

        # Rows of earlier batches may be newer in their own order.
        def newer(target, source):
            older, same = F.lit(False), F.lit(True)
            for key in order:
                was, now = target(key.name), source(key.name)
                low, high = (now, was) if key.descending else (was, now)
                older = older | (same & F.coalesce(low < high, low.isNull() & high.isNotNull()))
                same = same & was.eqNullSafe(now)
            return older | same

        merge_table(store, name, newest, keys, update_when=newer, check=False, notes=notes | {owner: str(batch_id)}, before=before)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
