"""Operator 1: token ids in files of patched frame-of-reference blocks.

A shard file holds the ids of a range of documents, one after the other, cut
into blocks. Each block stores its minimum, the differences packed at a width
that a given share of them fits into, and the others in an exception list. The
footer indexes where each block starts, and holds the document table.

Layout, all numbers little-endian::

    b"PFOR0001"
    block: u32 minimum, u8 width, u32 exceptions, packed low bits,
           u32 position of each exception, u32 high bits of each exception
    footer: u64 start of each block, i64 id and u8 present flag of each
            document, i64 length of each document
    u32 ids per block, u64 blocks, u64 documents, u64 ids, u64 footer start, b"PFOREND1"
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from layerkit.llm.common import blocks, crc32_of, partitions
from layerkit.llm.tokens import ChunkEncoder, default_tokenizer

MAGIC, END = b"PFOR0001", b"PFOREND1"
BLOCK = 1024
SHARE = 0.95
_HEAD = struct.Struct("<IBI")
_TAIL = struct.Struct("<IQQQQ8s")
# Blocks packed or unpacked in one go.
_RUN = 256


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Low ``width`` bits of each value of a row, packed; one row of bytes for each row."""
    bits = (values[:, :, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(data: np.ndarray, count: int, width: int) -> np.ndarray:
    bits = np.unpackbits(data, axis=1, count=count * width, bitorder="little").reshape(len(data), count, width)
    wide = np.zeros((len(data), count, 32), np.uint8)
    wide[:, :, :width] = bits
    return np.packbits(wide, axis=2, bitorder="little").view("<u4")[:, :, 0]


def pack_blocks(blocks: np.ndarray, share: float = SHARE) -> list[bytes]:
    """Each row of ids as one block. ``share`` of its differences fit the chosen width."""
    low = blocks.min(axis=1)
    diff = blocks - low[:, None]
    at = min(int(share * (blocks.shape[1] - 1)), blocks.shape[1] - 1)
    edge = np.partition(diff, at, axis=1)[:, at]
    widths = np.frexp(edge.astype(np.float64))[1]
    over = (diff.astype(np.uint64) >> widths[:, None].astype(np.uint64)).astype(np.uint32)
    packed: list[bytes] = [b""] * len(blocks)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        data = _pack(diff[rows], int(width)) if width else np.zeros((len(rows), 0), np.uint8)
        for i, row in zip(rows, data):
            places = np.flatnonzero(over[i])
            packed[i] = b"".join((
                _HEAD.pack(int(low[i]), int(width), len(places)), row.tobytes(),
                places.astype("<u4").tobytes(), over[i, places].astype("<u4").tobytes(),
            ))
    return packed


def unpack_blocks(data: bytes, starts: list[int], count: int) -> np.ndarray:
    """Blocks of ``count`` ids each that begin at ``starts`` in ``data``."""
    out = np.zeros((len(starts), count), np.uint32)
    heads = [_HEAD.unpack_from(data, s) for s in starts]
    widths = np.array([h[1] for h in heads])
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        size = (count * int(width) + 7) // 8
        if width:
            raw = np.stack([np.frombuffer(data, np.uint8, size, starts[i] + _HEAD.size) for i in rows])
            out[rows] = _unpack(raw, count, int(width))
        for i in rows:
            if n := heads[i][2]:
                at = starts[i] + _HEAD.size + size
                places = np.frombuffer(data, "<u4", n, at)
                out[i, places] |= np.frombuffer(data, "<u4", n, at + 4 * n) << np.uint32(width)
    return out + np.array([h[0] for h in heads], np.uint32)[:, None]


class ShardWriter:
    """Writes one shard to an open file, block by block."""

    def __init__(self, out, block: int = BLOCK, share: float = SHARE):
        self.out, self.block, self.share = out, block, share
        self.at, self.starts, self.ids = len(MAGIC), [], 0
        self.pending: list[np.ndarray] = []
        self.waiting = 0
        self.doc_ids: list[int | None] = []
        self.lengths: list[np.ndarray] = []
        out.write(MAGIC)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Append documents: their ids one after the other, and the number of each."""
        self.doc_ids += doc_ids
        self.lengths.append(np.asarray(lengths, "<i8"))
        self.ids += len(ids)
        self.pending.append(np.asarray(ids, np.uint32))
        self.waiting += len(ids)
        if self.waiting >= self.block * _RUN:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        whole = len(ids) // self.block * self.block
        rest = ids[whole:]
        if last and len(rest):  # the last block is filled up with its own minimum
            ids = np.concatenate([ids, np.full(self.block - len(rest), rest.min(), np.uint32)])
            whole, rest = len(ids), rest[:0]
        for at in range(0, whole, self.block * _RUN):
            run = ids[at : min(at + self.block * _RUN, whole)].reshape(-1, self.block)
            for data in pack_blocks(run, self.share):
                self.starts.append(self.at)
                self.at += len(data)
                self.out.write(data)
        self.pending, self.waiting = [rest], len(rest)

    def close(self) -> tuple[int, int]:
        """Write the footer; returns documents and ids."""
        self._flush(last=True)
        lengths = np.concatenate(self.lengths) if self.lengths else np.zeros(0, "<i8")
        self.out.write(np.array(self.starts, "<u8").tobytes())
        self.out.write(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
        self.out.write(np.array([d is not None for d in self.doc_ids], np.uint8).tobytes())
        self.out.write(lengths.tobytes())
        self.out.write(_TAIL.pack(self.block, len(self.starts), len(self.doc_ids), self.ids, self.at, END))
        return len(self.doc_ids), self.ids


class ShardReader:
    """Reads one shard from an open file that can seek."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - _TAIL.size)
        self.block, blocks, docs, self.n_ids, self.footer, end = _TAIL.unpack(source.read(_TAIL.size))
        if end != END:
            raise ValueError("not a complete token file")
        source.seek(self.footer)
        raw = source.read(size - _TAIL.size - self.footer)
        self.starts = np.frombuffer(raw, "<u8", blocks, 0).astype(np.int64)
        ids = np.frombuffer(raw, "<i8", docs, 8 * blocks)
        there = np.frombuffer(raw, np.uint8, docs, 8 * (blocks + docs))
        self.doc_ids = [int(d) if t else None for d, t in zip(ids, there)]
        self.lengths = np.frombuffer(raw[8 * blocks + 9 * docs :], "<i8", docs)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of blocks ``first`` to ``last - 1``, found by the index."""
        edges = np.append(self.starts, self.footer)
        self.source.seek(int(edges[first]))
        data = self.source.read(int(edges[last] - edges[first]))
        ids = unpack_blocks(data, (self.starts[first:last] - edges[first]).tolist(), self.block).reshape(-1)
        return ids[: self.n_ids - first * self.block]

    def document(self, index: int) -> np.ndarray:
        """Ids of one document, reading only its blocks."""
        start = int(self.lengths[:index].sum())
        n = int(self.lengths[index])
        if not n:
            return np.zeros(0, np.uint32)
        first = start // self.block
        ids = self.blocks(first, (start + n - 1) // self.block + 1)
        return ids[start - first * self.block :][:n]

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """Id, start in the shard, and the pieces of ids of each document, in order.

        Use up the pieces of a document before the next one. A piece lies in one
        run of blocks, so even a huge document never lies in memory whole.
        """
        run, held, first = -1, np.zeros(0, np.uint32), 0

        def pieces(start: int, n: int) -> Iterator[np.ndarray]:
            nonlocal run, held, first
            while n:
                if (want := start // (self.block * _RUN)) != run:
                    run, first = want, want * self.block * _RUN
                    held = self.blocks(want * _RUN, min((want + 1) * _RUN, len(self.starts)))
                piece = held[start - first :][:n]
                yield piece
                start, n = start + len(piece), n - len(piece)

        start = 0
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist()):
            yield doc_id, start, pieces(start, n)
            start += n


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int | None = 2,
    block: int = BLOCK, share: float = SHARE, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Encode whole texts and write them as shard files to ``folder``, in ascending order of id.

    ``folder`` must be reachable by all executors. Rows are dealt out by ranges of
    (id, hash of the text), so repeated ids spread too; a null id comes first, a
    null text is empty, and each row is a document of its own. ``end_id`` follows
    each document. A task writes its shard under a name of its own and renames it,
    so a task that runs again leaves the same file. No file is made for an empty
    range.

    The plan returns one row per shard (``shard``, ``path``, ``n_docs``,
    ``n_tokens``) and writes when it runs: stage it, then read the files.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    ordered = (
        docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(partitions(docs), F.col("doc_id"), F.col("tie"))
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        name, own = f"{root}/shard-{shard:07d}.pfor", f"{root}/.{uuid.uuid4().hex}"
        encoder = ChunkEncoder.at(tokenizer or default_tokenizer())
        end = np.array([] if end_id is None else [end_id], np.uint32)
        writer = out = None
        for batch in blocks(batches):
            if writer is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(own, compression=None, buffer_size=1 << 20)
                writer = ShardWriter(out, block, share)
            ids, lengths = encoder.encode(batch.column("text"))
            if len(end):
                ids = np.insert(ids, np.cumsum(lengths), end[0])
                lengths = lengths + 1
            writer.add(batch.column("doc_id").to_pylist(), ids, lengths)
        if writer is not None:
            n_docs, n_ids = writer.close()
            out.close()
            if store.get_file_info(name).type != fs.FileType.NotFound:
                store.delete_file(name)
            store.move(own, name)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/shard-{shard:07d}.pfor"], "n_docs": [n_docs], "n_tokens": [n_ids]})

    return ordered.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long")


def read_token_files(
    shards: DataFrame, schema: str = "ids array<long>", of: Callable[[Iterator[np.ndarray]], tuple] | None = None,
) -> DataFrame:
    """One row per document of the shards: ``doc_id``, ``start``, ``n_tokens`` and what ``of`` makes of its ids.

    ``start`` counts the ids of all documents before it, over all shards in
    order. ``of`` gets the pieces of a document's ids and returns the values of
    ``schema``; by default the ids themselves. Only the list of shards (one row
    per file) is ordered as a whole; each file is read by one task, run by run.
    """
    make = of or (lambda pieces: (np.concatenate([*pieces, np.zeros(0, np.uint32)]).tolist(),))
    names = [field.split()[0] for field in schema.split(", ")]
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    listed = shards.select("shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as source:
                    reader = ShardReader(source, source.size())
                    rows: list[tuple] = []
                    for (doc_id, start, pieces), n in zip(reader.documents(), reader.lengths.tolist()):
                        rows.append((doc_id, base + start, n, *make(pieces)))
                        if len(rows) == 1000:
                            yield _batch(rows, names)
                            rows = []
                    if rows:
                        yield _batch(rows, names)

    # One file is one task's work.
    return listed.repartition(max(1, shards.count())).mapInArrow(read, f"doc_id long, start long, n_tokens long, {schema}")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = dict(zip(["doc_id", "start", "n_tokens", *names], zip(*rows)))
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k)) for k, c in columns.items()], names=list(columns))


def ids_crc32(pieces: Iterator[np.ndarray]) -> tuple[int]:
    """Unsigned crc32 of a document's ids, piece by piece."""
    value = 0
    for piece in pieces:
        value = crc32_of(piece, value)
    return (value,)
