"""Links between texts whose sets of word shingles are alike, for near-duplicates that fingerprints lie too far apart for.

The shingles of a text are dealt by hash into buckets, whose number follows from
the size of the set. Where two sets differ in few shingles, many buckets hold the
same ones: each bucket's content is a signature, texts that share a signature are
candidates, and every candidate pair is measured exactly. A passage that many
texts share fills no bucket alone, so it makes no candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from layerkit.llm.common import begin, blocks, map_arrow, partitions, texts_of
from layerkit.session import stage

# Words of a shingle, and the least share of shingles that two texts of a link have in common, as a fraction.
WORDS, SIMILAR = 5, (4, 5)
# Buckets of a set at least, and shingles of a bucket in the smallest set of a level.
LEAST_BUCKETS, FILL = 32, 4
# Orders in which the texts of a signature stand, and those of a block that meet the ones of other blocks.
_ORDERS, _SENT = 8, 3
_SKETCH = 64
# Bytes of text whose signatures are worked out at once, and rows of one batch that goes out.
_BLOCK_BYTES, _ROWS = 4 << 20, 1 << 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles of a text, ascending. Fewer words are one shingle; no word is none."""
    found = np.fromiter(map(xxhash.xxh64_intdigest, text.translate(_LOWER).split()), np.uint64)
    if not len(found):
        return found
    n = max(1, len(found) - words + 1)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(words, len(found))):
            total = total * _ODD + found[i : i + n]
    return np.unique(mixed(total))


def node_of(shingles: np.ndarray) -> int:
    """One number for a set; equal sets have the same, and the empty one zero."""
    if not len(shingles):
        return 0
    with np.errstate(over="ignore"):
        whole = np.bitwise_xor.reduce(mixed(shingles + _ODD)) + _ODD * np.uint64(len(shingles))
        return int(mixed(np.array([whole]))[0])


def sketch_of(shingles: np.ndarray) -> bytes:
    """A byte for each of 64 ranges of hashes: a hash of the smallest shingle in it, zero where it has none."""
    out = np.zeros(_SKETCH, np.uint8)
    at, first = np.unique(shingles >> np.uint64(64 - 6), return_index=True)
    out[at.astype(np.int64)] = (mixed(shingles[first]) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return out.tobytes()


def may_be_alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs of sketches, as rows, leave it open that the sets are alike.

    The share of equal bytes among those that are not both zero is about the sets' share in common; pairs more
    than four standard deviations below the threshold, one in 30,000 of those right at it, are ruled out.
    """
    used = ((a > 0) | (b > 0)).sum(axis=1)
    equal = ((a == b) & (a > 0)).sum(axis=1)
    share = SIMILAR[0] / SIMILAR[1]
    return equal >= share * used - 4 * np.sqrt(share * (1 - share) * used)


def signatures(shingles: np.ndarray) -> np.ndarray:
    """A number for the content of every bucket that is not empty.

    A set of 2^k to 2^(k+1) shingles has the buckets of level k; one that may be alike to a set below 2^k has
    those of level k - 1 too. Two alike sets therefore share a level.
    """
    n = len(shingles)
    if not n:
        return np.zeros(0, np.uint64)
    level = n.bit_length() - 1
    levels = [level] + ([level - 1] if level and SIMILAR[0] * n < SIMILAR[1] << level else [])
    out = []
    with np.errstate(over="ignore"):
        weighed = mixed(shingles + np.uint64(7))
        for k in levels:
            buckets = max(LEAST_BUCKETS, (1 << k) // FILL)
            at = ((shingles >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            # Ascending hashes lie in ascending buckets.
            starts = np.flatnonzero(np.diff(at, prepend=np.uint64(1 << 62)))
            sums = np.add.reduceat(weighed, starts)
            out.append(mixed(sums + at[starts] * _ODD + np.uint64(k << 48)))
    return np.concatenate(out)


def in_order(signature: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by signature and order, and for each the place in them of the first of its signature."""
    with np.errstate(over="ignore"):
        rank = mixed(node.astype(np.uint64) ^ mixed(signature % np.uint64(_ORDERS)))
    order = np.lexsort((rank, signature))
    return order, _starts(signature[order])


def _fitting(node: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct pairs of nodes, the smaller first, from pairs of positions whose sizes allow a link."""
    low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    fits = (SIMILAR[1] * low >= SIMILAR[0] * high) & (node[a] != node[b])
    return np.unique(np.stack([np.minimum(node[a], node[b])[fits], np.maximum(node[a], node[b])[fits]], axis=1), axis=0)


def _starts(signature: np.ndarray) -> np.ndarray:
    """For each of some sorted numbers the position of the first equal one."""
    fresh = np.ones(len(signature), bool)
    fresh[1:] = signature[1:] != signature[:-1]
    return np.maximum.accumulate(np.where(fresh, np.arange(len(signature)), 0))


def candidate_pairs(sent: DataFrame) -> DataFrame:
    """Distinct pairs ``a`` < ``b`` of nodes from rows (``signature``, ``node``, ``size``) of all blocks.

    A text is paired with the first of its signature and with the one before it: two pairs at most, however many
    share it. Up to three texts of a signature give all pairs; more give a chain and a star, whose centre is another
    one in each of eight orders. Each task goes through its rows, sorted by signature, in batches; what it needs of
    the batch before is the first and the last row. No group is collected.
    """
    rank = F.xxhash64("node", F.pmod("signature", F.lit(_ORDERS)))
    placed = sent.repartition(partitions(sent), "signature").sortWithinPartitions("signature", rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("shingle_links")
        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            signature, node, size = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("signature", "node", "size"))
            if carried is not None:
                signature, node, size = (np.concatenate([c, v]) for c, v in zip(carried, (signature, node, size)))
            starts = _starts(signature)
            at = np.flatnonzero(starts < np.arange(len(signature)))
            pairs = _fitting(node, size, np.append(at, at), np.append(starts[at], at - 1))
            ends = [int(starts[-1]), len(signature) - 1]
            carried = [v[ends[: 1 if ends[0] == ends[1] else 2]] for v in (signature, node, size)]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])

    return placed.mapInArrow(run, "a long, b long").distinct()


def described(docs: DataFrame, kept: list[str], extra: dict) -> DataFrame:
    """One pass over the texts: rows about texts, rows of signatures and candidate pairs, told apart by ``kind``.

    ``docs`` has ``text`` and the columns ``kept``. A row of kind 0 has these, the values of ``extra`` ({name: (type,
    function of a text)}), ``node``, ``size`` and ``sketch``; kind 1 a ``signature`` with ``node`` and ``size``; kind 2 a pair ``node``, ``other``.
    Texts of one block meet at once, so a signature that many of them share leaves the block three times at most.
    """
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields if f.name in kept}
    fields |= {name: kind for name, (kind, _) in extra.items()}
    fields |= {"kind": "int", "node": "bigint", "size": "int", "signature": "bigint", "other": "bigint", "sketch": "binary"}
    schema = ", ".join(f"`{n}` {k}" for n, k in fields.items())
    arrow = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}

    def rows(batch: pa.RecordBatch | None, kind: int, n: int, **columns) -> pa.RecordBatch:
        out = []
        for name, text in fields.items():
            if name == "kind":
                out.append(pa.array(np.full(n, kind), pa.int32()))
            elif name in columns:
                out.append(pa.array(columns[name], arrow[text]))
            elif batch is not None and name in kept:
                out.append(batch.column(name))
            else:
                out.append(pa.nulls(n, types[name]))
        return pa.RecordBatch.from_arrays(out, names=list(fields))

    types = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("shingle_links")
        for block in blocks(batches, _BLOCK_BYTES):
            types.update({n: block.schema.field(n).type if n in kept else arrow[k] for n, k in fields.items()})
            texts = texts_of(block)
            sets = [shingle_set(t) for t in texts]
            node = np.array([node_of(s) for s in sets], np.uint64).view(np.int64)
            size = np.array([len(s) for s in sets], np.int64)
            yield rows(block, 0, len(texts), node=node, size=size, sketch=[sketch_of(s) for s in sets], **{name: [fn(t) for t in texts] for name, (_, fn) in extra.items()})
            _, first = np.unique(node, return_index=True)
            found = [signatures(sets[i]) for i in first]
            del sets
            counts = [len(s) for s in found]
            signature = np.concatenate([np.zeros(0, np.uint64), *found])
            its_node, its_size = np.repeat(node[first], counts), np.repeat(size[first], counts)
            order, starts = in_order(signature, its_node)
            signature, its_node, its_size = signature[order], its_node[order], its_size[order]
            place = np.arange(len(order)) - starts
            at = np.flatnonzero(place)
            pairs = _fitting(its_node, its_size, np.append(at, at), np.append(starts[at], at - 1))
            if len(pairs):
                yield rows(None, 2, len(pairs), node=pairs[:, 0], other=pairs[:, 1])
            if len(order):
                sent = np.flatnonzero(place < _SENT)
                for at in range(0, len(sent), _ROWS):
                    part = sent[at : at + _ROWS]
                    yield rows(None, 1, len(part), node=its_node[part], size=its_size[part], signature=signature[part].view(np.int64))

    return docs.select(*kept, "text").mapInArrow(run, schema)


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The ``pairs`` that sketches (``node``, ``sketch``) leave open: far smaller rows than sets, which only these need."""
    left, right = (sketches.select(F.col("node").alias(n), F.col("sketch").alias(f"s{n}")) for n in ("a", "b"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sides = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, _SKETCH) for c in ("sa", "sb")]
        return batch.select(["a", "b"]).filter(pa.array(may_be_alike(*sides)))

    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb"), run, "a long, b long")


def alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose sets are alike; ``texts`` has ``node`` and ``text``, one row for each node needed."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        begin("shingle_links")
        sets = [(shingle_set(t) >> np.uint64(1)).view(np.int64) for t in texts_of(batch)]
        lists = pa.ListArray.from_arrays(np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32), pa.array(np.concatenate(sets), pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "shingles"])

    sets = stage(map_arrow(texts, run, "node long, shingles array<bigint>"), "shingle-sets")
    left, right = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"s{n}")) for n in ("a", "b"))
    both = F.size(F.array_intersect("sa", "sb"))
    # Share of the union: both / (sizes - both) against the fraction, in whole numbers.
    held = (SIMILAR[0] + SIMILAR[1]) * both >= SIMILAR[0] * (F.size("sa") + F.size("sb"))
    return pairs.join(left, "a").join(right, "b").where(held).select("a", "b")
