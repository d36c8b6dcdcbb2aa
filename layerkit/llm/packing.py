"""Operator 7: best-fit packing by bin completion with branch and bound.

Only how many pieces there are of each length decides how well they pack, and
there are no more lengths than a sequence has places. So the plan is made from
that histogram: a filling of a sequence is chosen once and used as often as the
counts allow. The pieces then find their places by their rank among the pieces
of their length, without any group of pieces coming together in one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from layerkit.llm.common import blocks, crc32_of
from layerkit.llm.tokens import ChunkEncoder, default_tokenizer
from layerkit.session import stage

CAPACITY = 2048
# Search steps for the fillings of one sequence, fillings kept for it, and
# fillings tried in all; beyond them the best plan so far stands.
FILL_STEPS, FILLINGS, NODES = 2000, 16, 20_000
_DEEP = 60

# A plan: how often a filling is used, and its lengths from the largest on.
Plan = list[tuple[int, tuple[int, ...]]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by the sum of lengths, and by lengths that cannot share one."""
    total = sum(k * n for k, n in counts.items())
    best = -(-total // capacity)
    for small in sorted({k for k in counts if 2 * k <= capacity} | {0}):
        alone = sum(n for k, n in counts.items() if k > capacity - small)
        half = [(k, n) for k, n in counts.items() if k <= capacity - small and 2 * k > capacity]
        rest = sum(k * n for k, n in counts.items() if small <= k and 2 * k <= capacity)
        spare = sum(n for _, n in half) * capacity - sum(k * n for k, n in half)
        best = max(best, alone + sum(n for _, n in half) + max(0, -(-(rest - spare) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over a histogram: each length goes where the least room is left."""
    open_: dict[int, Counter] = {}  # room left -> fillings
    rooms: list[int] = []

    def put(room: int, filling: tuple[int, ...], n: int) -> None:
        if room not in open_:
            open_[room] = Counter()
            insort(rooms, room)
        open_[room][filling] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                filling, n = open_[room].popitem()
                used = min(n, left)
                if n > used:
                    open_[room][filling] = n - used
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
                put(room - length, (*filling, length), used)
                left -= used
            else:
                each = min(capacity // length, left)
                used = left // each
                put(capacity - each * length, (length,) * each, used)
                left -= used * each
    return [(n, filling) for found in open_.values() for filling, n in found.items()]


def fillings(lengths: list[int], counts: dict[int, int], first: int, capacity: int) -> list[tuple[int, ...]]:
    """Undominated fillings around ``first``, the best filled first.

    ``lengths`` ascends. A filling is dominated when an unused length still fits
    in, or could take the place of a shorter one in it. The largest length left
    may be used with itself.
    """
    found: dict[tuple[int, ...], int] = {}
    left = dict(counts)
    steps = exact = 0

    def dominated(filling: tuple[int, ...], room: int) -> bool:
        for k in {0, *filling[1:]}:
            # a length that fits in place of k (0: besides all)
            at = bisect_left(lengths, k + room + 1) - 1
            while at >= 0 and lengths[at] > k:
                if left[lengths[at]]:
                    return True
                at -= 1
        return False

    def fill_up(filling: tuple[int, ...], room: int, most: int) -> None:
        """The rest from the longest on."""
        for k in reversed(lengths[: bisect_left(lengths, min(most, room) + 1)]):
            n = min(room // k, left[k])
            filling, room = filling + (k,) * n, room - k * n
        found[filling] = room

    def search(filling: tuple[int, ...], room: int, most: int) -> bool:
        """Extend a filling; false when it is time to stop."""
        nonlocal steps, exact
        steps += 1
        if room <= most and left.get(room):
            found[(*filling, room)] = 0
            exact += 1
            return exact < FILLINGS
        if len(filling) >= _DEEP or steps >= FILL_STEPS:
            fill_up(filling, room, most)
            return steps < FILL_STEPS
        at, grown = bisect_left(lengths, min(room, most) + 1) - 1, False
        while at >= 0:
            k = lengths[at]
            at -= 1
            if not left[k]:
                continue
            grown = True
            left[k] -= 1
            go_on = search((*filling, k), room - k, k)
            left[k] += 1
            if not go_on:
                return False
        if not grown and not (room and dominated(filling, room)):
            found[filling] = room
        return True

    left[first] -= 1
    search((first,), capacity - first, capacity)
    # Least waste first; among equals the one whose lengths are the most frequent, lest a hot length is left for last.
    return [f for f, _ in sorted(found.items(), key=lambda x: (x[1], -sum(counts[k] for k in x[0]) / len(x[0])))][:FILLINGS]


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """Plan with as few sequences as the search finds; best-fit decreasing is the first incumbent.

    Depth first: the largest length left is packed with one of its undominated
    fillings, as often as the counts allow. A branch ends when its waste leaves
    no way to beat the incumbent, and the search when a plan meets the lower bound.
    """
    counts = {k: n for k, n in counts.items() if n > 0}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    best = best_fit(counts, capacity)
    size, least = sum(n for n, _ in best), lower_bound(counts, capacity)
    total = sum(k * n for k, n in counts.items())
    left, lengths = dict(counts), sorted(counts)
    path: Plan = []
    waste = 0
    # One frame per run: the fillings yet to try at its depth, and the run now used.
    frames: list[tuple[Iterator[tuple[int, ...]], tuple[int, tuple[int, ...]] | None]] = []

    def options() -> Iterator[tuple[int, ...]]:
        return iter(fillings(lengths, left, lengths[-1], capacity))

    def use(filling: tuple[int, ...], times: int) -> None:
        for k, m in Counter(filling).items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
                lengths.remove(k)

    def undo(filling: tuple[int, ...], times: int) -> None:
        for k, m in Counter(filling).items():
            if k not in left:
                left[k] = 0
                insort(lengths, k)
            left[k] += m * times

    if counts and size > least:
        frames.append((options(), None))
    while frames and nodes:
        tries, now = frames[-1]
        if now:
            undo(now[1], now[0])
            path.pop()
            waste -= now[0] * (capacity - sum(now[1]))
            frames[-1] = (tries, None)
        filling = next(tries, None)
        if filling is None:
            frames.pop()
            continue
        nodes -= 1
        times = min(left[k] // m for k, m in Counter(filling).items())
        lost = times * (capacity - sum(filling))
        # To beat the incumbent all waste has to stay below this.
        if waste + lost > (size - 1) * capacity - total:
            continue
        use(filling, times)
        path.append((times, filling))
        waste += lost
        frames[-1] = (tries, (times, filling))
        if not lengths:
            best, size = list(path), sum(n for n, _ in path)
            if size <= least:
                break
        else:
            frames.append((options(), None))
    return best


@dataclass
class Places:
    """Where the pieces of each length go, by rank: runs of ranks with their first sequence and offset."""

    start: dict[int, np.ndarray]
    first: dict[int, np.ndarray]
    each: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]

    @classmethod
    def of(cls, plan: Plan) -> "Places":
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: Counter = Counter()
        sequence = 0
        for times, filling in plan:
            offset = 0
            for k, m in sorted(Counter(filling).items(), reverse=True):
                rows.setdefault(k, []).append((taken[k], sequence, m, offset))
                taken[k] += m * times
                offset += k * m
            sequence += times
        column = lambda i: {k: np.array([r[i] for r in v], np.int64) for k, v in rows.items()}
        return cls(*(column(i) for i in range(4)))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece."""
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k in np.unique(length).tolist():
            rows = np.flatnonzero(length == k)
            at = np.searchsorted(self.start[k], rank[rows], "right") - 1
            within, each = rank[rows] - self.start[k][at], self.each[k][at]
            sequence[rows] = self.first[k][at] + within // each
            offset[rows] = self.offset[k][at] + within % each * k
        return sequence, offset


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int | None = 0,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Tokens of each whole text with ``end_id`` after them, cut only where longer than ``capacity``.

    One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    and ``part``, ``nth``: the task that made it and its number among the pieces
    of its length there. A text without tokens has one piece that holds the end
    id, or none where there is no end id.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.at(tokenizer or default_tokenizer())
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in blocks(batches):
            ids, sizes = encoder.encode(batch.column("text"))
            if end_id is not None:
                ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
            rows, at = [], 0
            for doc_id, size in zip(batch.column("doc_id").to_pylist(), sizes.tolist()):
                for i, start in enumerate(range(0, size, capacity)):
                    n = min(capacity, size - start)
                    rows.append((doc_id, i, start, n, crc32_of(ids[at + start : at + start + n]), part, seen[n]))
                    seen[n] += 1
                at += size
            if rows:
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return texts.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long")


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (staged pieces) with ``sequence_id`` and ``offset``, without ``part`` and ``nth``.

    The driver gets the histogram of lengths (``capacity`` rows at most) and
    broadcasts the plan, whose size depends on that histogram alone.
    """
    counts = found.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = found.sparkSession.sparkContext.broadcast(Places.of(complete_bins(histogram, capacity)))
    ranked = found.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "part", "nth")
    columns = [c for c in found.columns if c not in ("part", "nth")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
                placed = [pa.array(x, pa.int64()) for x in places.value.find(length, rank)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *placed], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {t}" for c, t in found.dtypes if c in columns)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int | None = 0) -> DataFrame:
    """Pieces of all texts with their places in as few sequences of ``capacity`` tokens as the search finds.

    Every row is a document of its own, so repeated rows and null ids are packed
    like others; a null text is empty. Texts are read and encoded once.
    """
    return place(stage(pieces(docs, capacity, tokenizer, end_id), "pieces"), capacity)
