"""Operator 6: exact top-k by inner product over an impact-ordered index.

A block of candidates is indexed by dimension: the values of a dimension are
quantised into levels, and the candidates of a level form a posting segment. A
query takes the segments of all dimensions in descending order of impact, that
is query component times the height of the level, and adds up a lower bound for
each candidate. It stops when the bounds prove that few candidates can still be
among the best, and scores these exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from layerkit.llm.common import matrix_of, whole_components
from layerkit.session import stage

# Candidates of one index, queries that one task answers over it, levels of a dimension.
BLOCK, QUERIES_A_TASK, LEVELS = 16_384, 1024, 16
# Bytes up to which all queries are broadcast.
BROADCAST_BYTES = 32 << 20
# Shares of the segments after which the bounds are looked at.
_LOOKS = (0.25, 0.4, 0.55, 0.7, 0.85)


class ImpactIndex:
    """Posting segments of one block of integer vectors."""

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS):
        self.vectors = vectors.astype(np.int64)
        n, dims = vectors.shape
        self.low = self.vectors.min(axis=0) if n else np.zeros(dims, np.int64)
        self.high = self.vectors.max(axis=0) if n else np.zeros(dims, np.int64)
        self.step = (self.high - self.low) // levels + 1
        self.segments: list[tuple[int, int, np.ndarray]] = []  # dimension, level, candidates
        for d in range(dims):
            level = (self.vectors[:, d] - self.low[d]) // self.step[d]
            order = np.argsort(level, kind="stable")
            found, starts = np.unique(level[order], return_index=True)
            self.segments += [(d, int(v), ids) for v, ids in zip(found, np.split(order, starts[1:]))]
        self.dims = np.array([s[0] for s in self.segments], np.int64)
        floor = self.low[self.dims] + np.array([s[1] for s in self.segments], np.int64) * self.step[self.dims] if self.segments else np.zeros(0, np.int64)
        self.floor, self.ceiling = floor, np.minimum(floor + self.step[self.dims] - 1, self.high[self.dims]) if self.segments else floor

    def top(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that hold the ``k`` best scores, with all ties of the last one, and their exact scores."""
        n = len(self.vectors)
        if n <= k or not self.segments:
            return np.arange(n), self.vectors @ query
        weight = query[self.dims]
        # Scores are counted from the least that each dimension can give, so every impact is at least zero.
        base = np.where(query > 0, self.low, self.high) * query
        ends = np.stack([self.floor * weight, self.ceiling * weight])
        least, most = ends.min(axis=0) - base[self.dims], ends.max(axis=0) - base[self.dims]
        order = np.argsort(-most, kind="stable")
        order = order[most[order] > 0]
        looks = {int(len(order) * share) for share in _LOOKS} | {len(order)}
        bound = np.zeros(n, np.int64)
        spread = np.zeros(len(query), np.int64)
        np.maximum.at(spread, self.dims, most - least)
        members = np.arange(n)
        for place, at in enumerate(order.tolist(), 1):
            if least[at]:
                bound[self.segments[at][2]] += least[at]
            if place in looks:
                # What a dimension can still add: its best segment to come, or what quantising left out.
                rest = np.zeros(len(query), np.int64)
                ahead = order[place:]
                np.maximum.at(rest, self.dims[ahead], most[ahead])
                slack = int(np.maximum(rest, spread).sum())
                edge = np.partition(bound, n - k)[n - k]
                members = np.flatnonzero(bound + slack >= edge)
                if len(members) <= max(8 * k, n // 100):
                    break
        scores = self.vectors[members] @ query
        if len(members) > k:
            kept = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            members, scores = members[kept], scores[kept]
        return members, scores


def integer_vectors(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = 1024) -> DataFrame:
    """``vec_id`` and ``v``, each component as floor(scale * component), for every sound row.

    Left out are null ids, null vectors and vectors that hold a null or
    non-finite component. Rows that repeat an id stay rows of their own.
    """
    return df.select(F.col(id_column).cast("long").alias("vec_id"), whole_components(column, scale).alias("v")).where("vec_id is not null and v is not null")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """``dims``, ``rows``, ``ids`` and ``data``: up to ``size`` vectors of one task as one row of bytes, numbered by ``task`` and ``part``."""

    def pack(held: list[pa.RecordBatch], part: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        data = matrix_of(table.column("v"))
        numbers = [table.column(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id")]
        packed = [pa.array([np.ascontiguousarray(x, "<i8").tobytes()], pa.binary()) for x in (*numbers, data)]
        columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([part], pa.int32()), pa.array([data.shape[1]], pa.int32()), *packed]
        return pa.RecordBatch.from_arrays(columns, names=["task", "part", "dims", "rows", "ids", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, part = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                piece = batch.slice(at, size)
                if n + piece.num_rows > size:
                    yield pack(held, part)
                    held, n, part = [], 0, part + 1
                held.append(piece)
                n += piece.num_rows
        if n:
            yield pack(held, part)

    return rows.mapInArrow(run, "task int, part int, dims int, rows binary, ids binary, data binary")


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, block: int = BLOCK, queries_a_task: int = QUERIES_A_TASK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The ``k`` highest inner products of each query with all other rows.

    ``vectors`` has ``vec_id`` and integer ``v`` (:func:`integer_vectors`). Queries
    are the rows whose id is divisible by ``every``, candidates all rows but the
    query's own: rows that repeat an id are all candidates, and each of them is a query. A vector
    shorter than another counts as ending in zeros. Returns ``query_id``, ``rank``
    from 1, ``vec_id`` and ``score``; ties go to the smaller id, and a query with
    fewer candidates than ``k`` gets all. Scores are exact while they fit 64 bits.

    Candidates lie in blocks, evenly over the tasks. Queries lie in groups, which
    are broadcast where all of them take ``broadcast_bytes`` at most; else each block meets
    each group by a shuffle on both their numbers. A task passes on ``k`` rows per query.
    """
    rows = stage(vectors.select("vec_id", "v", F.monotonically_increasing_id().alias("row")), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asked"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dims")).first()
    n_groups = max(1, -(-size.asked // queries_a_task))
    group = F.pmod(F.xxhash64("row"), F.lit(n_groups)).cast("int")
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = asked.groupBy(group.alias("asked")).agg(F.sort_array(F.collect_list(F.struct("row", "vec_id", "v"))).alias("queries"))
    # Every block costs a query its look at the segments, so there are no more blocks than keep all cores busy.
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size.n // block))
    spread = _blocks(rows.repartition(tasks, "row"), block)
    every_group = F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("asked")
    if size.asked * (8 * size.dims + 32) <= broadcast_bytes:
        met = spread.select("*", every_group).join(F.broadcast(stage(queries, "queries")), "asked")
    else:
        spread = stage(spread, "blocks")
        last = spread.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]
        grid = F.explode(F.sequence(F.lit(0), F.lit(tasks * (last + 1) - 1))).alias("block")
        numbered = spread.withColumn("block", F.col("task") * (last + 1) + F.col("part"))
        met = numbered.select("*", every_group).join(queries.select("*", grid), ["block", "asked"])
    best = met.mapInArrow(_search_with(k), "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_with(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                found = batch.column("queries")[at].values
                query_rows, query_ids = (found.field(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id"))
                dims = batch.column("dims")[at].as_py()
                asked = matrix_of(found.field("v"))
                wide = max(dims, asked.shape[1])
                rows, ids = (np.frombuffer(batch.column(c)[at].as_py(), "<i8") for c in ("rows", "ids"))
                data = np.zeros((len(ids), wide), np.int64)
                data[:, :dims] = np.frombuffer(batch.column("data")[at].as_py(), "<i8").reshape(len(ids), dims)
                asked = np.pad(asked, ((0, 0), (0, wide - asked.shape[1])))
                index, out = ImpactIndex(data), []
                for row, query_id, query in zip(query_rows.tolist(), query_ids.tolist(), asked):
                    members, scores = index.top(query, k + 1)  # one more, as it may find itself
                    own = rows[members] != row
                    best = np.lexsort((ids[members][own], -scores[own]))[:k]
                    out.append((np.full(len(best), row), np.full(len(best), query_id), ids[members][own][best], scores[own][best]))
                if out:
                    columns = [pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i in range(4)]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_row", "query_id", "vec_id", "score"])

    return search
