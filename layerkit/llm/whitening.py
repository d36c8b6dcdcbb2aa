"""Operator 11: whitening of embeddings by spectral divide and conquer.

The covariance is split at a shift: the polar factor of the shifted matrix,
found by dynamically weighted Halley steps (QDWH), has the eigenvalues +1 and -1
on the two sides, so half of it and the identity is a projector on the upper
invariant subspace. Each subspace is split again until single components are
left; these and the mean are broadcast, and every row is projected in its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from layerkit.llm.common import begin, matrix_of, whole_components, widest
from layerkit.session import stage

SCALE, COMPONENTS = 256, 4
_EPS = float(np.finfo(float).eps)
# Rows of one product of integers in floating point.
_ROWS = 4096
_LOW = (1 << 64) - 1


def polar(a: np.ndarray) -> np.ndarray:
    """Unitary polar factor of a symmetric, regular matrix by QDWH.

    Each step weighs the Halley iteration by a lower bound of the singular
    values: ill-conditioned steps by QR, the others by Cholesky factors.
    """
    n = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = max(_EPS, 1 / float(np.linalg.norm(np.linalg.inv(x))))
    except np.linalg.LinAlgError:
        low = _EPS
    for _ in range(30):
        before, square = x, low * low
        d = np.cbrt(4 * (1 - square) / square**2) if low < 1 else 0.0
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d))))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
            x = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            root = np.linalg.cholesky(np.eye(n) + wc * (x.T @ x))
            x = wb / wc * x + (wa - wb / wc) * np.linalg.solve(root.T, np.linalg.solve(root, x.T)).T
        x = (x + x.T) / 2
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if abs(low - 1) < 8 * _EPS and np.linalg.norm(x - before) < np.cbrt(_EPS):
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the upper and the lower invariant subspace; none where no shift parts them cleanly."""
    n = len(a)
    mean, spread = np.trace(a) / n, np.linalg.norm(a - np.trace(a) / n * np.eye(n)) / np.sqrt(n)
    best = None
    # The mean lies between the ends of the spectrum; the other shifts serve where an eigenvalue sits right on it.
    for shift in (mean, float(np.median(np.diag(a))), *(mean + f * spread for f in (0.31, -0.31, 0.73, -0.73, 0.07, -0.07))):
        moved = a - shift * np.eye(n)
        if not np.linalg.norm(moved):
            continue
        projector = (polar(moved) + np.eye(n)) / 2
        rank = int(round(float(np.trace(projector))))
        if not 0 < rank < n:
            continue
        # A projector sends a matrix in general position onto its range; once more for accuracy.
        start = np.linalg.qr(projector @ np.random.default_rng(n).standard_normal((n, rank)))[0]
        upper = np.linalg.qr(projector @ start)[0]
        both = np.linalg.qr(upper, mode="complete")[0]
        lower = both[:, rank:]
        off = np.linalg.norm(upper.T @ a @ lower)
        if best is None or off < best[0]:
            best = off, upper, lower
        if off <= 100 * n * _EPS * np.linalg.norm(a):
            break
    return best and best[1:]


def components_of(covariance: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    Subspaces are split from the top, and only as far as the ``k`` components
    need. A subspace whose eigenvalues are equal to rounding is not split: any
    basis of it serves. Components whose eigenvalue is zero to rounding are left
    out, as nothing whitens them.
    """
    n = len(covariance)
    scale = np.linalg.norm(covariance) if n else 0.0
    values, vectors, blocks = [], [], [np.eye(n)] if scale else []
    while blocks and len(values) < k:
        basis = blocks.pop()
        inner = basis.T @ covariance @ basis
        inner = (inner + inner.T) / 2
        m = len(inner)
        flat = np.linalg.norm(inner - np.trace(inner) / m * np.eye(m)) <= 4 * m * _EPS * scale
        parts = None if m == 1 or flat else _split(inner)
        if parts is None:
            order = np.argsort(-np.diag(inner), kind="stable")
            values += np.diag(inner)[order].tolist()
            vectors += list(basis[:, order].T)
        else:
            blocks += [basis @ parts[1], basis @ parts[0]]
    kept = [i for i in range(min(k, len(values))) if values[i] > 8 * n * _EPS * scale]
    vectors = np.array([vectors[i] for i in kept]).reshape(len(kept), n)
    return np.array([values[i] for i in kept]), vectors.T


@dataclass
class Moments:
    """Count, sums per dimension (exact) and covariance of a set of integer vectors."""

    n: int
    sums: list[int]
    covariance: np.ndarray


def integer_rows(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``x``, the components as floor(scale * component); rows with an unsound vector are left out."""
    return df.select(F.col(id_column).cast("long").alias("vec_id"), whole_components(column, scale).alias("x")).where("x is not null")


def _products(rows: np.ndarray) -> np.ndarray:
    """Sum of the outer products of integer rows, exact."""
    most = widest(rows)
    if most * most * _ROWS >= 1 << 53 or rows.dtype == object:
        wide = rows.astype(object)
        return wide.T @ wide
    total = np.zeros((rows.shape[1],) * 2, object)
    for at in range(0, len(rows), _ROWS):
        part = rows[at : at + _ROWS].astype(float)
        total += (part.T @ part).astype(np.int64)
    return total


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, the sum of every dimension, and the number of rows as dimension -1."""
    begin("whitening")
    sums = {-1: 0}
    for batch in batches:
        if batch.num_rows:
            x = matrix_of(batch.column("x"))
            sums[-1] += batch.num_rows
            wide = x.astype(object) if widest(x) >= 1 << 40 else x
            for at, s in enumerate(wide.sum(axis=0).tolist() if x.size else [0] * x.shape[1]):
                sums[at] = sums.get(at, 0) + s
    yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array(map(str, sums.values()), pa.string())], names=["at", "s"])


def moments(fit: DataFrame) -> Moments:
    """Moments of the column ``x`` of ``fit``; a shorter vector ends in zeros.

    Two passes: count and sums, then the products of the rows less the rounded
    mean. These are whole numbers, added without rounding, so the covariance
    depends neither on the order of rows nor on lost tasks; what rounding the
    mean left is taken off exactly at the end. A task passes on one row per
    dimension, and the driver gets as many.
    """
    sent = fit.select("x").mapInArrow(_sums, "at int, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = {r.at: int(r.s) for r in sent.collect()}
    n, dims = sums.pop(-1, 0), max(sums, default=-1) + 1
    sums = [sums.get(i, 0) for i in range(dims)]
    if not n or not dims:
        return Moments(n, sums, np.zeros((dims, dims)))
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], object)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("whitening")
        total = None
        for batch in batches:
            if batch.num_rows:
                rows = matrix_of(batch.column("x"), dims)
                far = max(map(abs, centre.tolist())) + widest(rows) >= 1 << 62
                part = _products(rows.astype(object) - centre if far else rows - centre.astype(np.int64))
                total = part if total is None else total + part
        if total is not None:
            # A product may need 126 bits: high and low halves are added apart.
            halves = [[str(h) for v in row for h in (v >> 64, v & _LOW)] for row in total.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(halves, pa.list_(pa.string()))], names=["i", "row"])

    sent = fit.select("x").mapInArrow(products, "i int, row array<string>")
    parts = [F.sum(F.col("row")[j].cast("decimal(38,0)")).alias(f"g{j}") for j in range(2 * dims)]
    gram = {r.i: [(int(high) << 64) + int(low) for high, low in zip(r[1::2], r[2::2])] for r in sent.groupBy("i").agg(*parts).collect()}
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    covariance = [[(n * gram[i][j] - rest[i] * rest[j]) / (n * n) for j in range(dims)] for i in range(dims)]
    return Moments(n, sums, np.array(covariance, float))


def whiten(rows: DataFrame, found: Moments, values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """``rows`` (with ``x``) and ``deviation`` and ``whitened``, an array with one entry per component.

    ``deviation`` is the sum over dimensions of (n * x - sum)^2, exact, or null
    where 64 bits do not hold it. Mean and components travel to the tasks with
    the function: their size is the dimensions', whatever the number of rows.
    """
    n, dims = found.n, len(found.sums)
    sums, mean = np.array(found.sums, object), np.array([s / n for s in found.sums], float) if n else np.zeros(0)
    weights = vectors / np.sqrt(values)
    kept = [c for c in rows.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("whitening")
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column("x"), dims)
            most = n * widest(x) + max(map(abs, found.sums), default=0)
            if most * most * max(1, dims) < 1 << 63:
                deviation = ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:
                wide = ((n * x.astype(object) - sums) ** 2).sum(axis=1).tolist()
                deviation = [v if v < 1 << 63 else None for v in wide]
            white = (x - mean) @ weights
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(deviation, pa.int64()), pa.array(list(white), pa.list_(pa.float64()))],
                names=[*kept, "deviation", "whitened"],
            )

    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes if c != "x")
    return rows.mapInArrow(run, f"{schema}{', ' if schema else ''}deviation long, whitened array<double>")


def identity_error(fit: DataFrame, found: Moments, values: np.ndarray, vectors: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity."""
    k = len(values)
    if not k:
        return 0.0
    white = whiten(fit.select("x"), found, values, vectors).select("whitened")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = white.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whitened_components(df: DataFrame, k: int = COMPONENTS, id_column: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Every sound row projected on the ``k`` leading components of the distinct vectors.

    Returns per row and component ``vec_id``, ``component`` (from 1), ``n``,
    ``deviation``, ``whitened``, ``explained`` and ``identity_error``. Each
    distinct integer vector counts once in the fit, however often it is
    repeated; repeated rows and ids stay rows of their own, and a null id stays
    null. Vectors shorter than the longest end in zeros. Fewer components come
    back where the distinct vectors span fewer dimensions: none for an empty
    table, for one distinct vector, or for vectors without entries.
    """
    rows = stage(integer_rows(df, id_column, column, scale), "vectors")
    fit = stage(rows.select("x").distinct(), "distinct-vectors")
    found = moments(fit)
    values, vectors = components_of(found.covariance, k)
    error = identity_error(fit, found, values, vectors)
    trace = float(np.trace(found.covariance)) if len(values) else 1.0
    explained = F.array(*[F.lit(float(e) / trace) for e in values]) if len(values) else F.array().cast("array<double>")
    white = whiten(rows, found, values, vectors)
    return white.select(
        "vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"),
    ).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
