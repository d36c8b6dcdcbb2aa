"""Operator 12: compression of vectors into codes, with Orchard's search for the nearest entry.

A vector is cut into equal parts, each with a codebook of its own. For every
entry of a codebook the others are listed by their distance from it. A search
stands at one entry and goes through its list: an entry that is nearer to the
part becomes the new place, whose list is gone through from its start. Entries
met before are marked and not measured again. By the triangle inequality nothing
beyond twice the present distance can be nearer, so the search ends there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from layerkit.llm.common import begin, matrix_of, whole_components, widest
from layerkit.session import stage

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
# Components up to this keep every squared distance, and the sums of them, within 64 bits.
_MOST = 1 << 28
# Rows searched side by side.
_ROWS = 8192


class Codebook:
    """Entries of one part position, with every entry's neighbours in order of distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        gaps = self.entries[:, None, :] - self.entries[None, :, :]
        apart = (gaps * gaps).sum(axis=2)
        self.neighbours = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.neighbours, axis=1)

    def nearest(self, parts: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row of ``parts``, ties to the lower index, and the squared distance.

        ``start`` names the entries where the searches begin. The searches of all rows advance
        side by side, each along its own list; rows that are done leave.
        """
        n, size = len(parts), len(self.entries)
        at = np.zeros(n, np.int64) if start is None else start.astype(np.int64)
        best = ((parts - self.entries[at]) ** 2).sum(axis=1)
        met = np.zeros((n, size), bool)
        met[np.arange(n), at] = True
        place = np.zeros(n, np.int64)
        live = np.arange(n)
        while len(live):
            here, p = at[live], place[live]
            # Squares are compared, so twice the distance is four times the square; an equal one may hold a tie.
            on = self.apart[here, p] <= 4 * best[live]
            live, here, p = live[on], here[on], p[on]
            other = self.neighbours[here, p]
            place[live] = p + 1
            fresh = ~met[live, other]
            rows, other = live[fresh], other[fresh]
            met[rows, other] = True
            gap = parts[rows] - self.entries[other]
            found = (gap * gap).sum(axis=1)
            nearer = (found < best[rows]) | ((found == best[rows]) & (other < at[rows]))
            moved = rows[nearer]
            at[moved], best[moved], place[moved] = other[nearer], found[nearer], 0
            live = live[place[live] < size]
        return at, best


def integer_rows(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = SCALE, keep: tuple[str, ...] = ("label",)) -> DataFrame:
    """``vec_id``, ``x`` (components as floor(scale * component)) and the columns ``keep``; unsound vectors are left out."""
    x = whole_components(column, scale).alias("x")
    return df.select(F.col(id_column).cast("long").alias("vec_id"), x, *keep).where("x is not null")


def _width(dims: int, parts: int) -> int:
    return -(-dims // parts) * parts


def _cut(lists: pa.ListArray, width: int, parts: int) -> np.ndarray:
    """Rows as (row, part, component)."""
    x = matrix_of(lists, width)
    if widest(x) >= _MOST:
        raise ValueError(f"components from {_MOST} on do not fit the sums of squares")
    return x.reshape(len(x), parts, width // parts)


def first_codebooks(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the vectors with the ``entries`` smallest ids, as (part, entry, component).

    A repeated id counts once, with its smallest vector. Null ids are no entries.
    """
    ids = rows.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries)
    few = rows.join(F.broadcast(ids), "vec_id").groupBy("vec_id").agg(F.min("x").alias("x"))
    found = [r.x for r in few.orderBy("vec_id").limit(entries).collect()]
    return _cut(pa.array(found, pa.list_(pa.int64())), width, parts).transpose(1, 0, 2).copy()


def assign(rows: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``rows`` with ``codes`` (an index per part) and ``error``, the squared distances summed, in place of ``x``."""
    parts, _, step = codebooks.shape
    kept = [c for c in rows.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("vector_codes")
        books = [Codebook(b) for b in codebooks]
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                piece = batch.slice(at, _ROWS)
                codes, error = _search(books, _cut(piece.column("x"), parts * step, parts))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(codes.reshape(-1), pa.int32()), parts).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), flat, pa.array(error, pa.int64())], names=[*kept, "codes", "error"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes if c != "x")
    return rows.mapInArrow(run, f"{schema}{', ' if schema else ''}codes array<int>, error long")


def _search(books: list[Codebook], cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, error = np.zeros(cut.shape[:2], np.int64), np.zeros(len(cut), np.int64)
    for part, book in enumerate(books):
        codes[:, part], squares = book.nearest(cut[:, part])
        error += squares
    return codes, error


def improved(rows: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Codebooks whose entries are the floored means of the parts that they are nearest to; unused entries stay.

    A task passes on one row per used entry; these are added up by entry, and the
    driver gets as many rows as the codebooks have entries.
    """
    parts, entries, step = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("vector_codes")
        books = [Codebook(b) for b in codebooks]
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, step), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                cut = _cut(batch.slice(at, _ROWS).column("x"), parts * step, parts)
                codes, _ = _search(books, cut)
                for part in range(parts):
                    np.add.at(count[part], codes[:, part], 1)
                    np.add.at(total[part], codes[:, part], cut[:, part])
        part, entry = np.nonzero(count)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry], pa.int64())]
        columns += [pa.array(total[part, entry, i], pa.int64()) for i in range(step)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *(f"s{i}" for i in range(step))])

    schema = ", ".join(["part int", "entry int", "n long", *(f"s{i} long" for i in range(step))])
    sums = [F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(step)]
    found = rows.select("x").mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect()
    better = codebooks.copy()
    for r in found:
        better[r.part, r.entry] = [int(r[f"s{i}"]) // r.n for i in range(step)]
    return better


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after ``rounds`` rounds over all ``rows`` (staged), as (part, entry, component)."""
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    codebooks = first_codebooks(rows, _width(dims, parts), parts, entries)
    for _ in range(rounds if codebooks.size else 0):
        codebooks = improved(rows, codebooks)
    return codebooks


def codebooks_sha256(codebooks: np.ndarray) -> str:
    """Digest of all components by part, entry and position, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def decoded(coded: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``coded`` with ``x``, the vector that its ``codes`` stand for, in place of them."""
    parts, _, step = codebooks.shape
    kept = [c for c in coded.columns if c != "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = matrix_of(batch.column("codes"), parts)
            x = codebooks[np.arange(parts), codes].reshape(-1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x, pa.int64()), parts * step).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists], names=[*kept, "x"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in coded.dtypes if c != "codes")
    return coded.mapInArrow(run, f"{schema}{', ' if schema else ''}x array<bigint>")


def compress(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Code of every sound vector: ``vec_id``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256``.

    ``code`` has two hex digits per part. ``label_error`` is the error of all rows
    with the same label, null labels together. Rows with a null vector, or with a
    null or non-finite component, are left out; a null id is coded but is no entry.
    Repeated rows stay. Vectors shorter than the longest, and a length that the
    parts do not divide, end in zeros. Fewer ids than entries make shorter
    codebooks; without any id there are no entries and no rows come back.
    Components of 2^28 and more after scaling raise.
    """
    rows = df.select(F.col(id_column).alias("vec_id"), F.col(column).alias("embedding"), F.col(label_column).alias("label"))
    rows = stage(integer_rows(rows), "vectors")
    codebooks = train(rows)
    if not codebooks.size:
        return _empty(df.sparkSession)
    coded = stage(assign(rows, codebooks), "codes")
    sums = stage(coded.groupBy(F.col("label").alias("its_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    # A plain join of two written tables: Spark sends the sums to all tasks where they are small, and splits a hot label where not.
    return coded.join(sums, F.col("label").eqNullSafe(F.col("its_label"))).select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(codebooks_sha256(codebooks)).alias("codebooks_sha256"),
    )


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
