"""Operator 3: quality classifier by naive Bayes support vectors.

A text becomes the set of its n-grams: lower-cased words, and one to three
neighbouring word shapes (case, digits, signs). Each indicator is scaled by the
log ratio of its counts in both classes, and a linear hinge-loss model is fitted
by dual coordinate descent. A logistic curve turns the margin into a score.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from layerkit.llm.common import begin, bounded_sample, held_out, map_arrow, remember, runs

# Buckets that n-grams are hashed into.
BUCKETS = 1 << 16
# Labelled rows that a model is fitted on at most, about.
FIT_ROWS = 12_000

_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_RUNS = re.compile(r"([^\w]|_)\1+")


def _case(match: re.Match) -> str:
    word = match.group()
    if word.islower():
        return "a"
    if word.isupper():
        return "A" if len(word) > 1 else "T"
    return "T" if word[0].isupper() and word[1:].islower() else "m"


def shape(chunk: str) -> str:
    """Case of each run of letters, digits as 0, each run of one sign once."""
    return _RUNS.sub(r"\1", _DIGITS.sub("0", _LETTERS.sub(_case, chunk)))


class Shapes:
    """Hashes of the word and the shape of chunks, kept per process."""

    known: dict[str, int] = {}

    @classmethod
    def of(cls, chunks: list[str]) -> np.ndarray:
        """Hash of the word and hash of the shape of each chunk."""
        begin("shapes")
        if len(cls.known) > 200_000:
            cls.known.clear()
        known = cls.known
        for c in chunks:
            if c not in known:
                core = "".join(_LETTERS.findall(c.lower())) if not c.islower() or not c.isalpha() else c
                known[c] = zlib.crc32(core.encode()) << 32 | zlib.crc32(shape(c).encode(), 7)
        both = np.array([known[c] for c in chunks], np.uint64)
        return np.stack([both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)], axis=1)


remember("shapes", Shapes.known.clear)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each distinct n-gram of each whole text; a null or blank text has one, the empty n-gram."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.string()), "")))
    coded = lists.flatten().dictionary_encode()
    hashes = Shapes.of(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
    offsets = lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes).astype(np.int64)
    word, form = hashes[:, 0], hashes[:, 1]
    mixed = [(row, word), (row, form * np.uint64(3))]
    grams, at = form, row
    for n in (1, 2):  # a gram grows by the next shape, as long as that lies in the same text
        inside = np.flatnonzero(at[: len(at) - 1] == row[n:]) if len(at) > 1 else np.zeros(0, np.int64)
        longer = grams[: len(grams) - 1] * np.uint64(0x9E3779B97F4A7C15) + form[n:]
        mixed.append((at[inside], longer[inside] * np.uint64(2 * n + 3)))
        grams, at = longer, np.where(at[: len(at) - 1] == row[n:], at[: len(at) - 1], -1)
    rows = np.concatenate([r for r, _ in mixed])
    spread = np.concatenate([g for _, g in mixed]) * np.uint64(0xD6E8FEB86659FD93)
    buckets = (spread >> np.uint64(48)).astype(np.int64) % BUCKETS
    keys = np.unique(rows * BUCKETS + buckets)
    return keys // BUCKETS, keys % BUCKETS


@dataclass
class NbSvm:
    """Weight of each bucket, bias, and the curve from margin to score."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 of each text, worked out in pieces that keep the arrays small."""
        return np.concatenate([np.zeros(0), *(self._score(piece) for piece in runs(texts))])

    def _score(self, texts: pa.Array) -> np.ndarray:
        rows, buckets = features(texts)
        n = np.maximum(np.bincount(rows, minlength=len(texts)), 1)
        margin = np.bincount(rows, self.weights[buckets], len(texts)) / np.sqrt(n) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -50, 50)))


def dual_coordinate_descent(
    rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float = 1.0, passes: int = 20, tolerance: float = 1e-3,
) -> np.ndarray:
    """Weights of the linear hinge-loss model for sparse rows (indices, values) and labels +1 and -1.

    Each dual variable in turn takes its best value within [0, cost], in an
    order drawn anew from a fixed seed for each pass.
    """
    w, alpha = np.zeros(size), np.zeros(len(rows))
    norm = np.array([v @ v for _, v in rows])
    order = np.random.default_rng(0)
    for _ in range(passes):
        worst = 0.0
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            slope = y[i] * (w[at] @ v) - 1
            moved = slope if 0 < alpha[i] < cost else min(slope, 0) if alpha[i] <= 0 else max(slope, 0)
            worst = max(worst, abs(moved))
            if abs(moved) > 1e-9 and norm[i] > 0:
                new = min(max(alpha[i] - slope / norm[i], 0), cost)
                w[at] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
        if worst < tolerance:
            break
    return w


def logistic_curve(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve (Newton steps; labels drawn in a little from 0 and 1)."""
    positive, n = (y > 0).sum(), len(y)
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (n - positive + 2))
    x, b = np.stack([margin, np.ones(n)], axis=1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(h, x.T @ (target - p) - 1e-6 * b)
        b += move
        if np.abs(move).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0, cost: float = 1.0, blend: float = 0.25) -> NbSvm:
    """Model from the buckets and the 0/1 label of each row; one class only, or no row, gives a constant score.

    ``blend`` is the share of the fitted weights against their mean size.
    """
    y = np.where(labels > 0, 1.0, -1.0)
    positive = int((y > 0).sum())
    if not positive or positive == len(y):
        share = (positive + 1) / (len(y) + 2)
        return NbSvm(np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))
    counts = np.full((2, BUCKETS + 1), smooth)
    for buckets, label in zip(rows, y):
        counts[int(label > 0), buckets] += 1
    # The last place is the bias. Its ratio and that of buckets never seen are zero.
    share = counts / np.array([[len(y) - positive + 2 * smooth], [positive + 2 * smooth]])
    ratio = np.log(share[1] / share[0])
    ratio[(counts == smooth).all(axis=0)] = 0
    sparse = []
    for buckets in rows:
        scale = 1 / np.sqrt(max(len(buckets), 1))
        sparse.append((np.append(buckets, BUCKETS), np.append(ratio[buckets] * scale, 1.0)))
    w = dual_coordinate_descent(sparse, y, BUCKETS + 1, cost)
    mean = np.abs(w[:BUCKETS]).sum() / max(1, np.count_nonzero(w[:BUCKETS]))
    mixed = np.append(((1 - blend) * mean + blend * w[:BUCKETS]), w[BUCKETS])
    weights = mixed[:BUCKETS] * ratio[:BUCKETS]
    margin = np.array([v_at(weights, b) for b in rows]) + mixed[BUCKETS]
    slope, offset = logistic_curve(margin, y)
    return NbSvm(weights.astype(np.float32), float(mixed[BUCKETS]), slope, offset)


def v_at(weights: np.ndarray, buckets: np.ndarray) -> float:
    return float(weights[buckets].sum() / np.sqrt(max(len(buckets), 1)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``doc_id``, ``text`` and ``label`` of a bounded sample of the rows to learn from.

    Held-out ids, null labels and ids with differing labels are left out. The
    sample is chosen among the labels, so it is small enough to be broadcast and
    the documents are not shuffled.
    """
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where(F.col("label") == F.col("most")).drop("most")
    )
    chosen = bounded_sample(usable, F.col("doc_id"), rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> NbSvm:
    """Fit on the labelled documents that are not held out, on about ``rows`` of them at most.

    Only the n-gram buckets of the sample reach the driver. Repeated ids count once.
    """

    def buckets(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = []
        for piece in runs(batch.column("text")):
            at, found = features(piece)
            packed += [x.astype("<u2").tobytes() for x in np.split(found, np.searchsorted(at, np.arange(1, len(piece))))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(packed, pa.binary())], names=["doc_id", "label", "grams"])

    found = map_arrow(labelled(docs, labels, label, rows), buckets, "doc_id long, label int, grams binary")
    taken = found.groupBy("doc_id", "label").agg(F.min("grams").alias("grams")).orderBy("doc_id").collect()
    return fit_rows([np.frombuffer(r.grams, "<u2").astype(np.int64) for r in taken], np.array([r.label for r in taken], np.int64))


def score(docs: DataFrame, model: NbSvm, into: str = "score") -> DataFrame:
    """All columns of ``docs`` with the probability of label 1 in column ``into``, which replaces an earlier one.

    The model (a weight per bucket, 256 KB) is broadcast. No shuffle.
    """
    return score_column(docs, model, into)


def score_column(docs: DataFrame, model, into: str) -> DataFrame:
    """``docs`` with ``model.score`` of the whole texts; a null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(texts) if len(texts) else [], pa.float64())

    scored.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.withColumn(into, F.arrow_udf(scored, "double")(F.coalesce(F.col("text").cast("string"), F.lit(""))))
