"""Whitening and vector codes against plain versions of the same definitions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from layerkit.llm import vector_codes, whitening
from layerkit.llm.common import prepare, table
from layerkit.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    T.StructField("x", T.StringType()), T.StructField("Whitened", T.StringType()),
])


@pytest.fixture(scope="session")
def vectors(spark):
    prepare(spark)

    def make(rows, parts=3):
        return spark.createDataFrame([(i, v, label, "own", "own") for i, v, label in rows], VECTORS).repartition(parts)

    return make


# Nulls, odd numbers, repeated rows and ids, a short and an empty vector.
ODD = [
    (1, [0.5, 0.25, 0.0, 1.0], 1), (1, [0.5, 0.25, 0.0, 1.0], 1), (1, [-0.5, 0.25, 0.125, 1.0], 2), (2, None, 1), (3, [0.1, None, 0.2, 0.3], 1),
    (4, [0.1, math.nan, 0.2, 0.3], 1), (5, [0.1, math.inf, 0.2, 0.3], 1), (None, [0.75, -0.125, 0.5, 0.0], None), (7, [0.25], None),
    (8, [], 2), (9, [-0.0, 0.1, 0.9, -0.7], 2), (10, [0.3, -0.4, 0.2, 0.6], 3),
]


def floors(v, scale):
    return [math.floor(scale * float(np.float32(c))) for c in v]


def sound(rows):
    return [(i, v, label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def brute_whitening(rows, k=4):
    """(vec_id, component) rows by a symmetric eigensolver; signs are free, so the size of the projection counts."""
    kept = [(i, floors(v, 256)) for i, v, _ in sound(rows)]
    dims = max((len(x) for _, x in kept), default=0)
    kept = [(i, x + [0] * (dims - len(x))) for i, x in kept]
    fit = np.array(sorted({tuple(x) for _, x in kept}), float).reshape(-1, dims)
    n = len(fit)
    if not n or not dims:
        return []
    centred = fit - fit.mean(axis=0)
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    sums = [sum(int(c) for c in column) for column in fit.T]
    out = []
    for at in range(min(k, dims)):
        e, w = values[-1 - at], basis[:, -1 - at]
        if e <= 1e-9 * max(values[-1], 1e-300):
            continue
        for i, x in kept:
            deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
            out.append((i, at + 1, n, deviation, abs(float((np.array(x) - fit.mean(axis=0)) @ w) / math.sqrt(e)), e / values.sum()))
    return out


def check_whitening(found, rows):
    want = brute_whitening(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[4])
    got = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in found), key=key)
    want = sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(abs(g[4] - w[4]) < 1e-9 and abs(g[5] - w[5]) < 1e-12 for g, w in zip(got, want))
    assert all(r.identity_error < 1e-9 for r in found)


def test_whitening_of_odd_rows(spark, vectors):
    check_whitening(whitening.whitened_components(vectors(ODD)).collect(), ODD)
    frame = vectors(ODD)
    assert whitening.whitened_components(frame).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("rows", [[], ODD[:2], [(8, [], 1)], [(2, None, 1)]])
def test_nothing_to_whiten(spark, vectors, rows):
    assert whitening.whitened_components(vectors(rows)).count() == 0


def test_whitening_query_equals_a_plain_eigensolver(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, FOLDER, "embeddings").collect()]
    found = QUERIES["op11_whitened_components"](spark, FOLDER).collect()
    check_whitening(found, rows)
    assert len(found) == 4 * len(rows)


def test_wide_values_stay_exact(spark, vectors):
    rows = [(i, [float(1 << 30) + 128 * i, float(i * i)], 1) for i in range(5)]
    check_whitening(whitening.whitened_components(vectors(rows)).collect(), rows)
    huge = whitening.whitened_components(vectors([(1, [1e30, 0.0], 1), (2, [-1e30, 1.0], 1)])).collect()
    assert all(r.deviation is None for r in huge)  # 64 bits do not hold it


def test_covariance_does_not_lose_digits_far_from_zero(spark, vectors):
    # Values of 2^32 that differ by little: a product before centring would drown them.
    rows = vectors([(i, [float(1 << 24) + (i % 7) * 2, float((i * 5) % 11)], 1) for i in range(50)])
    found = whitening.moments(whitening.integer_rows(rows).select("x").distinct())
    x = np.array(sorted({((i % 7) * 512, ((i * 5) % 11) * 256) for i in range(50)}), float)
    assert np.allclose(found.covariance, np.cov(x.T, bias=True), rtol=1e-14)


@pytest.mark.parametrize("spectrum", [
    [5, 5, 5, 2, 2, 1, 1, 1], [3], [1e6, 1, 1e-3, 0, 0], [4, 4 - 1e-9, 4 - 2e-9, 1], [7, 7, 7], list(range(40, 0, -1)), [1, -1e-20, 0],
])
def test_components_of_known_spectra(spectrum):
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(rng.standard_normal((len(spectrum),) * 2))[0]
    matrix = (basis * np.array(spectrum, float)) @ basis.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.components_of(matrix, 4)
    want = [v for v in sorted(spectrum, reverse=True)[:4] if v > 1e-12 * max(spectrum)]
    assert len(values) == len(want) and np.allclose(values, want, rtol=1e-9, atol=1e-14 * max(spectrum))
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max(initial=0) < 1e-13
    assert np.abs(matrix @ vectors - vectors * values).max(initial=0) < 1e-13 * max(spectrum)


@pytest.mark.parametrize("condition", [1, 1e3, 1e8, 1e14])
def test_polar_factor_is_a_sign(condition):
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.standard_normal((20, 20)))[0]
    values = np.geomspace(1, 1 / condition, 20) * np.where(np.arange(20) % 2, -1, 1)
    sign = whitening.polar((basis * values) @ basis.T)
    assert np.abs(sign @ sign - np.eye(20)).max() < 1e-12
    if condition < 1e10:
        assert np.abs(sign - (basis * np.sign(values)) @ basis.T).max() < 1e-6


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """Codes by measuring every part against every entry."""
    kept = [(i, floors(v, 256), label) for i, v, label in sound(rows)]
    width = -(-max((len(x) for _, x, _ in kept), default=0) // parts) * parts
    kept = [(i, x + [0] * (width - len(x)), label) for i, x, label in kept]
    seeds = {}
    for i, x, _ in kept:
        if i is not None:
            seeds[i] = min(seeds.get(i, x), x)
    if not seeds or not width:
        return []
    step = width // parts
    cut = lambda x: [x[p * step : (p + 1) * step] for p in range(parts)]
    books = [[cut(seeds[i])[p] for i in sorted(seeds)[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, c: min((gap(c, e), at) for at, e in enumerate(books[p]))
    for _ in range(rounds):
        used = [{} for _ in range(parts)]
        for _, x, _ in kept:
            for p, c in enumerate(cut(x)):
                used[p].setdefault(nearest(p, c)[1], []).append(c)
        books = [[[sum(v) // len(v) for v in zip(*used[p][at])] if at in used[p] else e for at, e in enumerate(b)] for p, b in enumerate(books)]
    coded = [(i, label, [nearest(p, c) for p, c in enumerate(cut(x))]) for i, x, label in kept]
    sums = {}
    for _, label, found in coded:
        sums[label] = sums.get(label, 0) + sum(g for g, _ in found)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, "".join(f"{at:02x}" for _, at in found), sum(g for g, _ in found), sums[label], sha) for i, label, found in coded]


def same_codes(found, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    return sorted(map(tuple, found), key=key) == sorted(brute_codes(rows), key=key)


def test_codes_of_odd_rows(spark, vectors):
    assert same_codes(vector_codes.compress(vectors(ODD)).collect(), ODD)


@pytest.mark.parametrize("rows", [[], [(8, [], 1)], [(2, None, 1)], [(None, [0.5, 0.5], 1)]])
def test_nothing_to_encode(spark, vectors, rows):
    assert vector_codes.compress(vectors(rows)).count() == 0


def test_codes_whatever_the_partitions(spark, vectors):
    rng = np.random.default_rng(2)
    # Few distinct values, so that distances tie often.
    rows = [(int(i) % 90, (rng.integers(-2, 3, 32) / 256).tolist(), int(i) % 3) for i in range(300)]
    assert same_codes(vector_codes.compress(vectors(rows, 1)).collect(), rows)
    assert same_codes(vector_codes.compress(vectors(rows, 7)).collect(), rows)


def test_orchard_search_equals_measuring_all(monkeypatch):
    rng = np.random.default_rng(4)
    for spread in (2, 300):
        book = vector_codes.Codebook(rng.integers(-spread, spread, (64, 4)))
        parts = rng.integers(-spread, spread, (5000, 4))
        gaps = ((parts[:, None, :] - book.entries) ** 2).sum(axis=2)
        for start in (None, rng.integers(0, 64, 5000)):
            at, best = book.nearest(parts, start)
            assert (at == gaps.argmin(axis=1)).all() and (best == gaps.min(axis=1)).all()


def test_decoded_codes_have_the_error(spark):
    rows = table(spark, FOLDER, "embeddings")
    found = vector_codes.integer_rows(rows).persist()
    books = vector_codes.train(found)
    coded = vector_codes.assign(found, books)
    back = {r.vec_id: r.x for r in vector_codes.decoded(coded, books).collect()}
    errors = {r.vec_id: r.error for r in coded.collect()}
    for r in found.collect():
        assert sum((a - b) ** 2 for a, b in zip(r.x, back[r.vec_id])) == errors[r.vec_id]


def test_too_wide_components_raise(spark, vectors):
    with pytest.raises(Exception, match="do not fit"):
        vector_codes.compress(vectors([(1, [1e9], 1)])).collect()
