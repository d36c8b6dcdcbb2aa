"""Operators 5 and 6: near-duplicate classes and exact top-k."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from layerkit.llm import simhash, topk
from layerkit.llm.components import connected_components
from tests.llm.conftest import ODD


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(found, most):
    """Root of each distinct fingerprint, comparing all pairs."""
    nodes = sorted(set(found))
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def check_classes(rows, found):
    prints = [brute_fingerprint(t) for _, t in rows]
    roots = brute_classes(prints, 2)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    want = sorted((str(i), f"{p:016x}", str(least.get(roots[p]))) for (i, _), p in zip(rows, prints))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == want


def test_near_duplicates_against_brute_force(docs):
    base = " ".join(f"w{i}" for i in range(400))
    near = [(100 + i, base.replace(f"w{i * 7} ", f"changed{i} ")) for i in range(50)]
    rows = [*ODD, *near, (60, base), (61, base.upper()), (62, "A\x0bB\x1cc"), (63, "word " * 70_000)]
    check_classes(rows, simhash.near_duplicates(docs(rows)).collect())
    assert simhash.near_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("most", [0, 1, 2])
@pytest.mark.parametrize("full_cell", [0, 3, 256])
def test_links_connect_what_all_pairs_connect(spark, most, full_cell):
    if most == 0 and full_cell < 256:
        pytest.skip("equal fingerprints are one node")
    draw = random.Random(most)
    seeds = [draw.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    prints = set(seeds)
    for s in seeds[:12]:
        for _ in range(25):
            for _ in range(draw.randint(0, 3)):
                s ^= 1 << draw.randrange(64)
            prints.add(s)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), most, full_cell).collect()
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= most for r in links)
    root = {p: p for p in prints}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for r in links:
        x, y = find(r.a % (1 << 64)), find(r.b % (1 << 64))
        root[max(x, y)] = min(x, y)
    assert {p: find(p) for p in prints} == brute_classes(prints, most)


def test_segment_counts_bound_the_distance_from_below(spark):
    draw = random.Random(5)
    rows = [tuple(draw.getrandbits(64) - (1 << 63) for _ in range(2)) for _ in range(100)]
    pairs = spark.createDataFrame(rows, "a long, b long")
    counted = pairs.select("a", "b", F.array(*simhash.segment_counts(F.col("a"))).alias("x"), F.array(*simhash.segment_counts(F.col("b"))).alias("y"))
    for r in counted.collect():
        assert sum(abs(i - j) for i, j in zip(r.x, r.y)) <= ((r.a ^ r.b) & ((1 << 64) - 1)).bit_count()
        assert sum(r.x) == (r.a & ((1 << 64) - 1)).bit_count()


def test_components_of_chains_stars_and_odd_links(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3), (300, None), (7, 3), (7, 3), (501, 500)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 500: 500, 501: 500}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_keeps_one_row_of_a_class(docs):
    rows = [*ODD, (70, "Same TEXT"), (71, "something else entirely"), (71, "something else entirely"), (72, "something else entirely")]
    found = docs(rows)
    kept = simhash.one_of_each(found)
    assert kept.columns == found.columns
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    classes = brute_classes([brute_fingerprint(t) for _, t in rows], 2)
    assert len(texts) == len(set(classes.values()))
    assert sorted(classes[brute_fingerprint(t)] for _, t in texts) == sorted(set(classes.values()))
    assert {i for i, t in texts if t and t.lower() == "same text"} == {5} and (71, "something else entirely") in texts
    assert simhash.one_of_each(docs([])).count() == 0


def brute_top(rows, every, k):
    out = []
    for n, (q, v) in enumerate(rows):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(rows) if m != n)[:k]
            out += [(q, place, i, -s) for place, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("block, group, broadcast_bytes", [(16, 2, 1 << 20), (16, 3, 0), (1000, 1000, 1 << 20), (1000, 1000, 0)])
def test_top_k_against_brute_force(spark, block, group, broadcast_bytes):
    draw = random.Random(block)
    rows = [(i, [draw.randint(-50, 50) for _ in range(8)]) for i in range(-20, 150)]
    rows += [(i, [7, 0, 0, 0, 0, 0, 0, 0]) for i in range(200, 240)]  # ties
    rows += [(300, []), (301, [5]), (400, [0] * 8), (401, [1] * 12)]
    # Rows that repeat an id, with another vector and with the same, of queries too.
    rows += [(7, [60] * 8), (7, [60] * 8), (20, [-60] * 8), (20, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    found = topk.top_k(df, every=20, k=5, block=block, queries_a_task=group, broadcast_bytes=broadcast_bytes).collect()
    assert sorted(map(tuple, found)) == brute_top(rows, 20, 5)


def test_top_k_query_and_its_twin_agree_on_repeated_ids(spark, tmp_path):
    import duckdb

    from layerkit.llm import queries

    draw = random.Random(3)
    rows = [(i % 150, [draw.random() - 0.5 for _ in range(6)], 1) for i in range(400)] + [(100, [0.5] * 6, 1), (1, [0.9] * 6, 1), (1, [0.5] * 6, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(queries.ORACLE["op6_exact_top_k"]).fetchall()
    assert sorted(map(tuple, queries.QUERIES["op6_exact_top_k"](spark, str(tmp_path)).collect())) == sorted(want)


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "vec_id long, v array<long>")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 1, 11)]
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.where("vec_id = 1")).count() == 0


def test_unsound_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.0001], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (None, [1.0, 1.0], 1), (5, [0.25, 0.5], 2), (5, [0.25, 0.75], 2), (6, [], 1)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("v", T.LongType())]))
    assert sorted((r.vec_id, r.v) for r in topk.integer_vectors(df).collect()) == [(0, [512, -1]), (5, [256, 512]), (5, [256, 768]), (6, [])]


@given(st.integers(1, 60), st.integers(1, 6), st.integers(1, 5), st.integers(1, 300), st.randoms(use_true_random=False))
@settings(max_examples=80, deadline=None)
def test_index_stops_only_on_proof(n, dims, k, size, draw):
    vectors = np.array([[draw.randint(-size, size) for _ in range(dims)] for _ in range(n)])
    query = np.array([draw.randint(-size, size) for _ in range(dims)])
    members, scores = topk.ImpactIndex(vectors, 4).top(query, k)
    exact = vectors @ query
    assert (exact[members] == scores).all()
    edge = np.sort(exact)[-min(k, n)]
    assert {*np.flatnonzero(exact >= edge).tolist()} <= {*members.tolist()}
