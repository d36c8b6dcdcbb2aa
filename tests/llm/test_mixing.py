"""Mixing of sources against a plain version of targets, rates and draws."""

import hashlib
import re
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from layerkit.llm import mixing
from layerkit.llm.common import prepare, table
from layerkit.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def brute_targets(sizes: dict, share=Fraction(3, 2)) -> dict:
    """Target of each source: deal by weight, stop at twice the source, deal what is left over."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {s: Fraction(0) for s in order}, set(order), share * sum(sizes.values())
    while free:
        unit = Fraction(left, sum(weight[s] for s in free))
        above = {s for s in free if weight[s] * unit >= 2 * sizes[s]}
        if not above:
            return target | {s: weight[s] * unit for s in free}
        for s in above:
            target[s] = Fraction(2 * sizes[s])
            left -= target[s]
        free -= above
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check_mix(rows, docs, exact=True):
    """``rows`` with the sizes and targets of ``docs`` (id, source, text), and taken words near the targets."""
    sizes = Counter()
    for _, source, text in docs:
        sizes[source] += words(text)
    targets = brute_targets(sizes)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "", r[2])
    assert sorted(((r.doc_id, r.source, r.size) for r in rows), key=key) == sorted(((i, s, words(t)) for i, s, t in docs), key=key)
    taken, most = Counter(), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - float(targets[r.source])) <= 1e-9 * max(1, r.target)
        rate = targets[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert r.taken in (r.size * int(rate), r.size * -int(-rate // 1)) or r.taken in (r.size * int(rate), r.size * (int(rate) + 1))
        assert r.taken <= 2 * r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= max(most[s], 0.01 * float(targets[s])), s


def test_query_over_all_documents(spark):
    docs = [(r.doc_id, r.source, r.text) for r in table(spark, FOLDER, "documents").collect()]
    rows = QUERIES["op13_mixed_sources"](spark, FOLDER).collect()
    check_mix(rows, docs)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op13_mixed_sources"](spark, FOLDER).collect()))


def frame(spark, docs, parts=3):
    prepare(spark)
    rows = [(i, s, t, "own", 7, {"k": "v"}) for i, s, t in docs]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, target string, Size int, tags map<string, string>").repartition(parts)


def rows_of(spark, docs):
    from layerkit.session import stage

    sizes = stage(mixing.sized(frame(spark, docs)), "sizes")
    found = mixing.copies(sizes, stage(mixing.mixing_rates(sizes), "rates"))
    return found.withColumn("taken", F.col("size") * F.col("copies")).collect()


ODD = [
    (1, "b", "one two three"), (1, "b", "one two three"), (2, "b", None), (3, None, "x y\tz\x0bw"), (None, None, "no id"), (None, None, "no id"),
    (4, "", " \n "), (5, "é", "a b 　 c"), (6, "Z", "q " * 3000), (7, "z", ""), (8, "zero", None), (9, "\U0001f916", "w"), (10, "￮", "w w"),
]


def test_odd_documents(spark):
    check_mix(rows_of(spark, ODD), ODD)
    assert rows_of(spark, []) == []
    assert {r.copies for r in rows_of(spark, [(1, "a", ""), (2, None, None)])} == {0}


def test_mixed_rows_are_whole(spark):
    docs = [(i, f"s{i % 3}", "w " * (i % 7)) for i in range(200)]
    given_rows = frame(spark, docs)
    out = mixing.mix(given_rows)
    assert out.columns == given_rows.columns
    copies = {r.doc_id: r.copies for r in rows_of(spark, docs)}
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == Counter({i: c for i, c in copies.items() if c})
    assert {(r.doc_id, r.source, r.text) for r in out.collect()} <= set(docs)


def test_draw_is_the_hash_of_the_id(spark):
    row = frame(spark, [(12, "a", "t"), (None, "a", "t")]).select(mixing._draw_bits(F.col("doc_id"), F.col("text")).alias("bits")).collect()
    want = {int(hashlib.md5(k).hexdigest()[:13], 16) % ((1 << 31) - 1) for k in (b"12", b"t")}
    assert {r.bits for r in row} == want


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.text("abcé\U0001f600", max_size=3), st.integers(0, 10**7), max_size=12))
def test_targets_of_any_sizes(spark, sizes):
    prepare(spark)
    found = mixing.source_targets(spark.createDataFrame([*sizes.items()], "source string, size long")).collect()
    want = brute_targets(sizes)
    assert {r.source: r.source_size for r in found} == sizes
    assert all(abs(r.target - float(want[r.source])) <= 1e-9 * max(1.0, r.target) for r in found)


def test_share_above_what_there_is(spark):
    prepare(spark)
    sizes = spark.createDataFrame([("a", 10), ("b", 20)], "source string, size long")
    assert {r.source: r.target for r in mixing.source_targets(sizes, share=Fraction(5)).collect()} == {"a": 20.0, "b": 40.0}
