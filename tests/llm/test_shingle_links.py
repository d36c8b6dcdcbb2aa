"""Near-duplicates by five-word shingles against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerkit.llm import shingle_links, simhash
from layerkit.llm.common import table
from tests.llm.conftest import ODD
from tests.llm.test_similarity import brute_fingerprint


def brute_set(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)


def alike_pairs(sets):
    """All pairs of 0.8 or more, by an index over shingles (every such pair shares one)."""
    holders, pairs = {}, set()
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = {}
    for found in holders.values():
        for i, j in combinations(found, 2):
            shared[i, j] = shared.get((i, j), 0) + 1
    for (i, j), n in shared.items():
        if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
            pairs.add((i, j))
    return pairs


def classes_of(texts):
    """Class of each text by links of fingerprints and of shingle sets, over all pairs."""
    prints = [brute_fingerprint(t) for t in texts]
    root = list(range(len(texts)))

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    distinct = {}
    for i, p in enumerate(prints):
        root[find(i)] = find(distinct.setdefault(p, i))
    for (p, i), (q, j) in combinations(distinct.items(), 2):
        if (p ^ q).bit_count() <= 2:
            root[find(i)] = find(j)
    for i, j in alike_pairs([brute_set(t) for t in texts]):
        root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def check_kept(kept, rows):
    """One row of each class stays: that of its smallest id."""
    classes = classes_of([t for _, t in rows])
    least = {}
    for (i, _), c in zip(rows, classes):
        least[c] = min(least.get(c, (True, 0)), (i is None, i or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(least.values())


def edited(words, share, draw):
    return " ".join(w if draw.random() > share else f"new{draw.randrange(10**9)}" for w in words)


def test_near_copies_of_all_lengths(docs):
    draw = random.Random(5)
    rows, n = list(ODD), 1000
    for length in (5, 6, 9, 15, 31, 33, 64, 90, 130, 255, 257, 400, 900, 3000):
        base = [f"w{draw.randrange(10**6)}" for _ in range(length)]
        for share in (0, 0.002, 0.01, 0.02, 0.03, 0.04, 0.06):
            rows.append((n, edited(base, share, draw)))
            # Cut and lengthened ones, across the levels of size.
            rows.append((n + 1, edited(base + [f"more{n}x{i}" for i in range(int(length * share * 3))], share / 2, draw)))
            n += 2
    draw.shuffle(rows)
    kept = simhash.one_of_each(docs(rows, 5)).collect()
    check_kept(kept, rows)


def test_a_hot_group_and_a_common_passage(docs):
    draw = random.Random(6)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, edited(base, 0.008, draw)) for i in range(400)]
    rows += [(1000 + i, " ".join(passage + [f"own{i}x{j}" for j in range(80)])) for i in range(300)]
    rows += [(2000 + i, " ".join(base)) for i in range(300)]
    kept = simhash.one_of_each(docs(rows, 7)).collect()
    check_kept(kept, rows)


def test_rows_that_go_and_stay(spark, docs):
    from layerkit.llm.common import prepare

    prepare(spark)
    long_text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long_text, {"k": 1}), (1, long_text, {"k": 2}), (2, long_text + " end", None), (3, "alone", {"k": 1}), (3, "alone", {"k": 1}), (4, None, None), (4, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row_key map<string, int>").repartition(3)
    out = simhash.one_of_each(frame)
    assert out.columns == frame.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]
    again = sorted((r.doc_id, str(r.row_key)) for r in simhash.one_of_each(frame).collect())
    assert again == sorted((r.doc_id, str(r.row_key)) for r in out.collect())
    assert simhash.one_of_each(docs([])).count() == 0


def test_sets_and_signatures():
    assert len(shingle_links.shingle_set(b"")) == 0 and len(shingle_links.signatures(shingle_links.shingle_set(b" \n"))) == 0
    same = shingle_links.shingle_set(b"A b C"), shingle_links.shingle_set(b"a\tB  c")
    assert (same[0] == same[1]).all() and len(same[0]) == 1
    assert shingle_links.node_of(same[0]) == shingle_links.node_of(same[1]) != 0 == shingle_links.node_of(shingle_links.shingle_set(b""))
    draw = random.Random(1)
    text = " ".join(draw.choice("abcdefg") for _ in range(300))
    assert len(shingle_links.shingle_set(text.encode())) == len(brute_set(text))


@pytest.mark.parametrize("size", [5, 20, 31, 32, 63, 100, 127, 128, 255, 256, 500, 511, 1000, 5000])
def test_sets_of_just_enough_in_common_share_a_signature(size):
    """Pairs right at the threshold: the share that has a signature in common."""
    rng = np.random.default_rng(size)
    hit = 0
    for _ in range(200):
        other = int(rng.integers(-(-size * 4 // 5), size * 5 // 4 + 1))
        both = -(-4 * (size + other) // 9)
        if both > min(size, other):
            both, other = size, size
        pool = rng.integers(0, 2**64, size + other - both, np.uint64)
        a, b = np.unique(pool[:size]), np.unique(pool[size - both :])
        hit += bool(np.intersect1d(shingle_links.signatures(a), shingle_links.signatures(b)).size)
    assert hit >= 197


@pytest.mark.parametrize("size", [1, 3, 10, 60, 300, 3000])
def test_sketches_rule_out_no_alike_sets(size):
    rng = np.random.default_rng(size)
    left = right = 0
    for _ in range(300):
        both = -(-8 * size // 9)
        pool = rng.integers(0, 2**64, 2 * size - both, np.uint64)
        far = rng.integers(0, 2**64, size, np.uint64)
        a, b = np.unique(pool[:size]), np.unique(pool[size - both :])
        rows = [np.frombuffer(shingle_links.sketch_of(x), np.uint8)[None] for x in (a, b, np.unique(np.append(a[: size // 3], far[size // 3 :])))]
        left += bool(shingle_links.may_be_alike(rows[0], rows[1])[0])
        right += bool(shingle_links.may_be_alike(rows[0], rows[2])[0])
    assert left == 300 and (size < 60 or right < 10)


def test_recall_over_all_documents(spark):
    """Every pair of documents of 0.8 or more, by all pairs that share a shingle, lies in one class."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check_kept(simhash.one_of_each(docs).select("doc_id").collect(), rows)
