"""Operator 5: near-duplicates by SimHash, with bit counts of segments as an embedding.

Flipping one bit of a fingerprint changes one segment's count by one, so the
Manhattan distance of two count vectors never exceeds the Hamming distance.
Fingerprints that may be linked are found by a range join in the grid of count
vectors and verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from layerkit.llm import shingle_links
from layerkit.llm.common import begin, map_arrow, texts_of
from layerkit.llm.components import connected_components
from layerkit.session import stage

BITS = 64
# Bits of one segment, and groups of segments that make the axes of the grid.
SEGMENT = 2
GROUPS = 5
# Fingerprints of one cell that are compared with one another; fuller cells take the way of close_by_flips.
FULL_CELL = 256
# Row keys that are broadcast at most: some 20 bytes each.
SENT_KEYS = 1_000_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of the shingles of one text: a bit is set if it is set in over half of their XXH64 values (seed 42)."""
    found = text.translate(_LOWER).split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]
    n = max(1, len(found) - words + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # bits of a very long text piece by piece
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(texts: DataFrame, words: int = 3) -> DataFrame:
    """``texts`` with ``fp``, the 64 bits as a long, in place of ``text``; a null or blank text has the fingerprint zero."""
    kept = [c for c in texts.columns if c != "text"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        begin("simhash")
        found = np.array([fingerprint(t, words) for t in texts_of(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.int64())], names=[*kept, "fp"])

    schema = ", ".join(f"{c} {kind}" for c, kind in texts.dtypes if c != "text")
    return map_arrow(texts, run, f"{schema}, fp long")


def segment_counts(fp: Column) -> list[Column]:
    """Number of set bits in each segment."""
    mask = (1 << SEGMENT) - 1
    return [F.bit_count(F.shiftrightunsigned(fp, i).bitwiseAND(F.lit(mask))) for i in range(0, BITS, SEGMENT)]


def _groups() -> list[list[int]]:
    """Segments dealt into the groups: neighbours lie in one group."""
    return [list(map(int, g)) for g in np.array_split(np.arange(BITS // SEGMENT), GROUPS)]


def cells(distinct: DataFrame, most: int) -> DataFrame:
    """Each fingerprint in the cells where it can meet another within distance ``most``.

    Two count vectors within Manhattan distance ``most`` agree exactly on all but
    ``most`` of the groups. So the grid has one plane for each choice of groups
    that agree, and a cell is one value of their counts.
    """
    if not 0 <= most < GROUPS:
        raise ValueError(f"distance from 0 to {GROUPS - 1}")
    counts = segment_counts(F.col("fp"))
    width = SEGMENT.bit_length()
    packed = [
        reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(counts[s].cast("long"), width * i) for i, s in enumerate(group)])
        for group in _groups()
    ]
    planes = [
        F.struct(F.lit(p).alias("plane"), F.xxhash64(F.lit(p), *[packed[g] for g in chosen]).alias("cell"))
        for p, chosen in enumerate(combinations(range(GROUPS), GROUPS - most))
    ]
    return distinct.select("fp", F.explode(F.array(*planes)).alias("at")).select("fp", "at.plane", "at.cell")


def _spanning(values: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that connect what distances up to ``most`` connect, among the fingerprints of one cell."""
    bits = values.view(np.uint64)
    counts = np.zeros((len(bits), BITS // SEGMENT), np.int8)
    for i in range(BITS // SEGMENT):
        counts[:, i] = np.bitwise_count((bits >> np.uint64(i * SEGMENT)) & np.uint64((1 << SEGMENT) - 1))
    root = list(range(len(bits)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i in range(len(bits) - 1):
        near = np.flatnonzero(np.abs(counts[i + 1 :] - counts[i]).sum(axis=1) <= most) + i + 1
        near = near[np.bitwise_count(bits[near] ^ bits[i]) <= most]
        for j in near.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[b] = a
                links.append((int(values[i]), int(values[j])))
    return links


def close_in_cells(members: DataFrame, most: int) -> DataFrame:
    """Links ``a``, ``b`` among the members of each cell; a cell's links are a spanning forest of what is close."""
    lists = members.groupBy("plane", "cell").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        links = [x for fps in batch.column("fps") for x in _spanning(np.sort(fps.values.to_numpy(zero_copy_only=False)), most)]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return map_arrow(lists, run, "a long, b long")


def close_by_flips(distinct: DataFrame, most: int) -> DataFrame:
    """Links that connect what a distance of 2 or 1 connects, at 65 rows per fingerprint however full a cell is.

    Two fingerprints differ in at most two bits exactly if some word is within
    one bit of both: all that meet at such a word (65 at most) are linked to the
    smallest. They differ in one bit exactly if one is such a word of the other.
    """
    if most not in (1, 2):
        raise ValueError("distances above 2 need another way")
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), i) for i in range(BITS)])
    met = distinct.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    met = met.groupBy("word").agg(F.min("fp").alias("low"), F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    if most == 1:
        met = met.where(F.array_contains("fps", F.col("word"))).withColumn("low", F.col("word"))
    return met.select(F.explode("fps").alias("a"), F.col("low").alias("b")).where("a != b").distinct()


def near_links(distinct: DataFrame, most: int = 2, full_cell: int = FULL_CELL) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints that connect the same classes as all pairs within ``most`` bits.

    Cells with up to ``full_cell`` members are compared within; the members of
    fuller cells go through :func:`close_by_flips`, which finds every link among
    them. So no cell, however hot, makes more than a bounded piece of work.
    """
    placed = stage(cells(distinct, most), "cells")
    sizes = placed.groupBy("plane", "cell").agg(F.count("*").alias("n")).where(F.col("n") > full_cell)
    full = stage(sizes.select("plane", "cell"), "full-cells")
    if full.isEmpty():
        return close_in_cells(placed, most)
    marked = placed.join(full.withColumn("full", F.lit(True)), ["plane", "cell"], "left")
    rest = marked.where("full is null").select("fp", "plane", "cell")
    hot = marked.where("full").select("fp").distinct()
    return close_in_cells(rest, most).unionByName(close_by_flips(hot, most))


def classes(found: DataFrame, most: int = 2) -> DataFrame:
    """``found`` (staged rows with ``doc_id`` and ``fp``) with ``component_id`` and ``root`` of each row's class.

    ``component_id`` is the smallest id reachable; ``root``, a fingerprint,
    names the class even where all its ids are null.
    """
    distinct = stage(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = stage(connected_components(near_links(distinct.select("fp"), most)), "roots")
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stage(placed.join(smallest, "root").select("fp", "root", "component_id"), "classes")
    return found.join(named, "fp")


def near_duplicates(
    docs: DataFrame, most: int = 2, words: int = 3, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Class of near-duplicates of every row.

    Returns ``doc_id``, ``fingerprint`` (16 lowercase hex digits) and
    ``component_id``, the smallest id reachable over links of at most ``most``
    differing bits. Equal fingerprints are one node, so copies cost nothing
    beyond their own row. Rows without any word share the fingerprint zero and
    are linked like any other. A null id is kept but never is the smallest; a
    class of null ids only has a null component. Repeated rows stay.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    joined = classes(stage(fingerprints(texts, words), "fingerprints"), most)
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _links_of_texts(found: DataFrame, most: int) -> DataFrame:
    """Links ``a``, ``b`` between nodes that connect what fingerprints link: equal ones, and those within ``most`` bits."""
    of_fp = stage(found.groupBy("fp").agg(F.min("node").alias("low")), "distinct-fingerprints")
    equal = found.select("fp", F.col("node").alias("a")).distinct().join(of_fp, "fp").select("a", F.col("low").alias("b"))
    close = near_links(of_fp.select("fp"), most)
    ends = [of_fp.select(F.col("fp").alias(c), F.col("low").alias(f"low_{c}")) for c in ("a", "b")]
    near = close.join(ends[0], "a").join(ends[1], "b").select(F.col("low_a").alias("a"), F.col("low_b").alias("b"))
    return equal.unionByName(near).where("a != b").distinct()


def _sent(keys: DataFrame) -> DataFrame:
    """Written row keys, for all tasks where they are few, so that the texts they meet are not shuffled; counted first."""
    return F.broadcast(keys) if keys.count() <= SENT_KEYS else keys


def one_of_each(docs: DataFrame, most: int = 2, words: int = 3) -> DataFrame:
    """The rows of ``docs`` (columns as they are) of which each class of near-duplicates keeps one.

    Two texts are linked if their fingerprints differ in ``most`` bits at most (operator 5), or if their sets of
    five-word shingles are alike by 0.8 or more (:mod:`shingle_links`), which fingerprints alone do not tell; classes go
    over links of both kinds. The row of the smallest id stays, null ids last; among rows of that id the one with the
    smallest hash. Rows equal in all columns are one row. What goes is found from keys, so texts are read twice (those
    of candidates three times) and shuffled only where there are over a million keys to look for.
    """
    columns = [F.col(f"`{c}`").cast("string") if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(*columns).alias("x"), F.hash(*columns).alias("h"))
    texts = docs.select(F.col("text").cast("string").alias("text"), key.alias("row"))
    mark = lambda text: int(np.array([fingerprint(text, words)], np.uint64).view(np.int64)[0])
    pass_one = stage(shingle_links.described(texts, ["row"], {"fp": ("long", mark)}), "described")
    found = pass_one.where("kind = 0").select("row", "fp", "node", "sketch")
    sent = pass_one.where("kind = 1").select("signature", "node", "size")
    met = pass_one.where("kind = 2").select(F.col("node").alias("a"), F.col("other").alias("b"))
    pairs = stage(met.unionByName(shingle_links.candidate_pairs(sent)).distinct(), "candidate-pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    first = found.join(needed, "node", "left_semi").groupBy("node").agg(F.min(F.struct("row", "sketch")).alias("first"))
    first = stage(first.select("node", "first.row", "first.sketch"), "candidates")
    pairs = stage(shingle_links.likely(pairs, first), "likely-pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = stage(first.join(needed, "node", "left_semi").select("node", "row"), "likely-rows")
    # Rows equal in all columns have one key: any of them has the text.
    theirs = texts.join(_sent(rows), "row").select("node", "text").dropDuplicates(["node"])
    alike = shingle_links.alike(pairs, theirs)
    links = alike.unionByName(_links_of_texts(found, most))
    roots = stage(connected_components(links), "roots")
    rooted = found.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stays = rooted.groupBy("root").agg(F.min("row").alias("row")).select("row")
    once = found.groupBy("row").agg((F.count(F.lit(1)) > 1).alias("repeated")).join(stays.withColumn("stays", F.lit(True)), "row", "left")
    once = stage(once.where("stays is null or repeated").select("row", F.coalesce("stays", F.lit(False)).alias("stays")), "rows-that-go")
    taken = {c.lower() for c in docs.columns}
    own = "row_key"
    while own in taken:
        own += "_"
    keyed = docs.withColumn(own, key)
    gone, twice = once.select(F.col("row").alias(own)), once.where("stays").select(F.col("row").alias(own))
    kept = keyed.join(_sent(gone), own, "left_anti")
    again = keyed.join(_sent(twice), own, "left_semi").dropDuplicates([own])
    return kept.unionByName(again).drop(own)
