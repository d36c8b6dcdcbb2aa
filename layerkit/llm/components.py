"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from layerkit.session import stage


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of an undirected link list.

    Each round hangs every node's larger neighbours on its smallest one, then
    its smaller ones (large star, small star), until nothing moves. Rounds are
    written to the shared folder, which cuts the lineage. Only minima per node
    are taken, and combined before the shuffle; no list of neighbours is built.
    Null ends and loops are left out; repeated links count once.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u != v").distinct()
    edges = stage(edges, "links")
    before = None
    for _ in range(most_rounds):
        edges = _small_star(_large_star(edges))
        edges = stage(edges, "links")
        # u hangs on v: nothing moves any more when every u has one v and no v hangs itself.
        now = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("mark")).first()
        if before == (now.n, now.mark):
            break
        before = (now.n, now.mark)
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node hangs on the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, hang on the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v")
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct()
