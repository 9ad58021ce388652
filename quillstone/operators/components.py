"""Connected components of a graph by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.session import cut


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (the smallest member of each row's group) with the groups of each pair of rows made one. Every round joins each group that is not the smallest around to a smaller one."""
    root = root.copy()
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """Rows (node, component): the smallest node that each node is linked to. Nodes without an edge to another node are not listed.

    Each round links every node's neighbours to its smallest neighbour, so a path shortens by half; rounds
    grow with the logarithm of the diameter. Messages are pre-aggregated by ``min`` before the shuffle, and each round
    is cut by a reliable checkpoint. It ends when a round changes nothing; ``max_rounds`` without that is an error, never a partial result. Self-loops, nulls and repeated edges are ignored; an empty table gives no rows.
    """
    link = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    link = cut(link)
    before = None
    for _ in range(max_rounds):
        both = link.unionByName(link.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: neighbours above the node go to the smallest of its neighbourhood.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: neighbours below the node, and the node, go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        link = cut(small)
        now = link.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no convergence after {max_rounds} rounds")
    return link.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(link.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
