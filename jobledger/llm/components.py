"""Connected components over links held as a DataFrame, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobledger.llm.tables import checkpoint


#: Nodes with more than a HUBS-th of all link ends are hubs; there can't be more than HUBS.
HUBS = 4096
#: Links that one task may hold without ado; with so few, a hub is an ordinary node.
FEW = 1 << 17


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_least(links: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """Links with the least neighbour m of their u.  A hub's rows stay where they are and get m from a broadcast of HUBS rows at most, so no task gets them all."""
    if ends <= FEW:
        return links.join(least.select("u", "m"), "u")
    limit = ends // HUBS
    hubs = F.broadcast(least.where(F.col("n") > limit).select("u", F.col("m").alias("hub")))
    marked = links.join(hubs, "u", "left")
    others = marked.where("hub is null").select("u", "v").join(least.where(F.col("n") <= limit).select("u", "m"), "u")
    return marked.where("hub is not null").select("u", "v", F.col("hub").alias("m")).unionByName(others.select("u", "v", "m"))


def _large_star(links: DataFrame, ends: int) -> DataFrame:
    near = _both_ways(links)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _with_least(near.where("v > u"), least, ends).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame, ends: int) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return _with_least(down, least, ends).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node that can be reached.

    Links never leave the executors: each round is two joins on nodes, lineage is
    cut by checkpoint(), and it ends when a round changes nothing.  The number of
    rounds grows with the logarithm of the longest chain.  No links: no rows.
    """
    now = checkpoint(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    told, n = None, now.count()
    while True:
        now = checkpoint(_small_star(_large_star(now, 2 * n), n))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == told:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        told, n = state, state[0]


def label_components(n: int, i: np.ndarray, j: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Smallest member reachable, for nodes 0..n-1 within one task; `start` continues earlier labels."""
    label = np.arange(n) if start is None else start
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            break
        i, j = i[apart], j[apart]
        low, high = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label
