"""Connected components of an edge table, by large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def tasks(rows: int, each: int = 50_000) -> int:
    """Tasks for so many small rows. Spark's number of shuffle partitions is meant for texts: with it, each exchange of a few edges would be as many blocks as its square."""
    return max(8, -(-rows // each))


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node in edges (u, v) of any type that has an order.

    Every step is a join and two aggregations, whose large keys Spark splits or sums up before the shuffle; nothing is collected.
    """
    now = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        k = tasks(state[0])
        now = now.coalesce(k)
        if state == seen or not state[0]:
            # stars: every node but the centre is once on the left
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        down = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(k).distinct().coalesce(k)
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.withColumnsRenamed({"m": "v"}))
        now = checkpoint(small.coalesce(k).distinct().coalesce(k))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the local edges a-b: (smallest node, node)."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, (x, y) = np.arange(len(nodes)), flat.reshape(2, -1)
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new[label]]
        while (new[new] != new).any():
            new = new[new]
        if (new[x] == new[y]).all():
            label = new
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]
