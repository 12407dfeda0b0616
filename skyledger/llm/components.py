"""Connected components of an edge table by alternating stars.

Each round points the larger neighbours of every node at the smallest one
(large star), then the smaller ones (small star); a round is one stored table,
and the rounds end when a table repeats. Minima are partial aggregates and the
rest are equi joins, so a node with very many edges needs no task of its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


class PlaceForest:
    """Union of array places, the smallest place of a tree as its root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root[:] = root[root]


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _star_round(edges: DataFrame) -> DataFrame:
    """edges (u, v) with u > v, distinct; the same components, nearer to stars."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minimum(both).select("u", F.least("u", "m").alias("m"))
    large = (both.join(least, "u").where(F.col("v") > F.col("u"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    low = _minimum(large)
    return (large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                      F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` of every node that has an edge; the root is the least node reachable.

    Loops, repeated edges and null ends are ignored; no edges give no rows.
    """
    ends = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
            .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    now = store(ends, "edges")
    state = _state(now)
    while state[0]:
        new = store(_star_round(now), "edges")
        before, state, now = state, _state(new), new
        if state == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
