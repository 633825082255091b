"""Connected components of links, by alternating large-star and small-star steps.

Both steps are joins of the links with the smallest neighbour per node, a partial
aggregation, so a node with very many links is split like any skewed join key. Each
step's links are written to the shared folder. Nothing is collected but two numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelherd.session import materialize


def _joined(links: DataFrame) -> DataFrame:
    """Rows (u, v, m): every link with the smallest v of its u."""
    least = materialize(links.groupBy("u").agg(F.min("v").alias("m")))
    return links.join(least, "u")


def large_star(links: DataFrame) -> DataFrame:
    """Connect larger neighbours of each node to its smallest neighbour or itself."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = _joined(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return materialize(out.distinct())


def small_star(links: DataFrame) -> DataFrame:
    """Connect smaller neighbours of each node, and the node, to the smallest of them."""
    joined = _joined(links)
    out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return materialize(out.unionByName(joined.select("u", F.col("m").alias("v"))).distinct())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of all nodes of ``a``, ``b`` but the roots.

    Links of a node to itself are ignored; repeated and reversed links do no harm.
    """
    now = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = materialize(now.distinct())
    state = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = mark
        now = small_star(large_star(now))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest node of its component, for links in memory."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        for side in (left, right):
            np.minimum.at(new, root[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]
