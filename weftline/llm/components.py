"""Connected components of an edge table, by rounds of star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize, release


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of ``n`` nodes reaches by edges ``a[i]`` - ``b[i]``."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) with the components of the given edges."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = roots(at[: len(a)], at[len(a) :], len(nodes))
    away = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[away], nodes[root[away]]


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches; roots included.

    Rounds of large-star and small-star: each node's neighbours are tied to its smallest
    one. Every round is written to the shared folder, so lineage stays short, and the round
    before is removed; only a count and a checksum reach the driver. A node with very many neighbours is a key of joins
    that adaptive execution splits; minima are pre-aggregated.
    """
    now = materialize(edges.where("a <> b").distinct(), "edges")
    before = None
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("x"), "a", "m")
        tied = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        done, now = now, materialize(tied.where("a <> b").distinct(), "edges")
        release(done)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    root = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())
