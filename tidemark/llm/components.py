"""Connected components of an edge table, by alternating large and small stars.

Each round points nodes at the smallest node they can see; hubs are reached through
a minimum that is combined on the map side, so no neighbourhood is ever collected.
Rounds end in written tables, and their number grows with the logarithm of a chain.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemark.session import cut


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    # every edge points down: u > v
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    lower = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(lower).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, of all nodes but the roots.

    Loops, repeated edges and edges with a null end are ignored; no edges give no rows.
    """
    e = cut(edges.filter(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while (now := _state(e)) != before:
        before = now
        e = cut(_small(_large(e)))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges as stars: every node of a component but the smallest, and the smallest."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[:len(a)], at[len(a):]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]
