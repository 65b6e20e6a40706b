"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def local_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest row of each group) after joining rows a[i] and b[i]."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of these."""
    down = edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").filter("b != m").select(F.col("m").alias("a"), "b")
    return tied.unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of the edges (a, b): the label is the smallest node of its component.

    Rounds go on until a round changes nothing; each is written to the shared folder, so lineage stays short. An edge
    from a node to itself and repeated edges change nothing. No edges give no rows.
    """
    now = written(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = summary(now)
    while True:
        later = written(small_star(large_star(now)))
        after = summary(later)
        dropped(now)
        now = later
        if after == state:
            break
        state = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("label"))


def summary(edges: DataFrame) -> tuple:
    """Equal for equal edge sets, and else only by a collision of two sums of hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
