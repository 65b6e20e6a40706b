"""Connected components of links between rows, by contraction to stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settled


def starred(links: DataFrame) -> DataFrame:
    """One contraction of `links` (a < b): neighbours of a node are tied to the least node that it sees, first the larger ones, then the smaller."""
    seen = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    up = seen.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").distinct()
    least = up.groupBy("b").agg(F.min("a").alias("m"))
    tied = up.join(least, "b").filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return tied.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def is_forest(links: DataFrame) -> bool:
    """Whether each node is either a centre or tied to a single one."""
    twice = links.groupBy("b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("b")
    both = links.select("a").distinct().join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select(F.col("a").alias("b"))
    return twice.unionByName(both).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """no, grupo of each node of the links (a, b): grupo is the least node of its component.

    A chain of n nodes takes a number of rounds that grows with the logarithm of n. Repeated links and links of a node to itself change
    nothing, links with a null are none; no links give no rows.
    """
    now = settled(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not is_forest(now):
        now = settled(starred(now))
    return now.select(F.col("b").alias("no"), F.col("a").alias("grupo")).unionByName(now.select(F.col("a").alias("no"), F.col("a").alias("grupo")).distinct())
