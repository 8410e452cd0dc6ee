"""Connected components of a link table, as alternating star contractions over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketreach.session import stage


def _least(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour of each node; a partial minimum runs before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return (
        both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    ).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of these."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    least = _least(down)
    moved = down.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (u, v) that is not itself the smallest of its component.

    Rounds go on until every link leads straight to a root; the number of rounds grows with the
    logarithm of the component size. Each round is written to the shared folder, so a lost executor
    repeats one round at most. No links give an empty table.
    """
    now = stage(small_star(links.filter("u <> v")))
    while not now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
        now = stage(small_star(large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
