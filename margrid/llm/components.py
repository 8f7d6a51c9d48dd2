"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margrid.llm.common import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Larger neighbours meet at the smallest place of a node's neighbourhood (``low``), itself included."""
    moved = _both(edges).where("b > a").join(low.select("a", F.least("a", "m").alias("m")), "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours meet at the smallest of them; edges go from larger to smaller."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """Table ``node, root`` for every node of ``links`` (columns a, b): root is the smallest node reached.

    Hot nodes are folded by ``min`` before any shuffle; joins on them are left to the skew handling of
    the optimizer. Rounds grow with the logarithm of the longest chain, and end as soon as every node has either
    one smaller neighbour or larger ones only: then all edges lead to roots. Nulls link nothing; no links, no rows.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while True:
        low = stored(_both(edges).groupBy("a").agg(
            F.min("b").alias("m"), F.count_if(F.col("b") < F.col("a")).alias("smaller"),
            F.count_if(F.col("b") > F.col("a")).alias("larger"),
        ))
        if low.where("smaller > 1 or smaller > 0 and larger > 0").isEmpty():
            # at a root all neighbours are larger; any other node has its root alone
            return low.select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        edges = stored(_small_star(_large_star(edges, low)))
