"""Connected components of a table of links, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carequeue.operators.shared import written


def _both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    near = _both_ways(links)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    down = down.where("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        least.select("u", F.col("m").alias("v"))
    )


def _unsettled(links: DataFrame) -> int:
    """Nodes that hang on two others, or on one and have others hanging on them."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(links.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up + down > 1 and up > 0").count()


def settled(links: DataFrame) -> DataFrame:
    """(u, v) for every node u that is not the least of its component, with the least, v.

    ``links``: pairs of longs (u, v). Alternating large and small stars hook every node to
    the least one it can see, so that the number of rounds grows with the logarithm of the
    longest chain. Each round's links are written; the driver sees a count. Rounds end when
    every node hangs on one that hangs on none: stars would leave such links as they are.
    """
    current = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = written(current.distinct(), "links")
    while _unsettled(current):
        current = written(_small_star(_large_star(current)).distinct(), "links")
    return current


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; the component is its least node."""
    stars = settled(links)
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
