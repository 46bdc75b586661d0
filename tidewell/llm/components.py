"""Connected components by alternating large-star and small-star.

Every round is a few joins and partial aggregates over edges; nothing is collected.
Each round's edges are written to the shared folder, so lineage stays short and a lost
executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialise


def _least(edges: DataFrame) -> DataFrame:
    """u, m: the least of u and its neighbours v."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node goes to the least node of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least(both), F.col("u") == F.col("w")).where("v > u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below go to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (the least node reachable) for every node of ``edges`` (u, v longs).

    Nodes whose only edges are loops are left out, as are edges with a null. No edges
    give no rows. The number of rounds grows with the logarithm of a component's size.
    """
    edges = materialise(edges.select("u", "v").where("u <> v"), name)
    before = None
    while True:
        edges = materialise(small_star(large_star(edges)), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
