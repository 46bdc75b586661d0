"""Link ranks by iteration (L. Page et al., 1998), not normalised.

Ranks start at 1; a round gives each page 0.15 plus 0.85 of what its neighbours pass
on; targets that are no pages get nothing. Edges with their shares are written once, so
executors may be lost; a round joins them with the ranks and shuffles partial sums by target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialise

DAMPING, REST = 0.85, 0.15


def links(edges: DataFrame) -> DataFrame:
    """Distinct edges (src, dst), loops included, with the share of a rank that each passes on."""
    clean = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    degree = clean.groupBy(F.col("src").alias("s")).agg((F.lit(DAMPING) / F.count("*")).alias("share"))
    return clean.join(degree, F.col("src") == F.col("s")).select("src", "dst", "share")


def start(pages: DataFrame) -> DataFrame:
    return pages.select("id").distinct().select("id", F.lit(1.0).alias("rank"))


def step(nodes: DataFrame, ranks: DataFrame, shares: DataFrame) -> DataFrame:
    """id, rank of the next round. ``ranks`` occurs once, so that the plan of n rounds
    grows with n; what does not change from round to round is ``nodes``."""
    passed = shares.join(ranks, shares.src == ranks.id).groupBy(F.col("dst").alias("target")).agg(F.sum(F.col("rank") * F.col("share")).alias("sum"))
    return nodes.join(passed, nodes.id == passed.target, "left").select("id", (F.coalesce("sum", F.lit(0.0)) + REST).alias("rank"))


def rounds(pages: DataFrame, edges: DataFrame, n: int, state: DataFrame | None = None) -> DataFrame:
    """id, rank after n rounds, from the start or from a saved state (id, rank). What does
    not change from round to round is written once."""
    shares = _by_source(edges)
    nodes = materialise((pages if state is None else state).select("id").distinct(), "rank-nodes")
    ranks = state.select("id", "rank") if state is not None else start(nodes)
    for _ in range(n):
        ranks = step(nodes, ranks, shares)
    return ranks


def _by_source(edges: DataFrame) -> DataFrame:
    return materialise(links(edges), "rank-links")


def converge(pages: DataFrame, edges: DataFrame, threshold: float = 0.01, most: int = 100) -> tuple[DataFrame, int]:
    """Ranks once no rank changes by ``threshold`` or more, and the number of rounds.
    Each round is written to the shared folder: lineage stays one round long."""
    shares, nodes = _by_source(edges), materialise(pages.select("id").distinct(), "rank-nodes")
    ranks, n = start(nodes), 0
    while n < most:
        before = ranks.select(F.col("id").alias("node"), F.col("rank").alias("previous"))
        ranks = materialise(step(nodes, ranks, shares), "ranks")
        n += 1
        change = ranks.join(before, F.col("id") == F.col("node")).agg(F.max(F.abs(F.col("rank") - F.col("previous")))).first()[0]
        if change is None or change < threshold:
            break
    return ranks, n
