"""Connected components of a large edge table by alternating stars, each round one written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentmeter.llm.common import written


def _star(edges: DataFrame, large: bool, lowest: DataFrame) -> DataFrame:
    """Neighbours of u hang on u's smallest one. edges: (u, v) in both directions; lowest: (u, m), m the least of u and its
    neighbours. large: neighbours above u; else those below, and u itself."""
    met = edges.join(lowest, "u")
    if large:
        return met.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    below = met.where(F.col("v") < F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = lowest.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return below.unionByName(own)


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node that can be reached.

    Rounds go on until the edge table is a set of stars that no longer changes; the number of rounds grows with the
    logarithm of the longest chain. Hubs are met through a written table of least neighbours, so a join on a hub's key is a
    plain one that Spark can split. Null ends and loops are dropped; an empty table gives no rows.
    """
    now = written(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        for large in (True, False):
            both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
            lowest = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "lowest")
            star = _star(both, large, lowest)
            now = written(star.where("a <> b").distinct(), "edges")
        before, mark = mark, _mark(now)
        if before == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free digest of the edge set."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
