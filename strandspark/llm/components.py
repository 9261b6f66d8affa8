"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.llm.common import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for the nodes of edges (u, v), integers; root: the smallest node that can be reached.

    Rounds of two steps: each node's larger neighbours are linked to its smallest neighbour, then its smaller
    neighbours are. The number of edges does not grow and the rounds go with the logarithm of the longest path. The
    smallest neighbour is an aggregate, combined before the shuffle, and joined back, so that Spark can split a node
    with many edges. Each round is written to the shared folder. Loops and repeated edges do no harm.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).filter("u <> v").distinct())
        state = tuple(now.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
