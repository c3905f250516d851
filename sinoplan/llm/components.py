"""Connected components of a graph held as edges in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinoplan.llm.common import checkpointed


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """The smallest node of each node's component: columns node, root, for nodes that have an edge.

    Alternating stars: each node sends its larger neighbours to the smallest node it knows, then its
    smaller ones; the rounds are logarithmic in the number of nodes, and all that a node's
    neighbours come to is a minimum, so a node with very many of them is no burden. ``edges`` has
    columns a and b of one orderable type; loops and repeated edges do no harm.
    """
    stars = checkpointed(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(most_rounds):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        stars = checkpointed(small.distinct())
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
