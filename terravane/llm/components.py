"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.texts import stage


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; ``root`` is the smallest node of the component.

    Each round hangs neighbours on smaller nodes; no neighbourhood is collected, only minima are.  Edges
    to itself and repeated edges do not matter.  Raises if ``rounds`` do not suffice (log n are expected).
    """
    now = stage(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: neighbours above a node go to the smallest one around it.
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        new = stage(small.filter("u != v").distinct(), "edges")
        # Done when every edge leads to a node that has no smaller neighbour.
        if new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            # A node may still hang on two roots.
            if new.groupBy("u").count().filter("count > 1").isEmpty():
                return new.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                    new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        now = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")
