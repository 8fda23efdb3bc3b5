"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinix.llm._shared import written


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(v, root): for every vertex of edges(a, b) one vertex of its component, the same for all of them.

    Each round every vertex moves to the lowest vertex next to it, twice over;
    edges between the places are kept, once each.  Vertices should be hashes:
    then a round removes a share of them on average, whatever the shape, and a
    hub's edges are pre-aggregated.  Nothing is collected; each round is written.
    """
    left = written(edges.where("a <> b").select("a", "b").distinct(), f"{folder}/edges-0")
    found = written(left.select(F.col("a").alias("v")).union(left.select("b")).distinct().withColumn("root", F.col("v")), f"{folder}/roots-0")
    k = 0
    while not left.isEmpty():
        k += 1
        both = left.union(left.select("b", "a"))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("m")), f"{folder}/low-{k}")
        to = low.select(F.col("x").alias("m"), F.col("m").alias("m2"))
        moved = written(low.join(to, "m").select("x", F.col("m2").alias("m")), f"{folder}/moved-{k}")
        a, b = (moved.select(F.col("x").alias(c), F.col("m").alias(f"{c}m")) for c in "ab")
        left = written(left.join(a, "a").join(b, "b").where("am <> bm").select(F.least("am", "bm").alias("a"), F.greatest("am", "bm").alias("b")).distinct(), f"{folder}/edges-{k}")
        found = written(found.join(moved.select(F.col("x").alias("root"), "m"), "root", "left").select("v", F.coalesce("m", "root").alias("root")), f"{folder}/roots-{k}")
    return found
