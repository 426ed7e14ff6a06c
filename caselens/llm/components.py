"""Connected components of an edge list, as rounds of Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node, which itself hangs on none: then a star is a component."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return seen.where("hangs > 1 OR (hangs = 1 AND holds = 1)").isEmpty()


def smallest_reachable(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """From (a, b) edges: (node, component) with the smallest node reachable.

    Large-star and small-star steps in turn: each node's neighbours are hung
    on the smallest of them, until the edges are stars around the smallest
    nodes. Every round is written to the shared folder, so a lost executor
    repeats one round at most; only the answer whether to go on visits the driver.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = storage.materialize(now, "edges")
    for _ in range(rounds):
        if _are_stars(now):
            break
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: every neighbour above a node hangs on the node's smallest neighbour.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        large = storage.materialize(large, "edges")
        # Small star: every node and its smaller neighbours hang on the smallest of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), "m").where("u > m").distinct()
        after = storage.materialize(small.select("u", F.col("m").alias("v")), "edges")
        storage.release(now, large)
        now = after
    else:
        raise RuntimeError(f"components still changed after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
