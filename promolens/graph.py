"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """(node, component): every node of ``edges`` with the smallest node that it reaches.

    Alternating large-star and small-star rounds (Kiveris et al., 2014).  A round takes
    minima by aggregation and joins them back, so a hub's edges are never one group in
    one task.  Each round is written to the shared folder, which cuts lineage.
    Edges with a null end are ignored, loops make single nodes.
    """
    scratch = Scratch(edges.sparkSession, "components")
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    # every edge once, from the larger to the smaller node; a loop stays for its node
    at, path = scratch.put(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    scratch.expect(at.count(), 200_000)
    for _ in range(most_rounds):
        both = at.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        near, near_path = scratch.put(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.max("b").alias("far")))
        # a node below all its neighbours is a root, one with a single neighbour a leaf: all stars
        if not near.where("m < a AND m < far").take(1):
            return near.select(F.col("a").alias("node"), F.col("m").alias("component"))
        # large star: each larger neighbour, and a root itself, points to the least node around
        large = both.where("b >= a").join(near, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: each smaller neighbour, and the node itself, points to the least of them
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        new, new_path = scratch.put(small.select("e.a", "e.b").distinct())
        scratch.drop(path)
        scratch.drop(near_path)
        at, path = new, new_path
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
