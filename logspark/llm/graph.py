"""Connected components of a large graph: alternating large-star and small-star rounds over edge tables.

Nothing about nodes or edges reaches the driver but one count a round. Every round's edges are a table in
the shared folder, so a lost executor costs one round's work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b long) -> (node, component): every node that has an edge, with the least node it reaches.

    Self links and repeated edges are harmless; edges with a null end are left out; no edges give no rows.
    """
    spark = edges.sparkSession
    now, path = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        after, new = materialize(_small_star(_large_star(now)), "edges")
        drop_path(spark, path)
        now, path = after, new
        # At the end all stars are kept as they are; count and two hashes tell.
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first()
        if tuple(mark) == before:
            roots = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return roots.union(roots.select(F.col("component").alias("node"), "component").distinct())
        before = tuple(mark)
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")
