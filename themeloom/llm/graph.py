"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.tables import materialize


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Each edge ``(a > b)`` moved to the least neighbour of its end: large star or small star."""
    if both_ways:
        seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = edges
    least = seen.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    joined = seen.join(least, "a")
    if both_ways:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            joined.select("a", F.col("least").alias("b"))
        )
    return moved.where("a > b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the edges ``a, b``; the component is its least node.

    Edges whose ends are equal or null are ignored. Every round is written to the
    shared folder, so a lost executor costs one round at most. A hub's edges are
    combined before the shuffle; the join with its least neighbour has one row per
    node on one side, so a hub can be split there.
    """
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(ends.where("a > b").distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if seen == mark:
            break
        mark = seen
        now = materialize(_stars(_stars(now, True), False), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
