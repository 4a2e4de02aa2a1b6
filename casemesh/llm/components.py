"""Connected components of a graph given by its edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemesh.llm.common import Scratch, stored


def _stars(edges: DataFrame) -> DataFrame:
    """One round: hang larger neighbours, then smaller ones, on the least neighbour. Edges run child to parent."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = (both.where("v > u").join(least, "u").where("v <> m")
             .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    lower = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lower.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns ``u`` and ``v`` of one ordered type).

    ``component`` is the least node reachable. Edges with a null end or from a node to itself count for nothing;
    nodes without another edge are not in the result. Every round is a few shuffles with partial minima and is
    written to the shared folder in place of the one before; the number of rounds grows with the logarithm of the longest path. Only a row
    count and a checksum of each round reach the driver.
    """
    spark = edges.sparkSession
    held = Scratch(spark, "edges")
    now = held.put(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .distinct(), "edges")
    seen = _mark(now)
    while seen[0]:
        later = Scratch(spark, "stars")
        now = later.put(_stars(now), "stars")
        held.drop()
        held = later
        if (mark := _mark(now)) == seen:
            break
        seen = mark
    roots = now.select(F.col("v").alias("node")).distinct()
    found = stored(now.select(F.col("u").alias("node"), F.col("v").alias("component"))
                   .unionByName(roots.select("node", F.col("node").alias("component"))), "components")
    held.drop()
    return found
