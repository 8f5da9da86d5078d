"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014).

Each step is a grouped minimum and a join on the node, so a node with very many neighbours is split by
the adaptive skew join, and no component ever meets in one task. Lineage is cut with a reliable
checkpoint after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenance_spark.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of u to the least of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Link u and its smaller neighbours to the least of them. Edges come as u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the least node it can reach.

    Self-loops, repeated and reversed edges change nothing; edges with a null end are ignored; no edges
    give no rows. Nodes without an edge aren't listed.
    """
    pairs = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u != v")
    now = cut_lineage(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, state = None, _state(now)
    while state != before and state[0]:
        now = cut_lineage(_small_star(_large_star(now)))
        before, state = state, _state(now)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
