"""Connected components by alternating large and small stars.

Each round is two aggregations by vertex with map-side minima; results settle on
shared storage, so lineage stays short. Vertices are integers; an edge's end
labels may repeat. Components keep the smallest id that can be reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import forget, settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every larger (or, for small stars, every smaller) neighbour of a vertex to the least vertex around it."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    if large:
        linked = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of `edges` (u, v) that is not the least of its component."""
    now = settle(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark or not seen["n"]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        mark = (seen["n"], seen["h"])
        after = settle(_star(_star(now, True), False))
        forget(now)
        now = after
