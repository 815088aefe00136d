"""Connected components by alternating large-star and small-star steps.

Each step is an aggregation and a join over edges; edges never grow in number beyond
those given plus one per vertex, hubs are joined by the smallest neighbour that an
aggregation found, and nothing is collected but one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with v < u. The neighbours of each vertex move to its smallest one."""
    if large:
        sides = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges
    least = sides.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    moved = sides.join(least, "u")
    out = moved.filter("v > u" if large else "v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("least").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex with a link; the smallest id names a component."""
    a, b = links.columns
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = stored(edges, "components")
    state = None
    while True:
        before, edges = edges, stored(_star(_star(edges, True), False), "components")
        discard(before)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    )
