"""Connected components by alternating star contraction, on DataFrames.

Each round joins edges with the smallest neighbour of a node (a map-side combined
minimum), so hubs never gather their neighbours in one place.  Rounds are written to the
shared folder and stop when every component is a star around its smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelattice.session import cut_lineage


def _contract(edges: DataFrame, scope: list[str], large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v."""
    if large:
        both = edges.select(*scope, "u", "v").union(edges.select(*scope, F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    low = both.groupBy(*scope, "u").agg(F.min("v").alias("_m"))
    low = low.withColumn("_m", F.least("_m", "u"))
    j = both.join(low, [*scope, "u"])
    if large:
        out = j.filter(F.col("v") > F.col("u")).select(*scope, F.col("v").alias("u"), F.col("_m").alias("v"))
    else:
        out = j.select(*scope, F.col("v").alias("u"), F.col("_m").alias("v")).union(
            low.select(*scope, "u", F.col("_m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, scope: list[str]) -> DataFrame:
    """(scope..., node, root) for every node that has an edge; root is the smallest member.

    ``edges`` has the scope columns plus a, b.  Components never cross scopes.
    """
    e = (edges.select(*scope, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
         .filter(F.col("u") != F.col("v")).distinct())
    e = cut_lineage(e)
    while True:  # each pair of star steps shortens every path, so the test below ends it
        ends = e.select(*scope, F.explode(F.array(
            F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
            F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x"))
        unfinished = ends.groupBy(*scope, "x.node").agg(F.sum("x.up").alias("up"), F.sum("x.down").alias("down")) \
            .filter("up > 1 or (up > 0 and down > 0)")
        if unfinished.isEmpty():
            roots = e.select(*scope, F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return e.select(*scope, F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        e = cut_lineage(_contract(_contract(e, scope, True), scope, False))
