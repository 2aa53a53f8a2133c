"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialize


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node hands its larger neighbours the least node of its neighbourhood: (edges, the table of least nodes)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m")), "components")
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node hands its smaller neighbours, and itself, the least of them: (edges, the table of least nodes)."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = materialize(down.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), "components")
    moved = down.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct(), least


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(u, v); a component is its least node.

    Both stars only group by a node, with partial minima, and join its least neighbour
    back. The minima are written first: the join's sides are then exchanged as they are,
    and a hub's neighbours can be split over tasks. The edges are written after each
    round; the loop ends when neither star changes them, after a number of rounds that
    grows with the logarithm of the nodes. Loops and repeated edges change nothing;
    rows with a null end are left out; no edges give no rows.
    """
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, was = materialize(edges, "components"), None
    while True:
        large, least = _large_star(edges)
        large = materialize(large, "components")
        small, least2 = _small_star(large)
        old, edges = edges, materialize(small, "components")
        discard(old, large, least, least2)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == was:
            break
        was = now
    # now every edge leads from a node to its component
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
