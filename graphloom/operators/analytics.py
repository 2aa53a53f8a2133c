"""Patterns and ranks of whole graphs: triangles, squares, PageRank.

Patterns are found in a simple graph whose vertices are ordered by degree, then id. A wedge is only
made where its centre is the least of its vertices (triangles) or less than one end (squares), so an
edge costs the smaller degree of its two ends, and a hub is never the centre of its neighbours' pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.operators.lineage import discard, materialize


def simple(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """u, v of each pair of vertices with an edge, u < v; loops and rows with a null end are left out."""
    ends = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    return ends.distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    """lo, hi, dlo, dhi of each edge (u, v): the ends in the order of (degree, id), with their degrees; written."""
    degree = pairs.select(F.explode(F.array("u", "v")).alias("x")).groupBy("x").agg(F.count("*").alias("d"))
    both = pairs.join(degree.withColumnsRenamed({"x": "u", "d": "du"}), "u").join(degree.withColumnsRenamed({"x": "v", "d": "dv"}), "v")
    u_first = F.expr("struct(du, u) < struct(dv, v)")
    pick = lambda yes, no: F.when(u_first, F.col(yes)).otherwise(F.col(no))
    return materialize(both.select(pick("u", "v").alias("lo"), pick("v", "u").alias("hi"), pick("du", "dv").alias("dlo"), pick("dv", "du").alias("dhi")), "ordered")


def triangles(edges: DataFrame) -> DataFrame:
    """x, y, z of each triangle of edges(src, dst), once, in the order of (degree, id).

    No vertex has more than the root of twice the edges behind it in that order, so wedges
    grow with the edges to the power of 1.5 at most, whatever the hubs. No edges, no rows.
    """
    e = _ordered(materialize(simple(edges), "pairs"))
    first, second = e.selectExpr("lo AS x", "hi AS y", "dhi AS dy"), e.selectExpr("lo AS x", "hi AS z", "dhi AS dz")
    wedges = first.join(second, "x").where("struct(dy, y) < struct(dz, z)").select("x", "y", "z")
    return wedges.join(e.selectExpr("lo AS y", "hi AS z"), ["y", "z"], "left_semi").select("x", "y", "z")


def triangle_counts(edges: DataFrame) -> DataFrame:
    """vid, degree, n_triangles and clustering (the share of its neighbours' pairs with an edge; null below two) of each vertex with an edge."""
    pairs = materialize(simple(edges), "pairs")
    degree = pairs.select(F.explode(F.array("u", "v")).alias("vid")).groupBy("vid").agg(F.count("*").alias("degree"))
    n = triangles(pairs.withColumnsRenamed({"u": "src", "v": "dst"})).select(F.explode(F.array("x", "y", "z")).alias("vid")).groupBy("vid").agg(F.count("*").alias("n"))
    found = degree.join(n, "vid", "left").select("vid", "degree", F.coalesce("n", F.lit(0)).alias("n_triangles"))
    return found.withColumn("clustering", F.expr("CASE WHEN degree > 1 THEN 2D * n_triangles / (degree * (degree - 1)) END"))


def _wedges(edges: DataFrame) -> DataFrame:
    """u, w, c: paths u - c - w where u is the greatest of the three in the order; all squares have two of each pair (u, w)."""
    e = _ordered(materialize(simple(edges), "pairs"))
    ends = e.selectExpr("lo AS c", "hi AS w", "dhi AS dw").unionByName(e.selectExpr("hi AS c", "lo AS w", "dlo AS dw"))
    up = e.selectExpr("lo AS c", "hi AS u", "dhi AS du")
    return up.join(ends, "c").where("struct(dw, w) < struct(du, u)").select("u", "w", "c")


def squares(edges: DataFrame) -> DataFrame:
    """u, w, n: pairs of opposite vertices, u the greatest of its squares, with n >= 2 common neighbours less than u: n (n - 1) / 2 squares.

    Each 4-cycle of edges(src, dst) is counted at one pair.
    """
    return _wedges(edges).groupBy("u", "w").agg(F.count("*").alias("n")).where("n > 1")


def square_counts(edges: DataFrame) -> DataFrame:
    """vid, n_squares of each vertex of a 4-cycle. Of n centres of a pair, each is in n - 1 of the pair's squares."""
    wedges = materialize(_wedges(edges), "wedges")
    pairs = materialize(wedges.groupBy("u", "w").agg(F.count("*").alias("n")).where("n > 1"), "squares")
    ends = pairs.select(F.explode(F.array("u", "w")).alias("vid"), F.expr("n * (n - 1) div 2").alias("k"))
    centres = wedges.join(pairs, ["u", "w"]).select(F.col("c").alias("vid"), (F.col("n") - 1).alias("k"))
    return ends.unionByName(centres).groupBy("vid").agg(F.sum("k").alias("n_squares"))


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-10, max_rounds: int = 100) -> DataFrame:
    """vid, rank of vertices(vid) and all ends of edges(src, dst[, weight]); the ranks sum to 1.

    A vertex hands its rank on by its edges' weights (1 without that column; parallel edges add
    up; what isn't above 0 is no edge); the rank of those without edges out is dealt to all. Each round is one job that joins the ranks with the
    shares, adds them up (partial sums first, so a hub's many rows are added where they are) and writes
    the ranks; what it observes while it writes, the change and the rank to deal, decides on the next.
    It ends when the change, summed over all, is at most tolerance, or after max_rounds.
    """
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.sum(F.when(weight > 0, weight)).alias("weight")).where("weight > 0")
    e = materialize(e, "pagerank")
    out = e.groupBy(F.col("src").alias("_src")).agg(F.sum("weight").alias("_out"))
    # written by source, so that a round's join finds each source's shares together
    shares = materialize(e.join(out, F.col("src") == F.col("_src")).select("src", "dst", (F.col("weight") / F.col("_out")).alias("share")).repartition("src"), "pagerank")
    vids = vertices.select("vid").where("vid IS NOT NULL").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("vid")).where("vid IS NOT NULL")).distinct()
    nodes = vids.join(out, F.col("vid") == F.col("_src"), "left").select("vid", F.col("_src").isNull().alias("ends"))
    nodes = materialize(nodes, "pagerank")
    n = nodes.count()
    if not n:
        return nodes.select("vid", F.lit(0.0).alias("rank"))
    ranks = materialize(nodes.withColumn("rank", F.lit(1.0 / n)), "pagerank")
    loose = ranks.agg(F.sum(F.when(F.col("ends"), F.col("rank")))).first()[0] or 0.0
    for _ in range(max_rounds):
        given = ranks.join(shares, F.col("vid") == F.col("src")).groupBy(F.col("dst").alias("_dst")).agg(F.sum(F.col("rank") * F.col("share")).alias("_given"))
        rank = F.lit((1 - damping) / n + damping * loose / n) + F.lit(damping) * F.coalesce("_given", F.lit(0.0))
        new = ranks.join(given, F.col("vid") == F.col("_dst"), "left").select("vid", "ends", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("change"))
        seen = Observation()
        old, ranks = ranks, materialize(new.observe(seen, F.sum("change").alias("change"), F.sum(F.when(F.col("ends"), F.col("rank"))).alias("loose")).drop("change"), "pagerank")
        discard(old)
        loose = seen.get["loose"] or 0.0
        if seen.get["change"] <= tolerance:
            break
    discard(e, shares, nodes)
    return ranks.select("vid", "rank")
