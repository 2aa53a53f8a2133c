"""Registered queries of patterns, ranks, paths and as-of joins, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import analytics
from graphloom.operators.asof import asof_join
from graphloom.operators.graph import PropertyGraph
from graphloom.plans import driver_graph as D
from graphloom.plans.queries import _O, query

_P = """p AS (SELECT DISTINCT least(a.o_custkey, b.o_custkey) AS u, greatest(a.o_custkey, b.o_custkey) AS v
FROM orders AS a JOIN orders AS b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_custkey <> b.o_custkey)"""


@query(
    f"""WITH {_P}, d AS (SELECT x, count(*) AS degree FROM (SELECT u AS x FROM p UNION ALL SELECT v FROM p) GROUP BY x),
t AS (SELECT a.u AS x, a.v AS y, b.v AS z FROM p AS a JOIN p AS b ON b.u = a.v JOIN p AS c ON c.u = a.u AND c.v = b.v),
n AS (SELECT x, count(*) AS n FROM (SELECT x FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) GROUP BY x)
SELECT 'c:' || x AS vid, degree, coalesce(n, 0) AS n_triangles, round(CASE WHEN degree > 1 THEN 2.0::DOUBLE * coalesce(n, 0) / (degree * (degree - 1)) END, 9) AS clustering FROM d LEFT JOIN n USING (x)"""
)
def triangle_counts(spark, sf):
    """Triangles of the customers of consecutive orders."""
    return analytics.triangle_counts(D.direct_edges(spark, sf)).withColumn("clustering", F.round("clustering", 9))


@query(
    f"""WITH {_O}, a AS (SELECT x.person AS p, y.person AS q, count(*) AS n FROM o AS x JOIN o AS y ON x.connector = y.connector AND x.person <> y.person GROUP BY ALL),
b AS (SELECT x.connector AS p, y.connector AS q, count(*) AS n FROM o AS x JOIN o AS y ON x.person = y.person AND x.connector <> y.connector GROUP BY ALL)
SELECT p AS vid, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS n_squares FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE n > 1 GROUP BY p"""
)
def square_counts(spark, sf):
    """Pairs of persons who share pairs of offers: the 4-cycles of owners and connectors, by vertex."""
    return analytics.square_counts(D.offer_owners(spark, sf).select(F.col("person").alias("src"), F.col("connector").alias("dst")))


#: Rounds of the registered PageRank, so that SQL can do the same ones.
ROUNDS = 20
_STEP = """r{i} AS MATERIALIZED (SELECT vid, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(g, 0) + 0.85::DOUBLE / n * (SELECT coalesce(sum(rank), 0) FROM r{j} WHERE vid NOT IN (SELECT src FROM w)) AS rank
FROM v CROSS JOIN z LEFT JOIN (SELECT dst, sum(rank * share) AS g FROM r{j} JOIN s ON src = vid GROUP BY dst) ON dst = vid)"""


@query(
    """WITH w AS MATERIALIZED (SELECT 'c:' || a.o_custkey AS src, 'c:' || b.o_custkey AS dst, count(*) AS w FROM orders AS a JOIN orders AS b ON b.o_orderkey = a.o_orderkey + 1 GROUP BY ALL),
s AS MATERIALIZED (SELECT src, dst, w::DOUBLE / sum(w) OVER (PARTITION BY src) AS share FROM w),
v AS MATERIALIZED (SELECT 'c:' || c_custkey AS vid FROM customer UNION SELECT src FROM w UNION SELECT dst FROM w), z AS (SELECT count(*) AS n FROM v),
r0 AS MATERIALIZED (SELECT vid, 1.0::DOUBLE / n AS rank FROM v CROSS JOIN z), """
    + ", ".join(_STEP.format(i=i, j=i - 1) for i in range(1, ROUNDS + 1))
    + f" SELECT vid, round(rank, 10) AS rank FROM r{ROUNDS}"
)
def page_rank(spark, sf):
    """All customers by the orders that follow theirs, parallel edges weighing more; those without orders are dealt to."""
    g = D.hierarchy(spark, sf)
    found = analytics.pagerank(g.vertices.where("tag = 'person'"), D.direct_edges(spark, sf), tolerance=0.0, max_rounds=ROUNDS)
    return found.select("vid", F.round("rank", 10).alias("rank"))


@query(
    """WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT 'c:' || a.o_custkey AS src, 'c:' || b.o_custkey AS dst FROM orders AS a JOIN orders AS b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_custkey <> b.o_custkey),
g AS (SELECT 'c:' || min(o_custkey) AS a, 'c:' || max(o_custkey) AS b FROM orders),
h AS (SELECT a AS vid, 0 AS d FROM g UNION SELECT dst, d + 1 FROM h JOIN e ON src = vid WHERE d < 5), m AS MATERIALIZED (SELECT vid, min(d) AS d FROM h GROUP BY vid),
p AS (SELECT a AS vid, 0 AS d, a AS path FROM g UNION ALL SELECT dst, p.d + 1, path || '>' || dst FROM p JOIN e ON src = p.vid JOIN m ON m.vid = dst AND m.d = p.d + 1 JOIN g ON true JOIN m AS t ON t.vid = g.b WHERE p.d < t.d)
SELECT path FROM p JOIN g ON p.vid = g.b"""
)
def customer_paths(spark, sf):
    """All shortest paths, of five steps at most, from the first to the last customer along orders that follow each other."""
    ends = D.table(spark, sf, "orders").agg(F.min("o_custkey").alias("a"), F.max("o_custkey").alias("b")).first()
    edges = D.direct_edges(spark, sf).withColumn("edge_type", F.lit("RELATED_TO"))
    found = PropertyGraph(D.hierarchy(spark, sf).vertices, edges).shortest_paths(f"c:{ends.a}", f"c:{ends.b}")
    return found.select(F.array_join("path", ">").alias("path"))


@query(
    """WITH k AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL)
SELECT event_id, user_id, o_orderkey, o_orderdate FROM events ASOF LEFT JOIN k ON user_id = o_custkey AND ts >= o_orderdate"""
)
def events_asof_orders(spark, sf):
    """Each event with its customer's latest order by then."""
    orders = D.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumnRenamed("o_custkey", "user_id")
    return asof_join(D.table(spark, sf, "events").select("event_id", "user_id", "ts"), orders, ["user_id"], "ts", "o_orderdate", ["o_orderkey", "o_orderdate"]).drop("ts")


@query(
    """WITH s AS (SELECT l_partkey, l_shipdate, max(l_orderkey) AS prev_order FROM lineitem GROUP BY ALL)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, s.prev_order, s.l_shipdate AS prev_ship FROM lineitem AS l ASOF LEFT JOIN s ON l.l_partkey = s.l_partkey AND l.l_shipdate > s.l_shipdate"""
)
def lines_asof_shipments(spark, sf):
    """Each line with the latest earlier shipment of its part."""
    lines = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    earlier = lines.select("l_partkey", F.col("l_orderkey").alias("prev_order"), F.col("l_shipdate").alias("prev_ship"))
    return asof_join(lines, earlier, ["l_partkey"], "l_shipdate", "prev_ship", ["prev_order", "prev_ship"], allow_equal=False).drop("l_shipdate")
