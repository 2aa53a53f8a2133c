"""Registered queries of networks, evidence, imports and summaries, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import records
from graphloom.functions import text as T
from graphloom.operators import evidence as E
from graphloom.operators import network as N
from graphloom.operators import projection as P
from graphloom.operators import resolution as R
from graphloom.operators import views
from graphloom.operators.lineage import scratch
from graphloom.operators.graph import PropertyGraph
from graphloom.plans import driver_graph as D
from graphloom.plans.queries import _DR, _E, _L, _S, _U, _V, query
from graphloom.sinks import catalog, graph_store
from graphloom.sources import csv_import, csv_profile

_ALL = 2_000_000_000  # persons: no truncation


# ---- networks


def _sources(spark, sf, bridges: bool = False) -> N.Sources:
    """Customers, the offers they share, and how orders and line numbers connect them, stored by buckets once a session."""

    def made() -> N.Sources:
        direct = D.direct_edges(spark, sf).withColumn("edge_type", F.lit("RELATED_TO"))
        between = D.bridge_edges(spark, sf).withColumn("edge_type", F.lit("PAYS"))
        persons = D.table(spark, sf, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey")).alias("vid"))
        return N.Sources(D.offer_owners(spark, sf), direct, between, persons)

    found = D.stored(spark, sf, "offers", made)
    return found if bridges else replace(found, bridges=None)


def _links(net: N.Network) -> DataFrame:
    return net.links().drop("label")


@query(
    f"""WITH RECURSIVE {_S}, {_DR}, y AS (SELECT p1 AS a, p2 AS b FROM s UNION SELECT p2, p1 FROM s UNION SELECT p1, p2 FROM dr UNION SELECT p2, p1 FROM dr),
h AS (SELECT 'c:1' AS vid, 0 AS d UNION SELECT b, d + 1 FROM h JOIN y ON a = vid WHERE d < 2), g AS (SELECT vid, min(d) AS d FROM h GROUP BY vid),
cl AS (SELECT connector, 1 + min(d) AS lv FROM o JOIN g ON vid = person GROUP BY connector),
r AS (SELECT p1, p2, connector AS k, confidence, lv FROM s JOIN cl USING (connector) UNION ALL SELECT p1, p2, 'direct', confidence, 1 + least(coalesce(a.d, 9), coalesce(b.d, 9)) FROM dr LEFT JOIN g AS a ON a.vid = p1 LEFT JOIN g AS b ON b.vid = p2),
f AS (SELECT *, min(lv) OVER (PARTITION BY p1, p2) AS degree, row_number() OVER (PARTITION BY p1, p2, k ORDER BY lv) AS i FROM r WHERE lv <= 2)
SELECT p1, p2, degree, count(*) AS via_count, round(1 - product(1 - confidence), 4) AS confidence FROM f WHERE (lv = degree OR i = 1) AND p1 IN (SELECT vid FROM g) AND p2 IN (SELECT vid FROM g) GROUP BY p1, p2, degree"""
)
def person_network(spark, sf):
    return _links(N.person_network(_sources(spark, sf), "c:1", 2, max_persons=_ALL))


@query(
    f"""WITH {_S}, {_DR}, near AS (SELECT connector FROM o WHERE person = 'c:1'),
b AS (SELECT DISTINCT 'o:' || x.l_partkey || ':' || x.l_suppkey AS src, 'o:' || y.l_partkey || ':' || y.l_suppkey AS dst FROM lineitem AS x JOIN lineitem AS y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1),
w AS (SELECT src AS this, dst AS other FROM b WHERE src <> dst UNION ALL SELECT dst, src FROM b WHERE src <> dst),
r AS (SELECT p1, p2, confidence FROM s WHERE connector IN (FROM near) UNION ALL SELECT p1, p2, confidence FROM dr WHERE 'c:1' IN (p1, p2)
UNION ALL SELECT least(x.person, y.person), greatest(x.person, y.person), 0.4 FROM w JOIN o AS x ON x.connector = this JOIN n AS nx ON nx.connector = this JOIN o AS y ON y.connector = other JOIN n AS ny ON ny.connector = other
WHERE this IN (FROM near) AND other NOT IN (FROM near) AND nx.n <= 25 AND ny.n <= 25 AND x.person <> y.person)
SELECT p1, p2, 1 AS degree, count(*) AS via_count, round(1 - product(1 - confidence), 4)::DOUBLE AS confidence FROM r GROUP BY p1, p2"""
)
def organisation_network(spark, sf):
    return _links(N.person_network(_sources(spark, sf, bridges=True), "c:1", 1, max_persons=_ALL))


_F = """f AS (SELECT 'c:' || o_custkey AS p, 'order_day' AS k, lower(strftime(o_orderdate, '%Y%m%d') || replace(o_orderpriority, '-', '') || o_orderstatus) AS raw FROM orders
UNION SELECT 'c:' || o_custkey, 'ship_day', lower(strftime(l_shipdate, '%Y%m%d') || replace(o_orderpriority, '-', '') || o_orderstatus) FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1),
fo AS (SELECT p AS person, replace(raw, ' ', '') AS connector, bool_or(k = 'order_day') AS o, bool_or(k = 'ship_day') AS s FROM f GROUP BY ALL),
fn AS (SELECT connector, count(*) AS n FROM fo GROUP BY connector),
s AS (SELECT a.person AS p1, b.person AS p2, a.connector, (0.5::DOUBLE / (n - 1)) * CASE WHEN (a.o AND b.o) OR (a.s AND b.s) THEN 1 ELSE 0.6 END AS confidence
FROM fo AS a JOIN fo AS b ON a.connector = b.connector AND a.person < b.person JOIN fn ON fn.connector = a.connector WHERE n BETWEEN 2 AND 25)"""


def _network_sql(reasons: str, owners: str, direct: bool, depth: int) -> str:
    """SQL for the links of c:1's network from s(p1, p2, connector, confidence), owners(connector, person) and, if asked, dr."""
    near = "SELECT p1 AS a, p2 AS b FROM s UNION SELECT p2, p1 FROM s" + (" UNION SELECT p1, p2 FROM dr UNION SELECT p2, p1 FROM dr" if direct else "")
    also = " UNION ALL SELECT p1, p2, 'direct', confidence, 1 + least(coalesce(a.d, 9), coalesce(b.d, 9)) FROM dr LEFT JOIN g AS a ON a.vid = p1 LEFT JOIN g AS b ON b.vid = p2" if direct else ""
    return f"""WITH RECURSIVE {reasons}, y AS ({near}), h AS (SELECT 'c:1' AS vid, 0 AS d UNION SELECT b, d + 1 FROM h JOIN y ON a = vid WHERE d < {depth}), g AS (SELECT vid, min(d) AS d FROM h GROUP BY vid),
cl AS (SELECT connector, 1 + min(d) AS lv FROM {owners} JOIN g ON vid = person GROUP BY connector),
r AS (SELECT p1, p2, connector AS k, confidence, lv FROM s JOIN cl USING (connector){also}),
w AS (SELECT *, min(lv) OVER (PARTITION BY p1, p2) AS degree, row_number() OVER (PARTITION BY p1, p2, k ORDER BY lv) AS i FROM r WHERE lv <= {depth})
SELECT p1, p2, degree, count(*) AS via_count, round(1 - product(1 - confidence), 4) AS confidence FROM w WHERE (lv = degree OR i = 1) AND p1 IN (SELECT vid FROM g) AND p2 IN (SELECT vid FROM g) GROUP BY p1, p2, degree"""


def _field_sources(spark, sf, direct: bool = False) -> N.Sources:
    def made() -> N.Sources:
        g = D.field_graph(spark, sf, direct)
        return N.sources(g.vertices, g.edges)

    return D.stored(spark, sf, "fields_and_orders" if direct else "fields", made)


@query(_network_sql(_F, "fo", False, 2))
def field_network(spark, sf):
    """A network of shared field values alone: the graph has no direct edges."""
    return _links(N.person_network(_field_sources(spark, sf), "c:1", 2, max_persons=_ALL))


@query(_network_sql(_F + ", " + _DR, "fo", True, 2))
def field_and_direct_network(spark, sf):
    return _links(N.person_network(_field_sources(spark, sf, True), "c:1", 2, max_persons=_ALL))


@query(
    f"""WITH RECURSIVE {_S}, {_DR}, x AS (SELECT p1, p2, confidence FROM s UNION ALL SELECT p1, p2, confidence FROM dr), {_L.format("x")}, m AS (SELECT min(vid) AS t FROM (SELECT p1 AS vid FROM l WHERE p2 = 'c:1' UNION SELECT p2 FROM l WHERE p1 = 'c:1'))
SELECT 'c:1' AS source, t AS target, confidence, via_count FROM m JOIN l ON least(p1, p2) = least('c:1', t) AND greatest(p1, p2) = greatest('c:1', t)"""
)
def direct_connection(spark, sf):
    """The link of c:1 and its least neighbour, which is the strongest path too where their network has one degree and no better way round."""
    s = _sources(spark, sf)
    net = N.person_network(s, "c:1", 1, max_persons=_ALL)
    at = net.links().where("'c:1' IN (p1, p2)").select(F.when(F.col("p1") == "c:1", F.col("p2")).otherwise(F.col("p1")).alias("target"), "confidence", "via_count")
    return at.orderBy("target").limit(1).select(F.lit("c:1").alias("source"), "target", "confidence", "via_count")


_BEST = f"""net AS MATERIALIZED ({_network_sql(_S + ", " + _DR, "o", True, 2)}), n AS MATERIALIZED (SELECT p1 AS a, p2 AS b, greatest(confidence, 1e-9) AS c FROM net UNION ALL SELECT p2, p1, greatest(confidence, 1e-9) FROM net),
t AS (SELECT max(b) AS vid FROM n WHERE b <> 'c:1' AND b NOT IN (SELECT b FROM n WHERE a = 'c:1')),
w(vid, l) USING KEY (vid) AS (SELECT 'c:1', {{'c': -1.0::DOUBLE, 'h': 0, 'p': ['c:1']}} UNION SELECT vid, l FROM (SELECT n.b AS vid, min({{'c': w.l.c * n.c, 'h': w.l.h + 1, 'p': list_append(w.l.p, n.b)}}) AS l FROM w JOIN n ON n.a = w.vid GROUP BY n.b) AS x
WHERE NOT EXISTS (SELECT 1 FROM recurring.w AS r WHERE r.vid = x.vid AND r.l <= x.l))"""


@query(f"WITH RECURSIVE {_BEST} SELECT 'c:1' AS source, vid AS target, true AS connected, round(-l.c, 9) AS confidence, array_to_string(l.p, ' ') AS path FROM w JOIN t USING (vid)")
def strongest_connection(spark, sf):
    """The best path, and how strong it is, from c:1 to the last person, by id, two links away, over the whole network."""
    s = _sources(spark, sf)
    far = N.person_network(s, "c:1", 2, max_persons=_ALL).persons.where("degree = 2").agg(F.max("vid")).first()[0]
    if far is None:
        return spark.createDataFrame([], "source string, target string, connected boolean, confidence double, path string")
    found = N.connection(s, "c:1", far, 2, max_persons=_ALL)
    return found.select("source", "target", "connected", F.round("confidence", 9).alias("confidence"), F.array_join("path", " ").alias("path"))


@query(f"WITH RECURSIVE {_BEST} SELECT i - 1 AS hop, l.p[i] AS vid FROM (SELECT l, unnest(range(1, len(l.p) + 1)) AS i FROM w JOIN t USING (vid))")
def strongest_path(spark, sf):
    """The persons on that path, in order."""
    path = strongest_connection(spark, sf).select(F.split("path", " ").alias("p"))
    return path.select(F.posexplode("p").alias("hop", "vid")).select(F.col("hop").cast("long").alias("hop"), "vid")


@query(f"WITH {_S}, {_L.format('s')} SELECT vid, count(*) AS n, max(confidence) AS strongest FROM (SELECT p1 AS vid, confidence FROM l UNION ALL SELECT p2, confidence FROM l) GROUP BY vid")
def links_by_person(spark, sf):
    return views.links_by_person(P.links(P.shared_reasons(D.offer_owners(spark, sf))))


@query(
    f"""WITH {_S}, {_L.format('s')}, b AS (SELECT p1 AS vid, p2 AS other, confidence FROM l UNION ALL SELECT p2, p1, confidence FROM l)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY confidence DESC, other) AS rank FROM b) WHERE rank <= 3"""
)
def strongest_links(spark, sf):
    return views.strongest_links(P.links(P.shared_reasons(D.offer_owners(spark, sf))))


@query(f"WITH {_S}, {_L.format('s')} SELECT CASE WHEN confidence >= 0.7 THEN 'strong' WHEN confidence >= 0.35 THEN 'moderate' ELSE 'weak' END AS tone, count(*) AS n FROM l GROUP BY ALL")
def link_tones(spark, sf):
    found = P.links(P.shared_reasons(D.offer_owners(spark, sf)))
    return found.groupBy(records.confidence_tone(F.col("confidence")).alias("tone")).agg(F.count("*").alias("n"))


@query(f"WITH {_S} SELECT connector, count(*) AS persons, min(person) AS first_person FROM (SELECT connector, p1 AS person FROM s UNION SELECT connector, p2 FROM s) GROUP BY connector")
def match_index(spark, sf):
    return views.match_index(P.shared_reasons(D.offer_owners(spark, sf)))


# ---- graph


@query(f"WITH {_V} SELECT tag, count(*) AS n FROM v GROUP BY tag")
def tag_histogram(spark, sf):
    return views.tag_histogram(D.hierarchy(spark, sf).vertices)


@query(f"WITH {_U} SELECT a AS vid, edge_type, count(*) AS n, count(DISTINCT b) AS neighbours FROM u GROUP BY ALL")
def entity_context(spark, sf):
    return D.hierarchy(spark, sf).entity_context()


@query(f"WITH {_E} SELECT 1 AS step, dst AS vid, edge_type FROM e WHERE src = 's:1' UNION ALL SELECT 2, b.dst, b.edge_type FROM e AS a JOIN e AS b ON b.src = a.dst WHERE a.src = 's:1'")
def outgoing_walks(spark, sf):
    return D.hierarchy(spark, sf).walks("s:1", 2)


@query(f"WITH {_E} SELECT DISTINCT src, dst, edge_type FROM e WHERE 'n:1' IN (src, dst)")
def neighbors_with_edges(spark, sf):
    return D.hierarchy(spark, sf).neighbors_with_edges("n:1")[1].select("src", "dst", "edge_type")


@query(f"WITH {_U}, m AS (SELECT 'r:1' AS vid UNION SELECT b FROM u WHERE a = 'r:1') SELECT DISTINCT src, dst, edge_type FROM e WHERE src IN (FROM m) OR dst IN (FROM m)")
def expand_node(spark, sf):
    return D.hierarchy(spark, sf).expand("r:1", 2)[1].select("src", "dst", "edge_type")


@query("SELECT DISTINCT 'n:' || s_nationkey AS vid, 's:' || s_suppkey AS listing FROM supplier WHERE s_acctbal < 0")
def listed_entities(spark, sf):
    low = D.table(spark, sf, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s:"), F.col("s_suppkey")).alias("vid"))
    g = D.hierarchy(spark, sf)
    marked = g.vertices.join(low, "vid", "left_semi").withColumn("tag", F.lit("sanction_entry")).unionByName(g.vertices.join(low, "vid", "left_anti"))
    return PropertyGraph(marked, g.edges).listed()


@query(f"WITH {_E} SELECT src, dst, edge_type FROM e WHERE edge_type = 'PART_OF'")
def visible_edges(spark, sf):
    return D.hierarchy(spark, sf).visible(["supplier"], ["CITIZEN_OF"])[1].select("src", "dst", "edge_type")


# ---- sinks and imports


@query("SELECT 'c:' || c_custkey AS vid, 'person' AS tag, coalesce(o_orderpriority, c_mktsegment) AS label FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def last_write_wins(spark, sf):
    """Customers' vertices, overwritten by each of their orders in turn."""
    old = D.table(spark, sf, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey")).alias("vid"), F.lit("person").alias("tag"), F.col("c_mktsegment").alias("label"))
    new = D.table(spark, sf, "orders").select(F.concat(F.lit("c:"), F.col("o_custkey")).alias("vid"), F.lit("person").alias("tag"), F.col("o_orderpriority").alias("label"), "o_orderkey")
    return graph_store.insert(old, new, graph_store.VERTEX_KEY, "o_orderkey")


@query("SELECT 'c:' || c_custkey AS vid, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE c_mktsegment END AS segment, c_name AS name FROM customer")
def upsert_props(spark, sf):
    c = D.table(spark, sf, "customer").withColumn("vid", F.concat(F.lit("c:"), F.col("c_custkey")))
    old = c.select("vid", F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name")).alias("props"))
    new = c.where("c_acctbal < 0").select("vid", F.create_map(F.lit("segment"), F.lit("debt")).alias("props"))
    return graph_store.upsert_props(old, new, ["vid"]).select("vid", F.col("props")["segment"].alias("segment"), F.col("props")["name"].alias("name"))


@query(f"WITH {_E} SELECT src, dst, edge_type FROM e WHERE edge_type = 'PART_OF'")
def delete_cascade(spark, sf):
    """Edges left when suppliers and customers go with theirs."""
    g = D.hierarchy(spark, sf)
    gone = g.vertices.where("tag IN ('supplier', 'person')").select("vid")
    return graph_store.delete_vertices(g.vertices, g.edges, gone, with_edges=True)[1].select("src", "dst", "edge_type")


@query(
    """SELECT c_custkey::VARCHAR AS id, 'say "' || c_name || '", please' AS said, c_mktsegment || chr(10) || c_name || CASE WHEN c_custkey % 7 = 0 THEN chr(10) || chr(10) || '"' ELSE '' END AS lines FROM customer"""
)
def csv_quoted_rows(spark, sf):
    """Customers written as CSV with delimiters, quotes and line breaks within fields, read again from several files and splits."""
    c = D.table(spark, sf, "customer")
    said = F.concat(F.lit('say "'), "c_name", F.lit('", please'))
    broken = F.concat("c_mktsegment", F.lit("\n"), "c_name", F.when(F.col("c_custkey") % 7 == 0, '\n\n"').otherwise(""))
    path = scratch(spark, "csv")
    c.select(F.col("c_custkey").alias("id"), said.alias("said"), broken.alias("lines")).repartition(3).write.csv(path, header=True, quote='"', escape='"')
    return csv_profile.read_csv(spark, path, ",")


_RATIOS = " UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS c, count(DISTINCT {c}) / count(*) AS r FROM lineitem" for i, c in enumerate(("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")))


@query(f"WITH v AS (SELECT c, row_number() OVER (ORDER BY round(r, 4) DESC, i) AS k FROM ({_RATIOS}) WHERE r < 0.98) SELECT max(c) FILTER (k = 1) AS source, max(c) FILTER (k = 2) AS target, NULL::VARCHAR AS type, NULL::VARCHAR AS id FROM v")
def csv_structure(spark, sf):
    """The roles of a table's columns, whose headers say nothing: the two that vary most are its ends."""
    rows = D.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    found = csv_profile.profile(rows).withColumn("i", F.array_position(F.array(*[F.lit(c) for c in rows.columns]), F.col("column")))
    return csv_import.assigned(found.select("i", "column", "distinct_ratio"))


@query("SELECT o_custkey::VARCHAR AS src, o_orderstatus AS dst, 'ORDERS' AS edge_type, count(*) - 1 AS copies FROM orders GROUP BY ALL")
def csv_import_edges(spark, sf):
    rows = D.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus")
    made = csv_import.run(rows, "orders", csv_import.Structure("entity", (), ends=("o_custkey", "o_orderstatus"), edge_type="ORDERS"))
    return made.edges.select("src", "dst", "edge_type", "copies")


@query("SELECT c_custkey::VARCHAR AS vid, 'customer' AS tag, c_name AS label FROM customer")
def csv_import_vertices(spark, sf):
    names = ("c_name", "c_nationkey", "c_mktsegment")
    rows = D.table(spark, sf, "customer").select(*[F.col(n).cast("string").alias(n) for n in ("c_custkey", *names)])
    return csv_import.run(rows, "customer", csv_import.Structure("customer", names, id="c_custkey")).vertices.select("vid", "tag", "label")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority[1]::BIGINT END AS value, o_orderstatus <> 'P' AS error, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS amount, o_orderstatus = 'O' AS amount_error,
CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 = 1 END AS flag, false AS flag_error FROM orders"""
)
def coerce_errors(spark, sf):
    """Whole numbers, decimal ones and truth values, blank, right and wrong."""
    raw = F.when(F.col("o_orderstatus") == "P", F.substring("o_orderpriority", 1, 1)).otherwise(F.col("o_orderpriority"))
    amount = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("string")).when(F.col("o_orderstatus") == "O", "much").otherwise(" ")
    flag = F.when(F.col("o_orderkey") % 3 == 1, " TRUE").when(F.col("o_orderkey") % 3 == 2, "maybe").otherwise("")
    (value, error), (x, y), (a, b) = T.coerce(raw, "int"), T.coerce(amount, "float"), T.coerce(flag, "bool")
    return D.table(spark, sf, "orders").select("o_orderkey", value.alias("value"), error.alias("error"), x.alias("amount"), y.alias("amount_error"), a.alias("flag"), b.alias("flag_error"))


@query("SELECT 'c:' || c_custkey AS vid, 'person' AS tag, 'confidence must be in 0..1' AS error FROM customer WHERE c_acctbal / 5000 NOT BETWEEN 0 AND 1")
def vertex_errors(spark, sf):
    c = D.table(spark, sf, "customer")
    props = F.create_map(F.lit("full_name"), F.col("c_name"), F.lit("confidence"), (F.col("c_acctbal") / 5000).cast("string"))
    return catalog.vertex_errors(c.select(F.concat(F.lit("c:"), F.col("c_custkey")).alias("vid"), F.lit("person").alias("tag"), F.col("c_name").alias("label"), props.alias("props")))


@query("SELECT event_id, 'k' AS field_key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') <> ''")
def field_values_from_json(spark, sf):
    return D.table(spark, sf, "events").select("event_id", F.explode(records.properties(F.col("props"))).alias("field_key", "value"))


_DAYS = ("yyyy-MM-dd", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy/M/d")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 9 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def normalized_dates(spark, sf):
    """Days in each format that is read, and texts that are none."""
    k, raw = F.col("o_orderkey") % 10, F.lit("soon")
    for i, f in enumerate(_DAYS):
        raw = F.when(k == i, F.date_format("o_orderdate", f)).otherwise(raw)
    return D.table(spark, sf, "orders").select("o_orderkey", records.date(F.concat(F.lit(" "), raw)).alias("day"))


# ---- evidence

_X = f"""x AS (SELECT DISTINCT doc_id, 'Email' AS type, unnest(regexp_extract_all(text, '{E.EMAIL}')) AS name FROM documents UNION SELECT doc_id, 'Phone', unnest(regexp_extract_all(text, '{E.PHONE}')) FROM documents)"""
_Y = (
    _X
    + r""", y AS (SELECT doc_id, type, key, substr(sha256(key), 1, 32) AS entity_id, canonical_name FROM (SELECT doc_id, type, canonical_name, CASE type WHEN 'Email' THEN 'email:' ELSE 'phone:' END || canonical_name AS key
FROM (SELECT doc_id, type, CASE type WHEN 'Email' THEN lower(name) ELSE regexp_replace(name, '[ ().\-]', '', 'g') END AS canonical_name FROM x) WHERE type = 'Email' OR regexp_matches(canonical_name, '^\+[1-9][0-9]{7,14}$')))"""
)


def _mentions(spark, sf) -> DataFrame:
    rows = D.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("evidence_id"), "text")
    return E.extracted(rows)


def _resolved(spark, sf) -> DataFrame:
    return E.resolve_keys(E.normalized(_mentions(spark, sf)))


def _holders(spark, sf) -> DataFrame:
    return _resolved(spark, sf).select(F.col("entity_id").alias("connector"), F.col("type").alias("tag"), F.col("evidence_id").alias("person"))


@query(f"WITH {_X} SELECT doc_id::VARCHAR AS evidence_id, type, name FROM x")
def evidence_mentions(spark, sf):
    return _mentions(spark, sf).select("evidence_id", "type", "name")


@query(f"WITH {_Y} SELECT entity_id, type, canonical_name, count(DISTINCT doc_id) AS evidence_count FROM y GROUP BY ALL")
def evidence_registry(spark, sf):
    return E.registry(_resolved(spark, sf)).select("entity_id", "type", "canonical_name", "evidence_count")


@query(f"WITH {_Y} SELECT DISTINCT entity_id AS src, doc_id::VARCHAR AS dst FROM y")
def evidence_support(spark, sf):
    m = _resolved(spark, sf)
    return E.written(E.facts(m)[0], E.registry(m))[1].select("src", "dst")


@query(f"WITH {_Y} SELECT entity_id FROM y JOIN documents USING (doc_id) GROUP BY entity_id HAVING bool_and(coalesce(lang = 'en', false))")
def evidence_delete_orphans(spark, sf):
    gone = D.table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").cast("string").alias("evidence_id"))
    return E.delete_evidence(_resolved(spark, sf), gone)[1]


@query(f"WITH {_Y}, h AS (SELECT DISTINCT entity_id, type, doc_id::VARCHAR AS d FROM y), n AS (SELECT entity_id FROM h GROUP BY entity_id HAVING count(*) <= 25) SELECT DISTINCT a.d AS p1, b.d AS p2, 'shares_' || lower(a.type) AS label, 0.65::DOUBLE AS confidence FROM h AS a JOIN h AS b ON a.entity_id = b.entity_id AND a.d < b.d WHERE a.entity_id IN (FROM n)")
def shared_identifier_pairs(spark, sf):
    """Identifiers of more than 25 holders are in shared_identifier_members."""
    return R.shared_identifier_pairs(_holders(spark, sf), 25)


@query(f"WITH {_Y}, h AS (SELECT DISTINCT entity_id, type, doc_id::VARCHAR AS d FROM y), n AS (SELECT entity_id, min(d) AS least FROM h GROUP BY entity_id HAVING count(*) > 25) SELECT entity_id AS connector, 'shares_' || lower(type) AS label, least AS representative, d AS person FROM h JOIN n USING (entity_id)")
def shared_identifier_members(spark, sf):
    return R.wide_identifier_members(_holders(spark, sf), 25)


@query(f"WITH {_Y}, h AS (SELECT DISTINCT entity_id, type, doc_id::VARCHAR AS d FROM y), n AS (SELECT entity_id, min(d) AS least FROM h GROUP BY entity_id HAVING count(*) > 1) SELECT entity_id AS connector, 'shares_' || lower(type) AS label, least AS representative, d AS person FROM h JOIN n USING (entity_id)")
def identifier_members(spark, sf):
    """All identifiers of two holders or more, however many hold them."""
    return R.wide_identifier_members(_holders(spark, sf), 1)


@query("SELECT min(source) AS source, sha256(t) AS sha256 FROM (SELECT source, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents) WHERE length(t) > 0 GROUP BY t")
def evidence_ingest(spark, sf):
    return E.ingest(D.table(spark, sf, "documents").select("source", "text")).select("source", "sha256")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'PAYS' ELSE 'RELATED_TO' END AS type, CASE o_orderstatus WHEN 'F' THEN 'CITIZEN_OF' END AS label FROM orders")
def relationship_types(spark, sf):
    """A person and a company in each order: a right type, one the ontology doesn't allow, an unknown one."""
    o = D.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderkey").cast("string").alias("evidence_id"))
    kind = F.when(F.col("o_orderstatus") == "P", "pays").when(F.col("o_orderstatus") == "F", "citizen of").otherwise("buys")
    mentions = o.select("evidence_id", F.explode(F.expr("array(struct('c' AS local_id, 'Person' AS type), struct('s' AS local_id, 'Company' AS type))")).alias("m")).select("evidence_id", "m.*")
    r = o.select("o_orderkey", "evidence_id", F.lit("c").alias("source"), F.lit("s").alias("target"), kind.alias("type"))
    return E.valid_relationships(r, mentions).select("o_orderkey", "type", "label")


def _lcs_sql(a: str, b: str) -> str:
    """SQL for the length of the longest common subsequence of two texts: a row of the usual table for each letter of a."""
    row = f"list_reduce(list_prepend([0::BIGINT], list_transform(range(1, length({b}) + 1), lambda j: [j])), lambda acc, j: list_append(acc, CASE WHEN ascii(substr({b}, j[1], 1)) = ch[1] THEN r[j[1]] + 1 ELSE greatest(acc[len(acc)], r[j[1] + 1]) END))"
    letters = f"list_transform(range(1, length({a}) + 1), lambda i: [ascii(substr({a}, i, 1))::BIGINT])"
    return f"list_last(list_reduce(list_prepend(list_transform(range(length({b}) + 1), lambda z: 0::BIGINT), {letters}), lambda r, ch: {row}))"


@query(
    f"""WITH n AS (SELECT s_suppkey AS k, s_nationkey AS t, lower(split_part(s_name, '#', 2) || ' ' || split_part(s_name, '#', 1)) AS x FROM supplier),
c AS (SELECT a.k AS mention, b.k AS id, round(least(1, 2.0::DOUBLE * {_lcs_sql("a.x", "b.x")} / (length(a.x) + length(b.x)) + CASE WHEN a.k % 3 = b.k % 3 THEN 0.07::DOUBLE ELSE 0 END), 4) AS score FROM n AS a JOIN n AS b USING (t))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, id) AS rank FROM c WHERE score >= 0.5) WHERE rank <= 5"""
)
def fuzzy_candidates(spark, sf):
    """Suppliers of a nation by the likeness of their names, whose words are in another order on one side."""
    s = D.table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("type"), F.split("s_name", "#").alias("w"), (F.col("s_suppkey") % 3).cast("string").alias("birth"))
    mentions = s.select(F.col("s_suppkey").alias("mention"), "type", F.concat_ws("  ", F.col("w")[1], F.col("w")[0]).alias("name"), "birth")
    return R.fuzzy_candidates(mentions, s.select(F.col("s_suppkey").alias("id"), "type", F.concat_ws(" ", "w").alias("name"), "birth"))


@query()
def text_chunks(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", F.posexplode(records.chunks("text")).alias("chunk", "text"))
