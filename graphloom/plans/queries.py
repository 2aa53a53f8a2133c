"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import network, risk, views
from graphloom.operators import projection as P
from graphloom.operators import resolution as R
from graphloom.operators.graph import PropertyGraph
from graphloom.plans import driver_graph as D
from graphloom.sinks import graph_store
from graphloom.sources import csv_profile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_V = """v AS (SELECT 'r:' || r_regionkey AS vid, 'region' AS tag, r_name AS label FROM region UNION ALL SELECT 'n:' || n_nationkey, 'nation', n_name FROM nation
UNION ALL SELECT 's:' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'c:' || c_custkey, 'person', c_name FROM customer)"""
_E = """e AS (SELECT 'n:' || n_nationkey AS src, 'r:' || n_regionkey AS dst, 'PART_OF' AS edge_type FROM nation UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'LOCATED_AT' FROM supplier
UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'CITIZEN_OF' FROM customer)"""
_U = _E + ", u AS (SELECT src AS a, dst AS b, edge_type, 'out' AS direction FROM e UNION ALL SELECT dst, src, edge_type, 'in' FROM e)"
_O = """o AS (SELECT DISTINCT 'o:' || l_partkey || ':' || l_suppkey AS connector, 'c:' || o_custkey AS person FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
_N = _O + ", n AS (SELECT connector, count(*) AS n FROM o GROUP BY connector)"
_S = _N + """, s AS (SELECT a.person AS p1, b.person AS p2, a.connector, 'shared_attribute' AS kind, CAST(0.4 AS DOUBLE) / (n - 1) AS confidence
FROM o AS a JOIN o AS b ON a.connector = b.connector AND a.person < b.person JOIN n ON n.connector = a.connector WHERE n BETWEEN 2 AND 25)"""
_DR = """dr AS (SELECT least(x, y) AS p1, greatest(x, y) AS p2, CAST(NULL AS VARCHAR) AS connector, 'direct' AS kind, CAST(0.9 AS DOUBLE) AS confidence
FROM (SELECT 'c:' || a.o_custkey AS x, 'c:' || b.o_custkey AS y FROM orders AS a JOIN orders AS b ON b.o_orderkey = a.o_orderkey + 1) WHERE x <> y)"""
_BR = """br AS (SELECT least(x.person, y.person) AS p1, greatest(x.person, y.person) AS p2, src, dst, 'linked_organisation' AS kind, CAST(0.4 AS DOUBLE) AS confidence
FROM (SELECT DISTINCT 'o:' || a.l_partkey || ':' || a.l_suppkey AS src, 'o:' || b.l_partkey || ':' || b.l_suppkey AS dst FROM lineitem AS a JOIN lineitem AS b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1) AS g
JOIN o AS x ON x.connector = src JOIN n AS nx ON nx.connector = src JOIN o AS y ON y.connector = dst JOIN n AS ny ON ny.connector = dst
WHERE src <> dst AND nx.n <= 25 AND ny.n <= 25 AND x.person <> y.person)"""
_L = "l AS (SELECT p1, p2, count(*) AS via_count, round(1 - product(1 - confidence), 4) AS confidence FROM {} GROUP BY p1, p2)"
_FO = """f AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS connector, 'c:' || o_custkey AS person, 'order_date' AS field_key FROM orders
UNION SELECT strftime(l_shipdate, '%Y-%m-%d'), 'c:' || o_custkey, 'ship_date' FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
k AS (SELECT connector, person, bool_or(field_key = 'order_date') AS o, bool_or(field_key = 'ship_date') AS s FROM f GROUP BY ALL),
m AS (SELECT connector, count(*) AS n FROM k GROUP BY connector)"""


# ---- scans, neighbourhoods, paths


@query(f"WITH {_V} SELECT vid, tag, label FROM v WHERE tag = 'supplier' ORDER BY vid LIMIT 10")
def scan_vertices_topn(spark, sf):
    return D.hierarchy(spark, sf).scan_vertices("supplier", 10).select("vid", "tag", "label")


@query(f"WITH {_V}, {_U} SELECT DISTINCT vid, tag, label FROM v JOIN u ON vid = b WHERE a = 's:1' AND direction = 'out'")
def neighbors_out(spark, sf):
    return D.hierarchy(spark, sf).neighbors("s:1")


@query(f"WITH {_V}, {_U} SELECT DISTINCT vid, tag, label FROM v JOIN u ON vid = b WHERE a = 'n:1' AND direction = 'in'")
def neighbors_in(spark, sf):
    return D.hierarchy(spark, sf).neighbors("n:1", direction="in")


@query(f"WITH {_V}, {_U} SELECT DISTINCT vid, tag, label FROM v JOIN u ON vid = b WHERE a = 'n:1'")
def neighbors_both(spark, sf):
    return D.hierarchy(spark, sf).neighbors("n:1", direction="both")


@query(f"WITH {_V}, {_E} SELECT DISTINCT src, dst, edge_type, CAST(0 AS BIGINT) AS rank FROM e WHERE src IN (SELECT vid FROM v WHERE tag = 'region') OR dst IN (SELECT vid FROM v WHERE tag = 'region')")
def neighbors_batch(spark, sf):
    g = D.hierarchy(spark, sf)
    return g.neighbors_batch(g.vertices.where("tag = 'region'"))


@query(f"WITH {_U} SELECT a AS vid, edge_type, direction, count(DISTINCT b) AS n FROM u GROUP BY ALL")
def degree_table(spark, sf):
    return D.hierarchy(spark, sf).degrees()


@query(f"WITH {_U} SELECT a AS vid, count(DISTINCT b) AS n FROM u WHERE direction = 'in' AND edge_type = 'CITIZEN_OF' GROUP BY a")
def count_neighbors(spark, sf):
    return D.hierarchy(spark, sf).degrees().where("direction = 'in' AND edge_type = 'CITIZEN_OF'").select("vid", "n")


@query(
    f"""WITH {_V}, {_E}, w AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY vid) AS i FROM v WHERE tag IN ('nation', 'supplier')),
k AS (SELECT vid FROM w WHERE i <= 13 ORDER BY i, tag LIMIT 25) SELECT DISTINCT src, dst, edge_type FROM e WHERE src IN (FROM k) AND dst IN (FROM k)"""
)
def overview_induced(spark, sf):
    return D.hierarchy(spark, sf).overview(["nation", "supplier"], 25)[1]


@query(f"WITH RECURSIVE {_U}, h AS (SELECT 'r:1' AS vid, 0 AS d UNION SELECT b, d + 1 FROM h JOIN u ON a = vid WHERE d < 2) SELECT vid, min(d) AS depth FROM h GROUP BY vid")
def k_hop(spark, sf):
    return D.hierarchy(spark, sf).k_hop(spark.createDataFrame([("r:1",)], "vid string"), 2)


@query(f"WITH RECURSIVE {_E}, h AS (SELECT 's:1' AS vid, 's:1' AS path UNION ALL SELECT dst, path || '>' || dst FROM h JOIN e ON src = vid) SELECT path FROM h JOIN (SELECT 'r:' || n_regionkey AS goal FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1) ON vid = goal")
def shortest_path(spark, sf):
    goal = D.table(spark, sf, "supplier").where("s_suppkey = 1").join(D.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    return D.hierarchy(spark, sf).shortest_paths("s:1", f"r:{goal}").select(F.array_join("path", ">").alias("path"))


@query(f"WITH {_V} SELECT vid, tag, label FROM v WHERE lower(label) LIKE '%r#00000001%'")
def substring_search(spark, sf):
    return D.hierarchy(spark, sf).search("R#00000001", limit=None).select("vid", "tag", "label")


@query(f"WITH {_V} SELECT vid, tag, label FROM v WHERE lower(label) LIKE '%r#0000001%'")
def indexed_search(spark, sf):
    """The same by stored postings: suppliers and customers of several numbers."""
    return D.searched(spark, sf).search("R#0000001", limit=None)


# ---- the projection to person links


@query(f"WITH {_N} SELECT connector, n FROM n")
def owners_per_connector(spark, sf):
    return P.counted(D.offer_owners(spark, sf)).select("connector", "n").distinct()


@query("SELECT 'p:' || l_partkey AS connector, 'part' AS tag, count(DISTINCT o_custkey) AS person_count FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_partkey HAVING count(DISTINCT o_custkey) > 25")
def suppressed_hubs(spark, sf):
    return P.suppressed_hubs(D.part_owners(spark, sf))


@query(f"WITH {_S}, {_L.format('s')} SELECT * FROM l")
def shared_links(spark, sf):
    return P.links(P.shared_reasons(D.offer_owners(spark, sf)))


@query(
    f"""WITH {_FO} SELECT a.person AS p1, b.person AS p2, a.connector, 'shared_field' AS kind, CASE WHEN a.o AND b.o OR NOT (a.s AND b.s) THEN 'order_date' ELSE 'ship_date' END AS field_key,
(a.o AND b.o) OR (a.s AND b.s) AS same_key, round(CAST(0.5 AS DOUBLE) / (n - 1) * CASE WHEN (a.o AND b.o) OR (a.s AND b.s) THEN 1 ELSE 0.6 END, 6) AS confidence
FROM k AS a JOIN k AS b ON a.connector = b.connector AND a.person < b.person JOIN m ON m.connector = a.connector WHERE n BETWEEN 2 AND 60"""
)
def field_links(spark, sf):
    return P.field_reasons(D.value_owners(spark, sf), 60).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {_DR} SELECT * FROM dr")
def direct_links(spark, sf):
    persons = D.hierarchy(spark, sf).vertices.where("tag = 'person'").select("vid")
    return P.direct_reasons(D.direct_edges(spark, sf), persons)


@query(f"WITH {_N}, {_BR} SELECT * FROM br")
def bridge_links(spark, sf):
    return P.bridge_reasons(D.offer_owners(spark, sf), D.bridge_edges(spark, sf))


def _merged(spark, sf, least: float = 0.0) -> DataFrame:
    persons = D.hierarchy(spark, sf).vertices.where("tag = 'person'").select("vid")
    owners = D.offer_owners(spark, sf)
    return P.links(P.shared_reasons(owners), P.direct_reasons(D.direct_edges(spark, sf), persons), min_confidence=least)


_M = f"WITH {_S}, {_DR}, x AS (SELECT p1, p2, confidence FROM s UNION ALL SELECT p1, p2, confidence FROM dr), {_L.format('x')}"


@query(_M + " SELECT * FROM l")
def merged_links(spark, sf):
    return _merged(spark, sf)


@query(_M + " SELECT * FROM l WHERE confidence >= 0.95")
def links_min_confidence(spark, sf):
    return _merged(spark, sf, 0.95)


@query(
    f"""WITH RECURSIVE {_S}, {_L.format('s')}, y AS (SELECT p1 AS a, p2 AS b FROM l UNION ALL SELECT p2, p1 FROM l),
h AS (SELECT 'c:1' AS vid, 0 AS d UNION SELECT b, d + 1 FROM h JOIN y ON a = vid WHERE d < 2) SELECT vid, min(d) AS degree FROM h GROUP BY vid"""
)
def person_degrees(spark, sf):
    return P.person_degrees(shared_links(spark, sf), "c:1", 2)


@query(
    f"""WITH {_N} SELECT a.person, a.connector, 'company' AS tag, coalesce(string_agg(b.person, ',' ORDER BY b.person) FILTER (b.person <> a.person), '') AS shared_with FROM o AS a JOIN o AS b USING (connector) GROUP BY ALL"""
)
def attributes_shared_with(spark, sf):
    """What each person owns and who else does."""
    persons = D.table(spark, sf, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey")).alias("vid"))
    none = spark.createDataFrame([], "src string, dst string, edge_type string")
    found = network.attributes(network.Sources(D.offer_owners(spark, sf), none, persons=persons), tags=("company",))
    return found.select("person", "connector", "tag", F.array_join("shared_with", ",").alias("shared_with"))


@query(
    "WITH w AS (SELECT DISTINCT 'n:' || c_nationkey AS connector, 'c:' || c_custkey AS person FROM customer) SELECT connector, person, min(person) OVER (PARTITION BY connector) AS representative, count(*) OVER (PARTITION BY connector) AS n FROM w"
)
def attribute_holders(spark, sf):
    """All customers of a nation, far beyond any fan-out, each with the least of them."""
    own = D.table(spark, sf, "customer").select(F.concat(F.lit("n:"), "c_nationkey").alias("connector"), F.lit("country").alias("tag"), F.concat(F.lit("c:"), "c_custkey").alias("person"))
    none = spark.createDataFrame([], "src string, dst string, edge_type string")
    return network.holders(network.Sources(own, none), ("country",)).select("connector", "person", "representative", "n")


# ---- values, keys, resolution, risk


_VALUES = r"""i AS (SELECT 'c:' || c_custkey AS owner, unnest(['segment', 'balance', 'full_name', 'gender', 'year']) AS field_key, unnest([c_mktsegment, c_acctbal::VARCHAR, c_name, 'female', '1990']) AS raw FROM customer),
j AS (SELECT owner, field_key, lower(trim(regexp_replace(raw, '\s+', ' ', 'g'))) AS v FROM i), x AS (SELECT owner, field_key, CASE WHEN regexp_matches(v, '[0-9]') THEN regexp_replace(v, '[\s\-/.]', '', 'g') ELSE v END AS value FROM j WHERE field_key NOT IN ('gender')),
y AS (SELECT DISTINCT * FROM x WHERE length(value) >= 3 AND NOT regexp_matches(value, '^[0-9]{4}$'))"""


def _value_bags(spark, sf) -> DataFrame:
    c = D.table(spark, sf, "customer")
    bag = {"segment": F.col("c_mktsegment"), "balance": F.col("c_acctbal").cast("string"), "full_name": F.col("c_name"), "gender": F.lit("female"), "year": F.lit("1990")}
    return c.select(F.concat(F.lit("c:"), F.col("c_custkey")).alias("owner"), F.create_map(*[x for k, v in bag.items() for x in (F.lit(k), v)]).alias("props"))


@query(f"WITH {_VALUES} SELECT 'value:' || substr(sha1(value), 1, 32) AS dst, owner AS src, field_key FROM y")
def value_index(spark, sf):
    return graph_store.field_value_index(_value_bags(spark, sf))[1].select("src", "dst", "field_key")


@query(f"WITH {_VALUES} SELECT DISTINCT 'value:' || substr(sha1(value), 1, 32) AS vid, value AS label FROM y")
def value_vertices(spark, sf):
    return graph_store.field_value_index(_value_bags(spark, sf))[0].select("vid", "label")


@query(f"WITH {_VALUES} SELECT owner, string_agg(field_key || '=' || value, ';' ORDER BY field_key, value) AS pairs FROM y GROUP BY owner")
def field_values(spark, sf):
    pairs = F.transform(graph_store.field_values(F.col("props")), lambda f: F.concat(f["field_key"], F.lit("="), f["value"]))
    return _value_bags(spark, sf).select("owner", F.array_join(pairs, ";").alias("pairs"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS i FROM documents) WHERE i = 1")
def evidence_dedup(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_hash"))
    return R.first_wins(d, ["content_hash"], "doc_id").select("doc_id", "content_hash")


@query("SELECT event_id, CASE WHEN value / 100 >= 0.85 THEN 'accepted' WHEN value / 100 >= 0.5 THEN 'in_review' ELSE 'rejected' END AS gate FROM events")
def confidence_gate(spark, sf):
    return D.table(spark, sf, "events").select("event_id", R.confidence_gate(F.col("value") / 100).alias("gate"))


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) AS i FROM lineitem) WHERE i = 1")
def dedup_first(spark, sf):
    li = D.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return R.first_wins(li, ["l_orderkey", "l_partkey"], "l_linenumber")


_KEYS = ("Person", "Email", "Phone", "Document", "BankAccount", "Vehicle", "Country", "Company")


@query(
    """SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'national_id:AB' || c_custkey || 'X' WHEN 1 THEN 'email:c' || c_custkey || '@example.org' WHEN 2 THEN 'phone:+9715000' || c_custkey
WHEN 3 THEN 'document:' || CASE WHEN c_custkey % 16 = 3 THEN 'PASSPORT' ELSE 'DOCUMENT' END || ':P' || c_custkey WHEN 4 THEN 'account:AE07-' || c_custkey WHEN 5 THEN 'vehicle:' || regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g')
WHEN 6 THEN CASE WHEN c_custkey % 16 = 6 THEN 'country:AE' END END AS key FROM customer"""
)
def deterministic_keys(spark, sf):
    """A key of each kind, and of a kind that has none."""
    n = F.col("c_custkey").cast("string")
    kind = F.element_at(F.array(*[F.lit(k) for k in _KEYS]), (F.col("c_custkey") % 8 + 1).cast("int"))
    every_other = F.col("c_custkey") % 16 < 8
    given = {
        "national_id": F.concat(F.lit("ab-"), n, F.lit(" x")), "address": F.concat(F.lit(" C"), n, F.lit("@Example.ORG ")), "number": F.when(kind == "Phone", F.concat(F.lit("+971 50-00"), n)).otherwise(F.concat(F.lit("p-"), n)),
        "document_type": F.when(every_other, " passport "), "iban": F.when(every_other, F.concat(F.lit("ae07 -"), n)), "account_number": F.concat(F.lit("AE07-"), n), "plate": F.when(every_other, F.col("c_name")), "registration": F.col("c_name"), "iso2": F.when(every_other, "ae"),
    }
    return D.table(spark, sf, "customer").select("c_custkey", T.deterministic_key(kind, given).alias("key"))


@query(
    """WITH a AS (SELECT vec_id, embedding FROM embeddings), q AS (SELECT * FROM a WHERE vec_id % 50 = 0),
c AS (SELECT q.vec_id AS query_id, a.vec_id, list_dot_product(q.embedding::DOUBLE[], a.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) AS s FROM q, a WHERE q.vec_id <> a.vec_id)
SELECT query_id, vec_id, round(s, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS i FROM c) WHERE i <= 5"""
)
def cosine_topk(spark, sf):
    """The five nearest of every query vector (ids divisible by 50) among all vectors."""
    a = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return R.nearest(a.where("id % 50 = 0"), a, 5).select(F.col("query").alias("query_id"), F.col("id").alias("vec_id"), F.round("score", 5).alias("score"))


@query(
    """WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT q.vec_id AS query_id, a.vec_id, list_dot_product(q.v, a.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(a.v, a.v)) AS s FROM a AS q JOIN a ON q.vec_id <> a.vec_id)
SELECT query_id, vec_id, round(s, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS i FROM c) WHERE i <= 3"""
)
def nearest_of_all(spark, sf):
    """The three nearest of every vector; in blocks that meet in the shuffle from 2,049 vectors on."""
    a = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return R.nearest(a, a, 3).select(F.col("query").alias("query_id"), F.col("id").alias("vec_id"), F.round("score", 5).alias("score"))


#: A customer's answer about public office, by market segment.
_PEP = {"AUTOMOBILE": "Yes - immediate Family of a PEP", "MACHINERY": "under assessment", "BUILDING": "None", "FURNITURE": "-"}
_PEP_SQL = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'associate' WHEN 'MACHINERY' THEN 'self' END"


def _pep_status():
    return F.create_map(*[F.lit(x) for kv in _PEP.items() for x in kv])[F.col("c_mktsegment")]


def _risk_graph(spark, sf) -> PropertyGraph:
    """Customers, their nations as countries (the second one risky), listings of deep debtors, transfers between customers of consecutive orders."""
    c = D.table(spark, sf, "customer")
    vid = F.concat(F.lit("c:"), F.col("c_custkey"))
    listed = c.where("c_acctbal < -900").select(F.concat(F.lit("x:"), F.col("c_custkey")).alias("src"), vid.alias("dst"))
    bag = lambda k, v: F.create_map(F.lit(k), v)
    v = c.select(vid.alias("vid"), F.lit("person").alias("tag"), F.col("c_name").alias("label"), bag("pep_status", _pep_status()).alias("props"))
    v = v.unionByName(D.table(spark, sf, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey")).alias("vid"), F.lit("country").alias("tag"), F.col("n_name").alias("label"), bag("risk_classification", F.when(F.col("n_nationkey") == 1, risk.HIGH_RISK)).alias("props")))
    v = v.unionByName(listed.select(F.col("src").alias("vid"), F.lit("sanction_entry").alias("tag"), F.col("src").alias("label"), bag("program", F.lit("debt")).alias("props")))
    e = c.select(vid.alias("src"), F.concat(F.lit("n:"), F.col("c_nationkey")).alias("dst"), F.lit("CITIZEN_OF").alias("edge_type"), F.lit(0).cast("long").alias("rank"))
    e = e.unionByName(listed.select("src", "dst", F.lit("LISTS").alias("edge_type"), F.lit(0).cast("long").alias("rank")))
    paid = D.direct_edges(spark, sf).join(D.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("rank")), "rank")
    return PropertyGraph(v, e.unionByName(paid.select("src", "dst", F.lit("TRANSFERRED_TO").alias("edge_type"), "rank")))


_RISK = (
    _S
    + f""", y AS (SELECT p1 AS a, p2 AS b FROM s UNION SELECT p2, p1 FROM s), ls AS (SELECT 'c:' || c_custkey AS vid FROM customer WHERE c_acctbal < -900),
h AS (SELECT vid, 0 AS d FROM ls UNION SELECT b, d + 1 FROM h JOIN y ON a = vid WHERE d < 3), g AS (SELECT vid, min(d) AS d FROM h GROUP BY vid HAVING min(d) > 0),
tr AS (SELECT 'c:' || a.o_custkey AS src, 'c:' || b.o_custkey AS dst FROM orders AS a JOIN orders AS b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderstatus = 'P'),
tc AS (SELECT vid, count(*) AS t FROM (SELECT src AS vid FROM tr UNION ALL SELECT dst FROM tr) GROUP BY vid),
c AS (SELECT 'c:' || c_custkey AS vid, c_acctbal < -900 AS direct, CASE WHEN c_acctbal >= -900 THEN d END AS distance, coalesce(t, 0) AS transfers, {_PEP_SQL} AS pep, c_nationkey = 1 AS high_risk FROM customer LEFT JOIN g ON g.vid = 'c:' || c_custkey LEFT JOIN tc ON tc.vid = 'c:' || c_custkey)"""
)


@query(f"WITH RECURSIVE {_RISK} SELECT * FROM c")
def risk_contexts(spark, sf):
    return _risk_contexts(spark, sf).select("vid", "direct", "distance", "transfers", "pep", "high_risk")


def _risk_contexts(spark, sf) -> DataFrame:
    g = _risk_graph(spark, sf)
    found = g.listed().select("vid").distinct()
    near = risk.exposures(P.links(P.shared_reasons(D.offer_owners(spark, sf))), found)
    return risk.contexts(g, g.vertices.where("tag = 'person'"), near)


@query(
    f"""WITH RECURSIVE {_RISK}, z AS (SELECT vid, round(least(1.0::DOUBLE, CASE WHEN direct THEN 1.0 ELSE 0 END + 0.8::DOUBLE * coalesce(greatest(0.0::DOUBLE, 0.8::DOUBLE - 0.2::DOUBLE * (distance - 1)), 0) + 0.5::DOUBLE * least(transfers / 3.0::DOUBLE, 1.0)
+ 0.7::DOUBLE * CASE pep WHEN 'self' THEN 1.0::DOUBLE WHEN 'associate' THEN 0.7 ELSE 0 END + CASE WHEN high_risk THEN 0.3::DOUBLE ELSE 0 END), 4) AS score,
concat_ws(' ', CASE WHEN direct THEN 'Entity directly matches a sanctions record' END, 'Entity is connected within ' || distance || ' degree(s) to a sanctioned entity', CASE WHEN transfers > 0 THEN 'Entity shares bank account links with flagged entities' END,
CASE pep WHEN 'self' THEN 'Entity is a politically exposed person — enhanced due diligence required' WHEN 'associate' THEN 'Entity is a relative or close associate of a politically exposed person' END, CASE WHEN high_risk THEN 'Entity is associated with a high-risk jurisdiction' END) AS said FROM c)
SELECT vid, score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS level, CASE WHEN said = '' THEN '{risk.NOTHING_FOUND}' ELSE said END AS summary FROM z"""
)
def risk_scores(spark, sf):
    """All five factors: listings, exposure through shared offers, transfers, public office, risky nations."""
    return risk.risk_scores(_risk_contexts(spark, sf)).select("vid", "score", "level", risk.explanation(F.col("factors")).alias("summary"))


@query(f"SELECT c_custkey, {_PEP_SQL} AS pep FROM customer")
def pep_class(spark, sf):
    return D.table(spark, sf, "customer").select("c_custkey", T.classify_pep(_pep_status()).alias("pep"))


_PROFILE = "SELECT '{0}' AS \"column\", '{1}' AS type, round(1 - count(v) / count(*), 4)::DOUBLE AS null_ratio, round(count(DISTINCT v) / greatest(1, count(v)), 4)::DOUBLE AS distinct_ratio FROM (SELECT {2} AS v FROM customer)"


@query(
    " UNION ALL ".join(_PROFILE.format(*x) for x in (
        ("c_custkey", "int", "c_custkey"), ("c_acctbal", "float", "c_acctbal"), ("c_mktsegment", "string", "CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END"), ("in_debt", "bool", "CASE WHEN c_custkey % 5 > 0 THEN c_acctbal < 0 END"), ("blank", "string", "NULL::VARCHAR"),
    ))
)
def csv_profile_columns(spark, sf):
    """Columns of each type, with and without blanks, and one without a value."""
    c = D.table(spark, sf, "customer").select(
        "c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).otherwise(" ").alias("c_mktsegment"), F.when(F.col("c_custkey") % 5 > 0, F.when(F.col("c_acctbal") < 0, "Yes").otherwise("no")).alias("in_debt"), F.lit("").alias("blank")
    )
    return csv_profile.profile(c).drop("samples")


@query(
    f"""WITH {_S}, {_DR}, l AS (SELECT DISTINCT p1, p2 FROM s), w AS (SELECT DISTINCT p1, p2 FROM dr) SELECT p1, p2 FROM w WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.p1 = w.p1 AND l.p2 = w.p2)"""
)
def network_delta(spark, sf):
    """Pairs that the direct edges add to the shared ones."""
    persons = D.hierarchy(spark, sf).vertices.where("tag = 'person'").select("vid")
    return views.delta(P.shared_reasons(D.offer_owners(spark, sf)), P.direct_reasons(D.direct_edges(spark, sf), persons))
