"""Registered queries of lookups, stores, lists, jobs, resolution and views, and their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import countries, records
from graphloom.functions import text as T
from graphloom.operators import evidence as E
from graphloom.operators import network as N
from graphloom.operators import projection as P
from graphloom.operators import resolution as R
from graphloom.operators import views
from graphloom.plans import driver_graph as D
from graphloom.plans.evidence_queries import _ALL, _sources
from graphloom.plans.queries import _DR, _E, _L, _S, _U, _V, query
from graphloom.sinks import entity_store as store
from graphloom.sinks import graph_store, workspace


def _c(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column))


# ---- lookups


@query(f"WITH {_E} SELECT src, dst, edge_type FROM e WHERE edge_type = 'CITIZEN_OF' AND dst = 'n:1'")
def existing_edges(spark, sf):
    """Which customers an edge leads from to the second nation, asked of all."""
    g = D.hierarchy(spark, sf)
    keys = g.vertices.where("tag = 'person'").select(F.lit("CITIZEN_OF").alias("edge_type"), F.col("vid").alias("src"), F.lit("n:1").alias("dst"), F.lit(0).cast("long").alias("rank"))
    return g.existing_edges(keys).select("src", "dst", "edge_type")


@query(f"WITH {_E} SELECT src, dst, edge_type, 0::BIGINT AS rank FROM e WHERE src = 's:1'")
def edge_lookup(spark, sf):
    g = D.hierarchy(spark, sf)
    to = D.table(spark, sf, "supplier").where("s_suppkey = 1").first()["s_nationkey"]
    return g.edge("LOCATED_AT", "s:1", f"n:{to}").select("src", "dst", "edge_type", "rank")


@query(f"WITH {_V} SELECT vid, tag, label FROM v WHERE vid IN ('s:1', 'c:7', 'n:3')")
def vertex_lookup(spark, sf):
    g = D.hierarchy(spark, sf)
    return g.get(spark.createDataFrame([("s:1",), ("c:7",), ("n:3",), ("gone",)], "vid string")).select("vid", "tag", "label")


@query(f"WITH {_V} SELECT min(vid) AS vid FROM v WHERE tag = 'person' AND label = (SELECT c_name FROM customer WHERE c_custkey = 42)")
def unique_field(spark, sf):
    name = D.table(spark, sf, "customer").where("c_custkey = 42").first()["c_name"]
    return spark.createDataFrame([(D.hierarchy(spark, sf).find_by("person", "label", name),)], "vid string")


@query(f"WITH {_U}, {_V} SELECT DISTINCT vid, tag, label FROM v JOIN u ON vid = b WHERE a = 'n:1' AND vid IN (SELECT DISTINCT b FROM u WHERE a = 'n:1' ORDER BY b LIMIT 20)")
def neighbors_limited(spark, sf):
    return D.hierarchy(spark, sf).neighbors("n:1", direction="both", limit=20).select("vid", "tag", "label")


@query(f"WITH {_U}, {_V}, k AS (SELECT DISTINCT vid FROM v JOIN u ON vid = b WHERE a = 'n:1' ORDER BY vid LIMIT 10), m AS (FROM k UNION SELECT 'n:1') SELECT src, dst, edge_type FROM e WHERE src IN (FROM m) AND dst IN (FROM m)")
def neighbors_with_edges_limited(spark, sf):
    return D.hierarchy(spark, sf).neighbors_with_edges("n:1", limit=10)[1].select("src", "dst", "edge_type")


@query(f"WITH {_V} SELECT vid, tag AS tags, label FROM v")
def nodes(spark, sf):
    return D.hierarchy(spark, sf).nodes().select("vid", F.array_join("tags", ",").alias("tags"), "label")


@query(f"WITH {_E} SELECT src AS vid, dst AS other FROM e WHERE edge_type = 'LOCATED_AT'")
def one_step(spark, sf):
    g = D.hierarchy(spark, sf)
    return g.one_step(g.vertices.where("tag = 'supplier'"), "LOCATED_AT")


@query(f"WITH {_V} SELECT vid, tag, label FROM v WHERE lower(label) LIKE '%er#00000001%'")
def entity_search(spark, sf):
    return D.hierarchy(spark, sf).search(" ER#00000001 ", limit=None).select("vid", "tag", "label")


# ---- stores

_KINDS = ("Person", "Company", "Phone", "Email", "Document")


def _entities(spark, sf) -> DataFrame:
    c, k = D.table(spark, sf, "customer"), F.col("c_custkey") % 5
    bag = F.create_map(F.lit("number"), F.concat(F.lit("N"), F.col("c_custkey")), F.lit("segment"), F.col("c_mktsegment"))
    return c.select(_c("c:", "c_custkey").alias("entity_id"), F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (k + 1).cast("int")).alias("type"), F.col("c_name").alias("name"), (F.col("c_acctbal") / 10000).alias("confidence"), F.when(k == 0, F.array(F.lit("A"))).alias("aliases"), bag.alias("attributes"), _c("e:", "c_nationkey").alias("evidence_id"))


@query(
    """SELECT 'c:' || c_custkey AS vid, ['person', 'company', 'phone', 'email', 'document'][c_custkey % 5 + 1] AS tag, c_name AS label, ['Person', 'Company', 'Phone', 'Email', 'Document'][c_custkey % 5 + 1] AS entity_type,
CASE c_custkey % 5 WHEN 2 THEN 'N' || c_custkey WHEN 4 THEN 'N' || c_custkey WHEN 3 THEN '' END AS key, '{"aliases":' || CASE WHEN c_custkey % 5 = 0 THEN '["A"]' ELSE '[]' END || ',"number":"N' || c_custkey || '","segment":"' || c_mktsegment || '"}' AS props,
c_acctbal / 10000 AS confidence, '["e:' || c_nationkey || '"]' AS evidence_ids FROM customer"""
)
def entity_rows(spark, sf):
    return store.entity_rows(_entities(spark, sf)).drop("updated_at")


@query("SELECT 'c:' || c_custkey AS src, 'e:' || c_nationkey AS dst, 'SUPPORTED_BY' AS edge_type, c_acctbal / 10000 AS extraction_confidence FROM customer")
def support_edges(spark, sf):
    s = _entities(spark, sf).select("entity_id", "evidence_id", "confidence")
    return store.supported_by(s.unionByName(s.withColumn("confidence", F.col("confidence") - 1))).drop("rank")


@query("SELECT 'c:' || o_custkey AS src, o_orderstatus AS dst, 'PAYS' AS edge_type, 'accepted' AS status, max(lpad(o_orderkey::VARCHAR, 12, '0')) AS evidence_ids, max_by(o_orderpriority, o_orderkey) AS relationship_type, count(DISTINCT 1) AS edges FROM orders GROUP BY o_custkey, o_orderstatus")
def relationship_rows(spark, sf):
    """One edge a customer and status, as their last order by key gives it."""
    o = D.table(spark, sf, "orders").select(_c("c:", "o_custkey").alias("src"), F.col("o_orderstatus").alias("dst"), F.lit("PAYS").alias("type"), F.lit(0.9).alias("confidence"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("evidence_id"), F.col("o_orderpriority").alias("label"))
    rows = store.relationship_rows(o).groupBy("src", "dst", "edge_type", "status", "evidence_ids", "relationship_type").agg(F.count("*").alias("edges"))
    return rows


@query("SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE c_mktsegment END AS note, c_custkey AS n FROM customer")
def upsert_edges(spark, sf):
    c = D.table(spark, sf, "customer")
    key = [_c("c:", "c_custkey").alias("src"), _c("n:", "c_nationkey").alias("dst"), F.lit("R").alias("edge_type"), F.lit(0).cast("long").alias("rank")]
    old = c.select(*key, F.col("c_mktsegment").alias("note"), F.col("c_custkey").alias("n"))
    new = c.select(*key, F.when(F.col("c_acctbal") < 0, "debt").alias("note"))
    return store.upsert_edges(old, new).select("src", "dst", "note", "n")


@query("SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst FROM customer WHERE c_acctbal >= 0")
def deleted_edges(spark, sf):
    g = D.hierarchy(spark, sf)
    gone = D.table(spark, sf, "customer").where("c_acctbal < 0").select(_c("c:", "c_custkey").alias("src"), _c("n:", "c_nationkey").alias("dst"), F.lit("CITIZEN_OF").alias("edge_type"), F.lit(0).cast("long").alias("rank"))
    return graph_store.delete_edges(g.edges, gone).where("edge_type = 'CITIZEN_OF'").select("src", "dst")


@query(
    """WITH m AS (SELECT 'c:' || c_custkey AS vid, 'c:' || (c_custkey - c_custkey % 10) AS new FROM customer WHERE c_custkey >= 10),
e AS (SELECT 'c:' || a.o_custkey AS src, 'c:' || b.o_custkey AS dst FROM orders AS a JOIN orders AS b ON b.o_orderkey = a.o_orderkey + 1)
SELECT DISTINCT coalesce(x.new, src) AS src, coalesce(y.new, dst) AS dst FROM e LEFT JOIN m AS x ON src = x.vid LEFT JOIN m AS y ON dst = y.vid WHERE coalesce(x.new, src) <> coalesce(y.new, dst)"""
)
def merged_edges(spark, sf):
    """Customers of one ten merged into its first: loops and repeated edges go."""
    m = D.table(spark, sf, "customer").where("c_custkey >= 10").select(_c("c:", "c_custkey").alias("old"), F.concat(F.lit("c:"), F.col("c_custkey") - F.col("c_custkey") % 10).alias("new"))
    e = D.direct_edges(spark, sf).select("src", "dst", F.lit("R").alias("edge_type"), F.lit(0).cast("long").alias("rank"))
    return graph_store.remap(e, m).select("src", "dst")


@query("SELECT 'c:' || c_custkey AS src, k AS field_key, d AS document_id FROM customer, (VALUES ('segment', ''), ('street', '-doc')) AS t(k, s), LATERAL (SELECT CASE WHEN s = '' THEN '' ELSE 'd:' || c_custkey END AS d)")
def reindexed_values(spark, sf):
    """The value index rebuilt from customers and a document of each."""
    c = D.table(spark, sf, "customer")
    one = lambda k, v: F.create_map(F.lit(k), v)
    v = c.select(_c("c:", "c_custkey").alias("vid"), F.lit("person").alias("tag"), one("segment", F.col("c_mktsegment")).alias("props"))
    v = v.unionByName(c.select(_c("d:", "c_custkey").alias("vid"), F.lit("document").alias("tag"), one("street", F.col("c_name")).alias("props")))
    e = c.select(_c("c:", "c_custkey").alias("src"), _c("d:", "c_custkey").alias("dst"), F.lit("HAS_DOCUMENT").alias("edge_type"))
    return graph_store.reindexed(v, e)[1].select("src", "field_key", "document_id")


# ---- lists, cases, jobs


@query("SELECT c_custkey AS entity_id, c_name AS canonical_name FROM customer WHERE c_mktsegment = 'BUILDING' AND lower(c_name) LIKE '%00%' ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def entity_list(spark, sf):
    e = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("type"), F.col("c_name").alias("canonical_name"), F.col("c_acctbal").alias("updated_at"))
    return E.entity_list(e, "BUILDING", " 00").select("entity_id", "canonical_name")


@query(
    """WITH t AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)
SELECT o_orderkey AS evidence_id, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS last FROM t JOIN lineitem ON l_orderkey = o_orderkey QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber DESC, l_returnflag DESC, l_shipdate DESC) = 1"""
)
def evidence_list(spark, sf):
    """Orders as evidence, their lines as the log."""
    ev = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("evidence_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("uploaded_at"))
    log = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("evidence_id"), F.col("l_returnflag").alias("stage"), F.col("l_linenumber").alias("at"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("detail"))
    return E.evidence_list(ev, "P", 50, log).where("detail IS NOT NULL").select("evidence_id", F.col("detail").alias("last"))


@query("SELECT o_orderkey AS item_id, CASE WHEN o_custkey % 2 = 0 THEN 'entity' ELSE 'relationship' END AS kind FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 200")
def review_queue(spark, sf):
    o = D.table(spark, sf, "orders")
    items = o.select(F.col("o_orderkey").alias("item_id"), F.col("o_orderkey").alias("fact_id"), F.when(F.col("o_orderstatus") == "F", "open").otherwise("approved").alias("state"), F.col("o_orderdate").alias("created_at"))
    kinds = o.select(F.col("o_orderkey").alias("fact_id"), F.when(F.col("o_custkey") % 2 == 0, "entity").otherwise("relationship").alias("kind"))
    return E.queue(items, facts=kinds).select("item_id", "kind")


@query("SELECT o_orderkey AS item_id FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def pending_reviews(spark, sf):
    items = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"), F.col("o_orderpriority").alias("queue_type"))
    return workspace.pending_reviews(items, "1-URGENT").select("item_id")


@query(
    """WITH j AS (SELECT o_orderkey AS job_id, o_orderstatus = 'O' AS pending, o_custkey % 3 AS held, o_orderdate < TIMESTAMP '1996-01-01' AS late, o_custkey % 4 AS attempt, o_orderkey AS created FROM orders),
k AS (SELECT job_id FROM j WHERE attempt < 3 AND CASE WHEN pending THEN held = 0 OR late ELSE late AND held > 0 OR late AND held = 0 END ORDER BY created, job_id LIMIT 25)
SELECT job_id, (attempt + 1)::BIGINT AS attempt, 'w1' AS lease_owner FROM j JOIN k USING (job_id)"""
)
def claimed_jobs(spark, sf):
    """Orders as jobs: waiting or held, late or not, tried too often."""
    o = D.table(spark, sf, "orders")
    jobs = o.select(
        F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("running").alias("status"), (F.col("o_custkey") % 4).alias("attempt"), F.lit(3).alias("max_attempts"),
        F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit("w"), F.col("o_custkey") % 3 + 1)).otherwise("").alias("lease_owner"), F.col("o_orderdate").cast("timestamp").alias("lease_expires_at"), F.col("o_orderkey").alias("created_at"),
    )
    now = datetime.datetime(1996, 1, 1)
    held = workspace.claimed(jobs, "w1", now, limit=25).where(F.col("lease_expires_at") == F.lit(now + workspace.LEASE))
    return held.where("lease_owner = 'w1' AND status = 'running'").select("job_id", "attempt", "lease_owner")


@query("SELECT DISTINCT 'case:' || c_nationkey AS src, 'c:' || c_custkey AS dst, 'subject' AS subject_role FROM customer")
def case_subjects(spark, sf):
    r = D.table(spark, sf, "customer").select(_c("case:", "c_nationkey").alias("case_id"), _c("c:", "c_custkey").alias("entity_id"), F.lit("subject").alias("subject_role"), F.lit("me").alias("added_by"))
    return workspace.subjects(r.unionByName(r)).select("src", "dst", "subject_role")


# ---- resolution


@query("SELECT s_suppkey AS record, CASE s_suppkey % 4 WHEN 0 THEN 'merge' WHEN 1 THEN 'merge' WHEN 2 THEN 'review' ELSE 'create' END AS action, CASE WHEN s_suppkey % 4 < 2 THEN s_suppkey END AS id FROM supplier")
def resolved_records(spark, sf):
    """A record of each supplier against the suppliers: by passport, by the name's words in another order, with a likely name, with an unlike one."""
    s, k, name = D.table(spark, sf, "supplier"), F.col("s_suppkey") % 4, F.md5(F.col("s_suppkey").cast("string"))
    words = lambda *at: F.concat_ws(" ", *[F.substring(name, a, n) for a, n in at])
    label = F.when(k == 0, "somebody else").when(k == 1, words((17, 16), (1, 16))).when(k == 2, words((17, 6), (1, 16))).otherwise(F.lit("#"))
    asked = s.select(F.col("s_suppkey").alias("record"), label.alias("label"), F.when(k == 0, _c("P", "s_suppkey")).alias("passport_number"))
    return R.resolve_records(asked, s.select(F.col("s_suppkey").alias("id"), words((1, 16), (17, 16)).alias("label"), _c("P", "s_suppkey").alias("passport_number"))).select("record", "action", "id")


@query(
    """SELECT s_suppkey AS mention, CASE s_suppkey % 3 WHEN 0 THEN 'deterministic' WHEN 1 THEN 'fuzzy' ELSE 'new' END AS method, CASE WHEN s_suppkey % 3 < 2 THEN s_suppkey END AS id FROM supplier"""
)
def resolution_cascade(spark, sf):
    s, k, name = D.table(spark, sf, "supplier"), F.col("s_suppkey") % 3, F.md5(F.col("s_suppkey").cast("string"))
    m = s.select(F.col("s_suppkey").alias("mention"), F.lit("Company").alias("type"), F.when(k == 1, F.concat_ws(" ", F.substring(name, 17, 16), F.substring(name, 1, 16))).otherwise("x").alias("name"), F.when(k == 0, _c("K", "s_suppkey")).alias("key"))
    r = s.select(F.col("s_suppkey").alias("id"), F.lit("Company").alias("type"), F.concat_ws(" ", F.substring(name, 1, 16), F.substring(name, 17, 16)).alias("name"), _c("K", "s_suppkey").alias("key"))
    return R.cascade(m, r).select("mention", "method", "id")


@query("SELECT c_custkey AS mention, 'M' || c_custkey % 7 AS name, 'c:' || c_nationkey AS type, CASE WHEN n > 1 THEN 'several' ELSE 'one' END AS seen FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_custkey % 7) AS n FROM customer)")
def resolved_names(spark, sf):
    """Mentions of one type and name are one entity, whatever the letters' case."""
    m = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("mention"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "m").otherwise("M"), F.col("c_custkey") % 7).alias("name"), _c("c:", "c_nationkey").alias("type"), F.lit(None).cast("string").alias("key"))
    r = E.resolve_keys(m)
    n = r.groupBy("entity_id").agg(F.count("*").alias("n"))
    return r.join(n, "entity_id").select("mention", F.upper("name").alias("name"), "type", F.when(F.col("n") > 1, "several").otherwise("one").alias("seen"))


# ---- values


@query(
    "SELECT c_custkey, 'Customer#' || lower(split_part(c_name, '#', 2)) || ' Q. Doe' AS name, 'AB' || c_custkey || 'C' AS identifier, '_' || c_custkey || '_c_' || lower(c_mktsegment) AS identifier_name, 'Emirates ID ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS title FROM customer"
)
def normal_forms(spark, sf):
    n = F.col("c_custkey").cast("string")
    return D.table(spark, sf, "customer").select(
        "c_custkey", records.person_name(F.concat(F.lit("  "), F.upper("c_name"), F.lit("  q.   DOE"))).alias("name"), T.normalize_identifier(F.concat(F.lit("ab-"), n, F.lit(" c"))).alias("identifier"),
        T.sanitize_identifier(F.concat(n, F.lit(" (c)-"), F.col("c_mktsegment"), F.lit("!")), "x").alias("identifier_name"), views.title_words(F.concat(F.lit("emirates_id-"), F.col("c_mktsegment"))).alias("title"),
    )


@query("SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'DE' WHEN 1 THEN 'FR' WHEN 2 THEN 'GB' WHEN 3 THEN 'AE' WHEN 4 THEN NULL ELSE 'JP' END AS iso2 FROM supplier")
def country_codes(spark, sf):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("Germany", " fr ", "GBR", "arab emir", "Xy", "JAPAN")]), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return countries.normalized_countries(D.table(spark, sf, "supplier").select("s_suppkey", raw.alias("raw")), "raw", countries.countries(spark)).select("s_suppkey", "iso2")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '+971500' || lpad(c_custkey::VARCHAR, 6, '0') WHEN 1 THEN '+4420' || lpad(c_custkey::VARCHAR, 8, '0') WHEN 2 THEN '+919' || lpad(c_custkey::VARCHAR, 9, '0') END AS phone, CASE WHEN c_custkey % 3 > 0 THEN 'c' || c_custkey || '@x.org' END AS email FROM customer")
def phones_and_emails(spark, sf):
    n, k = F.col("c_custkey").cast("string"), F.col("c_custkey") % 4
    phone = F.when(k == 0, F.concat(F.lit("+971 500-"), F.lpad(n, 6, "0"))).when(k == 1, F.concat(F.lit("0044 (20) "), F.lpad(n, 8, "0"))).when(k == 2, F.concat(F.lit("09"), F.lpad(n, 9, "0"))).otherwise("12")
    email = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit(" C"), n, F.lit("@X.org"))).otherwise(F.concat(n, F.lit(" at x.org")))
    return D.table(spark, sf, "customer").select("c_custkey", records.phone(phone).alias("phone"), T.normalize_email(email).alias("email"))


# ---- views


@query(f"WITH {_S}, {_L.format('s')} SELECT CASE WHEN p1 = 'c:1' THEN p2 ELSE p1 END AS other, confidence FROM l WHERE 'c:1' IN (p1, p2)")
def links_of_one(spark, sf):
    return views.links_of(P.links(P.shared_reasons(D.offer_owners(spark, sf))), "c:1")


@query(
    f"""WITH {_S}, {_DR}, near AS (SELECT connector FROM o WHERE person = 'c:1'), r AS (SELECT p1, p2, confidence, 'shared company' AS said FROM s WHERE connector IN (FROM near) UNION ALL SELECT p1, p2, confidence, 'related to' FROM dr WHERE 'c:1' IN (p1, p2))
SELECT p1, p2, CASE WHEN count(*) = 1 THEN min(said) ELSE count(*) || ' connections' END AS label, round(1 - product(1 - confidence), 4) AS confidence FROM r GROUP BY p1, p2"""
)
def network_labels(spark, sf):
    return N.person_network(_sources(spark, sf), "c:1", 1, max_persons=_ALL).links().select("p1", "p2", "label", "confidence")


@query(
    f"""WITH {_S}, near AS (SELECT connector FROM o WHERE person = 'c:1') SELECT p1, p2, connector, 'Shared company' AS heading, 'Both people hold ' || connector || '.' AS detail FROM s WHERE connector IN (FROM near)"""
)
def described_reasons(spark, sf):
    net = N.person_network(_sources(spark, sf), "c:1", 1, max_persons=_ALL)
    return views.described(net.reasons.where("kind = 'shared_attribute'")).select("p1", "p2", "connector", "heading", "detail")


@query("SELECT row_number() OVER (ORDER BY c_mktsegment <> 'document', c_mktsegment)::INT AS place, c_mktsegment AS tag, count(*) AS n FROM customer GROUP BY c_mktsegment")
def grouped_things(spark, sf):
    return views.grouped(D.table(spark, sf, "customer").select(_c("c:", "c_custkey").alias("id"), F.col("c_mktsegment").alias("tag"))).select("place", "tag", "n")


@query(
    """WITH f AS (SELECT s_suppkey AS id, unnest(['number', 'segment', 'document_type']) AS field_key, unnest(['N' || s_suppkey, s_name, 'card']) AS value FROM supplier)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY CASE field_key WHEN 'document_type' THEN 1 WHEN 'number' THEN 2 ELSE 3 END)::INT AS place, field_key, value, CASE WHEN field_key = 'segment' THEN 'claim' ELSE 'identity' END AS kind, CASE WHEN field_key = 'segment' THEN 's:' || id ELSE '' END AS matched FROM f"""
)
def attribute_fields(spark, sf):
    s = D.table(spark, sf, "supplier")
    bag = F.create_map(F.lit("segment"), F.col("s_name"), F.lit("number"), F.concat(F.lit("N"), F.col("s_suppkey")), F.lit("props"), F.lit("{}"), F.lit("document_type"), F.lit("card"))
    matches = s.select(T.normalize_value(F.col("s_name")).alias("value"), _c("s:", "s_suppkey").alias("person"))
    return views.attribute_fields(s.select(F.col("s_suppkey").alias("id"), bag.alias("props")), matches).select("id", "place", "field_key", "value", "kind", F.array_join("matched_with", ",").alias("matched"))


@query("SELECT 'c:' || c_custkey AS id_src, (1 + c_custkey % 3)::DOUBLE AS weight, least(1.0, greatest(0.0, c_acctbal / 5000))::DOUBLE AS shown_confidence, CASE WHEN c_custkey % 2 = 0 THEN 'friend' ELSE 'R' END AS label FROM customer")
def edge_styles(spark, sf):
    c = D.table(spark, sf, "customer")
    bag = F.create_map(F.lit("via_count"), (F.col("c_custkey") % 3 + 1).cast("string"), F.lit("confidence"), (F.col("c_acctbal") / 5000).cast("string"), F.lit("relationship_type"), F.when(F.col("c_custkey") % 2 == 0, "friend").otherwise(" "))
    e = c.select(_c("c:", "c_custkey").alias("src"), _c("n:", "c_nationkey").alias("dst"), F.lit("R").alias("edge_type"), F.lit(0).cast("long").alias("rank"), bag.alias("props"))
    return views.edge_style(e).select(F.col("src").alias("id_src"), "weight", "shown_confidence", "label")
