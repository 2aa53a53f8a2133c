"""Networks, sinks, imports, evidence, records and streams on small inputs with known answers."""

from __future__ import annotations

import datetime
import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import records
from graphloom.operators import evidence as E
from graphloom.operators import network as N
from graphloom.operators import resolution, views
from graphloom.operators.graph import PropertyGraph
from graphloom.sinks import catalog, graph_store
from graphloom.sources import csv_import, text_files
from graphloom.streaming import value_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def rows(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


def test_sources_of_a_graph(spark):
    v = spark.createDataFrame([("a", "person"), ("b", "person"), ("ph", "phone")], "vid string, tag string")
    e = spark.createDataFrame([("a", "ph", "HAS_PHONE"), ("ph", "b", "HAS_PHONE"), ("a", "b", "CITIZEN_OF"), ("a", "b", "PAYS")], "src string, dst string, edge_type string")
    s = N.sources(v, e)
    assert rows(s.owners, "connector", "person") == {("ph", "a"), ("ph", "b")} and s.direct.count() == 1
    assert N.connector_types(["CITIZEN_OF", "PAYS"], [" citizen_of "]) == {"direct": [], "shared": ["CITIZEN_OF"], "bridge": []}


def test_network_of_given_sources(spark):
    owners = spark.createDataFrame([("ph", "phone", "a"), ("ph", "phone", "b"), ("co", "company", "b"), ("co", "company", "c"), ("x", "company", "d")], "connector string, tag string, person string")
    direct = spark.createDataFrame([("c", "b", "PAYS"), ("b", "c", "PAYS")], "src string, dst string, edge_type string")
    s = N.Sources(owners, direct, spark.createDataFrame([("co", "x", "PAYS")], "src string, dst string, edge_type string"))
    n = N.person_network(s, "a", 3)
    assert rows(n.persons, "vid", "degree") == {("a", 0), ("b", 1), ("c", 2), ("d", 2)}
    got = {(r.p1, r.p2): (r.degree, r.via_count, r.confidence) for r in n.links().collect()}
    # Two payments are two reasons on the level where they are first met.
    assert got == {("a", "b"): (1, 1, 0.8), ("b", "c"): (2, 3, pytest.approx(0.994)), ("b", "d"): (2, 1, 0.4), ("c", "d"): (2, 1, 0.4)}


def test_graph_neighbourhoods(spark):
    v = spark.createDataFrame([("a", "person", None), ("b", "person", None), ("s", "sanction_entry", None)], "vid string, tag string, label string")
    e = spark.createDataFrame([("a", "b", "KNOWS", 0), ("b", "a", "KNOWS", 0), ("s", "b", "LISTS", 0)], "src string, dst string, edge_type string, rank long")
    g = PropertyGraph(v, e)
    assert rows(g.listed(), "vid", "listing") == {("b", "s")}
    assert rows(g.expand("zz")[0], "vid", "depth") == {("zz", 0)}
    near, edges = g.neighbors_with_edges("b", limit=1)
    assert rows(near, "vid") == {("a",)} and edges.count() == 2
    assert [(r.step, r.vid) for r in g.walks("s", 3).collect()] == [(1, "b"), (2, "a"), (3, "b")]
    assert rows(g.visible(["sanction_entry"], [])[1], "edge_type") == {("KNOWS",)}


def test_store(spark):
    old = spark.createDataFrame([("a", "person", "Old"), ("b", "person", "Bob")], "vid string, tag string, label string")
    new = spark.createDataFrame([("a", "person", "New", 1), ("a", "person", "Newer", 2)], "vid string, tag string, label string, seq int")
    assert rows(graph_store.insert(old, new, graph_store.VERTEX_KEY, "seq"), "vid", "label") == {("a", "Newer"), ("b", "Bob")}
    with pytest.raises(ValueError):
        graph_store.insert(old, new.drop("label"), graph_store.VERTEX_KEY, "seq")
    p = spark.createDataFrame([("a", {"x": "1", "y": "2"})], "vid string, props map<string,string>")
    q = spark.createDataFrame([("a", {"y": "3"}), ("c", {"z": "4"})], "vid string, props map<string,string>")
    assert {r.vid: r.props for r in graph_store.upsert_props(p, q, ["vid"]).collect()} == {"a": {"x": "1", "y": "3"}, "c": {"z": "4"}}
    e = spark.createDataFrame([("a", "b", "R", 0), ("b", "c", "R", 0), ("a", "c", "R", 0)], "src string, dst string, edge_type string, rank long")
    assert graph_store.delete_vertices(old, e, old.where("vid = 'b'"), with_edges=True)[1].count() == 1
    m = spark.createDataFrame([("b", "a")], "old string, new string")
    assert rows(graph_store.remap(e, m), "src", "dst") == {("a", "c")}
    o = spark.createDataFrame([("a", {"passport": "P-12 34", "gender": "female", "born": "1990"}), ("b", {"number": "p1234"})], "owner string, props map<string,string>")
    vertices, edges = graph_store.field_value_index(o)
    assert rows(vertices, "label") == {("p1234",)} and edges.count() == 2


def test_catalog(spark):
    v = spark.createDataFrame([("a", "person", "A", {"full_name": "A", "confidence": "1.5"}), ("b", "phone", "", {})], "vid string, tag string, label string, props map<string,string>")
    assert rows(catalog.vertex_errors(v), "vid", "error") == {("a", "confidence must be in 0..1"), ("b", "label is required"), ("b", "number is required")}
    with pytest.raises(ValueError):
        catalog.checked("a; drop")


def test_import(spark, tmp_path):
    C = csv_import.Column
    s = csv_import.infer(spark, [C("sender_id", "int", 0.5), C("receiver_id", "int", 0.5), C("relation", "string", 0.1), C("amount", "float", 1.0)], "my file")
    assert (s.ends, s.type, s.edge_type, s.properties) == (("sender_id", "receiver_id"), "relation", "MY_FILE", ("amount",))
    s = csv_import.infer(spark, [C("person_a", "string", 0.6), C("person_b", "string", 0.8), C("since", "int", 0.6)], "friends")
    assert (s.ends, s.tag, s.properties) == (("person_b", "person_a"), "person", ("since",))
    s = csv_import.infer(spark, [C("x", "string", 0.5), C("y", "string", 0.5), C("z", "string", 0.5)], "9 lives")
    assert (s.ends, s.tag, s.edge_type) == (("x", "y"), "entity", "_9_LIVES")
    s = csv_import.infer(spark, [C("source", "string", 1.0), C("target", "string", 1.0), C("relationship", "string", 0.3), C("since", "int", 0.9)], "calls")
    assert (s.ends, s.type, s.properties) == (("source", "target"), "relationship", ("since",))
    with pytest.raises(ValueError):
        csv_import.infer(spark, [], "none")
    s = csv_import.infer(spark, [C("id", "int", 1.0), C("full name", "string", 1.0)], "people")
    assert (s.id, s.tag) == ("id", "people")
    (tmp_path / "people.csv").write_text("id,name,age\n1,Ann,30\n2,Bob,x\n1,Again,5\n")
    made = csv_import.import_csv(spark, str(tmp_path / "people.csv"))
    assert made.structure.id == "id" or made.structure.ends
    s = csv_import.Structure("people", ("name", "age"), id="id")
    made = csv_import.run(csv_import.read_rows(spark, str(tmp_path / "people.csv")), "people", s)
    assert rows(made.vertices, "vid", "label", "copies") == {("1", "Ann", 1), ("2", "Bob", 0)}
    assert made.report()["rows"] == 3 and made.report()["duplicates"] == 1


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.bin").write_bytes(b"x")
    assert rows(text_files.read_texts(spark, str(tmp_path)), "text") == {("hello",)}


def test_evidence(spark):
    i = spark.createDataFrame([("s1", " call +1 (663) 555-6869 or Ann@Example.com "), ("s2", "call +1 (663) 555-6869 or Ann@Example.com"), ("s3", " "), ("s4", "ann@example.com"), ("s5", None)], "source string, text string")
    ev = E.ingest(i)
    assert rows(ev, "source") == {("s1",), ("s4",)}
    known = ev.select("sha256", F.lit("written").alias("status"))
    assert E.ingest(i, known).count() == 0 and E.ingest(i, known.withColumn("status", F.lit("failed"))).count() == 2
    m = E.resolve_keys(E.normalized(E.extracted(ev)))
    assert rows(E.registry(m), "canonical_name", "evidence_count") == {("ann@example.com", 2), ("+16635556869", 1)}
    gone = ev.where("source = 's1'").select("evidence_id")
    left, orphans = E.delete_evidence(m, gone)
    assert left.count() == 1 and orphans.count() == 1


def test_gates_reviews_and_proposals(spark):
    f, items = E.facts(spark.createDataFrame([(1, 0.9), (2, 0.6), (3, 0.1)], "item_id int, confidence double"))
    assert rows(items, "item_id", "state") == {(2, "open"), (3, "rejected")}
    d = spark.createDataFrame([(2, True), (3, True)], "item_id int, approve boolean")
    assert rows(E.review(items, d), "item_id", "state") == {(2, "approved"), (3, "rejected")}
    p = spark.createDataFrame([("a", "a", "R", 0.65), ("a", "b", "R", 0.65), ("a", "b", "R", 0.65), ("a", "c", "R", 0.9)], "src string, dst string, type string, confidence double")
    assert rows(E.proposals(p, p.where("dst = 'b'")), "dst", "status") == {("c", "proposed")}
    s = spark.createDataFrame([("m", "x", 0.95), ("m", "y", 0.8), ("n", "x", 0.8), ("o", "x", 0.6)], "mention string, id string, score double")
    assert rows(E.decide(s), "mention", "action", "id") == {("m", "merge", "x"), ("n", "suggest", "x"), ("o", "create", None)}
    assert one(spark, E.identity_score(F.lit(0.95), F.lit(True), F.lit(None).cast("boolean"))) == 1.0


def test_relationships(spark):
    m = spark.createDataFrame([("e", "1", "Person"), ("e", "2", "Company")], "evidence_id string, local_id string, type string")
    r = spark.createDataFrame([("e", "1", "2", "works at"), ("e", "2", "1", "OWNS"), ("e", "1", "9", "PAYS"), ("e", "1", "2", "likes")], "evidence_id string, source string, target string, type string")
    assert rows(E.valid_relationships(r, m), "source", "type", "label") == {("1", "WORKS_AT", None), ("2", "RELATED_TO", "OWNS"), ("1", "RELATED_TO", None)}


def test_records(spark):
    assert one(spark, records.person_name(F.lit("  jOHN  q. public"))) == "John Q. Public"
    assert [one(spark, records.date(F.lit(s))) for s in ("03/04/2020", "2020-04-03", "3 Apr 2020", "soon")] == ["2020-04-03"] * 3 + [None]
    assert [one(spark, records.phone(F.lit(s))) for s in ("+1 (663) 555-6869", "098765 43210", "0044 20 7946 0958", "12")] == ["+16635556869", "+919876543210", "+442079460958", None]
    assert one(spark, records.properties(F.lit('{"a": 1, "b": "", "c": [], "d": null}'))) == {"a": "1"}
    assert one(spark, records.properties(F.lit("not json"))) == {}
    assert one(spark, records.json_object(F.lit('Sure:\n```json\n{"a": 1}\n```'))).strip() == '{"a": 1}'
    assert one(spark, records.json_object(F.lit('so {"a": {"b": 2}} it is'))) == '{"a": {"b": 2}}'
    assert one(spark, records.stage_index(F.lit("resolved"))) == 2 and one(spark, records.stage_index(F.lit("x"))) == -1
    df = spark.createDataFrame([("Ann Lee", "lee ann"), ("abc def", "def abc"), (None, "x")], "a string, b string")
    assert [r.x for r in df.select(records.token_sort_ratio("a", "b").alias("x")).collect()][1:] == [1.0, 0.0]


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = list(itertools.accumulate(range(len(b)), lambda left, j: row[j] + 1 if x == b[j] else max(left, row[j + 1]), initial=0))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=80), st.text("abcd", max_size=80))
def test_common_subsequence(a, b):
    assert records._lcs(a, b) == _lcs(a, b)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab ", max_size=30), max_size=60))
def test_chunks_cover_whole_lines(lines):
    text = "\n".join(lines)
    chunks = records.chunks_of(text, 64, 16)
    at = 0
    for c in chunks:
        assert text.find(c, max(0, at - 16)) >= 0 and text.find(c, max(0, at - 16)) <= at
        at = text.find(c, max(0, at - 16)) + len(c)
    assert chunks[0] == text[: len(chunks[0])] and text.endswith(chunks[-1])


def test_halves():
    assert records.halves("ab\ncd\nef") == ("ab", "\ncd\nef")
    assert "".join(records.halves("abcdef")) == "abcdef" and records.halves("abcdef")[0] == "abc"
    assert records.halves("abcdefgh\ni")[1] == "\ni" and records.halves("") == ("", "")


def test_views(spark):
    v = spark.createDataFrame([("r", "p"), ("x", "p"), ("y", "q")], "vid string, tag string")
    e = spark.createDataFrame([("r", "x", "R", 0), ("x", "y", "R", 0)], "src string, dst string, edge_type string, rank long")
    o = spark.createDataFrame([("r", "x", "R", "r"), ("x", "y", "R", "x")], "src string, dst string, edge_type string, owner string")
    shown, edges = views.collapse(v, e, o, "r", "x")
    assert rows(shown, "vid") == {("r",), ("x",)} and edges.count() == 1
    v2, e2 = views.expand_into(shown, edges, v, e)
    assert v2.count() == 3 and e2.count() == 2
    old = spark.createDataFrame([("a", "b")], "p1 string, p2 string")
    new = spark.createDataFrame([("b", "a"), ("b", "c")], "p1 string, p2 string")
    assert rows(views.delta(old, new), "p1", "p2") == {("b", "c")}


def test_nearest(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "id int, vector array<double>")
    q = df.where("id % 4 = 0")
    whole, blocked = resolution.nearest(q, df, 3), resolution.nearest(q, df, 3, block=2)
    assert rows(whole, "query", "id", "rank") == rows(blocked, "query", "id", "rank") and whole.count() == 30


def test_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([("a", "mail x@y.com", at), ("b", "mail x@y.com ", at), ("c", " ", at)], "source string, text string, at timestamp").write.parquet(str(tmp_path / "in"))
    incoming = spark.readStream.schema("source string, text string, at timestamp").parquet(str(tmp_path / "in"))
    q = value_stream.write(value_stream.new_evidence(incoming), str(tmp_path / "out"), str(tmp_path / "state"))
    assert q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_wide_identifiers_keep_all_links(spark, tmp_path):
    from graphloom.plans import evidence_queries, queries

    texts = [(i, "mail wide@example.org", "en") for i in range(30)] + [(i, "mail slim@example.org", "en") for i in (3, 40)]
    spark.createDataFrame(texts, "doc_id bigint, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    pairs = evidence_queries.shared_identifier_pairs(spark, str(tmp_path))
    assert rows(pairs, "p1", "p2") == {("3", "40")}
    members = evidence_queries.shared_identifier_members(spark, str(tmp_path)).collect()
    assert sorted(int(m["person"]) for m in members) == list(range(30))
    assert {(m["label"], m["representative"]) for m in members} == {("shares_email", "0")}
    both = rows(pairs, "p1", "p2") | set(itertools.combinations(sorted(m["person"] for m in members), 2))
    assert both == {(a, b) for a, b in itertools.product(map(str, range(41)), repeat=2) if a < b and (max(int(a), int(b)) < 30 or {a, b} == {"3", "40"})}
    assert "shared_identifier_members" in queries.QUERIES


def test_members_of_all_shared_identifiers(spark, tmp_path):
    from graphloom.plans import evidence_queries

    texts = [(i, "mail wide@example.org", "en") for i in range(30)] + [(i, "mail slim@example.org", "en") for i in (3, 40)] + [(50, "mail own@example.org", "en")]
    spark.createDataFrame(texts, "doc_id bigint, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    members = evidence_queries.identifier_members(spark, str(tmp_path)).collect()
    held = {}
    for m in members:
        held.setdefault((m["connector"], m["representative"]), []).append(int(m["person"]))
    assert sorted((r, sorted(p)) for (_, r), p in held.items()) == [("0", list(range(30))), ("3", [3, 40])]
