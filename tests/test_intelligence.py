"""Resolution, evidence stages, risk, the demo population and the stores, on small inputs with known answers."""

from __future__ import annotations

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import countries, records
from graphloom.operators import evidence as E
from graphloom.operators import network as N
from graphloom.operators import resolution as R
from graphloom.operators import risk, toolbox, views
from graphloom.operators.graph import PropertyGraph
from graphloom.sinks import catalog, entity_store, graph_store, schemas, workspace
from graphloom.sources import csv_import, csv_profile, demo, text_files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def rows(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


# ---- resolution


def test_candidates(spark):
    m = spark.createDataFrame([("m1", "Person", "Smith John", "1980-01-01", "X"), ("m2", "Person", "Zzz", None, None), ("m3", "Company", "John Smith", None, None), ("m4", "Person", "jon smith", None, "")], "mention string, type string, name string, birth string, nationality string")
    r = spark.createDataFrame([("r1", "Person", "John  Smith", ["J. Smith"], "1980-01-01", "X"), ("r2", "Person", "Johnny Smithers", ["smith john"], None, None), ("r3", "Person", "Ann", None, None, None)], "id string, type string, name string, aliases array<string>, birth string, nationality string")
    got = {(x.mention, x.id): (x.score, x.rank) for x in R.fuzzy_candidates(m, r).collect()}
    assert got["m1", "r1"] == (1.0, 1) and got["m1", "r2"] == (1.0, 2)
    assert got["m4", "r1"] == (round(2 * 9 / 19, 4), 1) and not {k for k in got if k[0] in ("m2", "m3")}


def test_scores_are_whole_whatever_the_parts(spark):
    rng = random.Random(6)
    names = ["".join(rng.choices("abc ", k=rng.randint(3, 9))).strip() or "a" for _ in range(60)]
    df = spark.createDataFrame([(n, "t") for n in names], "x string, block string")
    want = {}
    norm = lambda s: " ".join(sorted(s.split()))
    for a in set(map(norm, names)):
        for b in set(map(norm, names)):
            s = records.token_sort_similarity(a, b)
            if s >= 0.6:
                want[a, b] = s
    for rows_ in (5_000, 7):
        got = {(r.x, r.y): r.score for r in R.name_scores(df, df.withColumnRenamed("x", "y"), 0.6, rows_).collect()}
        assert got == pytest.approx(want)


def test_records_resolved(spark):
    known = spark.createDataFrame([("e1", "Ann Lee", "P1", None, None, None), ("e2", "Bob Ray", None, "N2", "1970-01-01", "X"), ("e3", "Carla Montez Diaz", None, None, None, None)], "id string, label string, passport_number string, national_id string, date_of_birth string, nationality string")
    asked = [("a", "Whoever", "P1", "N2", None, None), ("b", "Whoever", None, "N2", None, None), ("c", "Ray Bob", None, None, None, None), ("d", "Carla Montez", None, None, None, None), ("e", "Bob Rayes", None, None, "1970-01-01", "X"), ("f", "Nobody", "", "", None, None), ("g", None, None, None, None, None)]
    got = {r.record: (r.action, r.id) for r in R.resolve_records(spark.createDataFrame(asked, "record string, label string, passport_number string, national_id string, date_of_birth string, nationality string"), known).collect()}
    assert got == {"a": ("merge", "e1"), "b": ("merge", "e2"), "c": ("merge", "e2"), "d": ("review", None), "e": ("merge", "e2"), "f": ("create", None), "g": ("create", None)}


def test_cascade(spark):
    r = spark.createDataFrame([("e1", "Person", "Ann Lee", "k1"), ("e2", "Person", "Robert Ray", None), ("e3", "Person", "Bobby Rai", None)], "id string, type string, name string, key string")
    m = spark.createDataFrame([("m1", "Person", "X", "k1"), ("m2", "Person", "Ray Robert", None), ("m3", "Person", "Rob Ray", None), ("m4", "Person", "Qqqq", None)], "mention string, type string, name string, key string")
    plain = {x.mention: (x.method, x.id) for x in R.cascade(m, r).collect()}
    assert plain == {"m1": ("deterministic", "e1"), "m2": ("fuzzy", "e2"), "m3": ("new", None), "m4": ("new", None)}
    judge = lambda asked: asked.withColumns({"same": F.col("id") == "e3", "confidence": F.lit(0.8)})
    similar = spark.createDataFrame([("m3", "e3", 0.9)], "mention string, id string, score double")
    got = {x.mention: (x.method, x.id, x.score) for x in R.cascade(m, r, similar, judge).collect()}
    assert got["m3"] == ("embedding+llm", "e3", 0.9)


MENTIONS = "evidence_id string, local_id string, type string, name string, confidence double, props map<string,string>"


def test_resolve(spark):
    known = spark.createDataFrame([("K1", "Person", "Maria Garcia", ["M. Garcia"], {"dob": "1990-01-01"}, "national_id:AB1", 0.8, 1)], "entity_id string, type string, canonical_name string, aliases array<string>, attributes map<string,string>, key string, confidence double, evidence_count long")
    data = [
        ("e1", "1", "Person", "maria garcía lopez", 0.9, {"national_id": "ab-1", "city": "Ubar"}), ("e1", "2", "Person", "garcia maria", 0.95, {"dob": "1990-01-01"}), ("e1", "3", "Person", "Jonathan Smithson", 0.9, {}),
        ("e2", "1", "Person", "Jonathan Smithsen", 0.6, {}), ("e2", "2", "Person", "Jonathon Smithsen", 0.9, {}), ("e2", "3", "Person", "Jonathan Smith", 0.9, {}), ("e2", "4", "Email", "Bad", 0.9, {}), ("e2", "5", "Phone", "+1 (663) 555-6869", 0.3, {}),
    ]
    rel = spark.createDataFrame([("e2", "1", "5", "HAS_PHONE", 0.9), ("e2", "1", "2", "RELATED_TO", 0.9), ("e2", "3", "4", "HAS_EMAIL", 0.9), ("e2", "5", "1", "owns", 0.7)], "evidence_id string, source string, target string, type string, confidence double")
    m, r = E.normalized_extraction(spark.createDataFrame(data, MENTIONS), rel)
    assert m.count() == 7 and rows(r, "source", "target", "type", "label") == {("1", "5", "HAS_PHONE", None), ("1", "2", "RELATED_TO", None), ("5", "1", "RELATED_TO", "OWNS")}
    for order in (m, m.orderBy(F.desc("local_id"))):
        got = E.resolve(order, r, known)
        by = {(x.evidence_id, x.local_id): x for x in got.mentions.collect()}
        assert by["e1", "1"].entity_id == by["e1", "2"].entity_id == "K1" and by["e1", "1"].method == "deterministic" and by["e1", "2"].method.startswith("fuzzy:1.00")
        # Smithson <- Smithsen <- Jonathon: one chain, one entity
        assert by["e1", "3"].entity_id == by["e2", "1"].entity_id == by["e2", "2"].entity_id and by["e1", "3"].method == "new"
        assert by["e2", "3"].method == "new"
        assert rows(got.suggestions, "entity_id", "candidate_id") == {(by["e2", "3"].entity_id, by["e1", "3"].entity_id)}
        reg = {x.entity_id: x for x in got.registry.collect()}
        assert reg["K1"].canonical_name == "Maria Garcia" and reg["K1"].attributes == {"dob": "1990-01-01", "national_id": "AB1", "city": "Ubar"} and reg["K1"].confidence == 0.95
        assert set(reg["K1"].aliases) == {"Garcia Maria", "M. Garcia", "Maria García Lopez"} and len(reg) == 4
        assert rows(got.relations, "type") == {("HAS_PHONE",), ("RELATED_TO",)} and got.relations.count() == 2  # the loop goes


# ---- evidence


def test_normal_forms(spark):
    data = [
        ("e", "1", "Document", "x", 1.0, {"number": "p-123 4567", "document_type": " Passport ", "expiry_date": "3/4/2030"}), ("e", "2", "Address", "12  main ST", 1.0, {}), ("e", "3", "BankAccount", "acc", 1.0, {"iban": "ae07 0331"}), ("e", "4", "Country", "ARE", 1.0, {}),
        ("e", "5", "Person", "jOHN q. doe", 1.0, {"dob": "3 Apr 1990", "national_id": "ab-1"}), ("e", "6", "Country", "Atlantis", 1.0, {}), ("e", "7", "Email", "?", 1.0, {"address": "A@B.org"}), ("e", "8", "Company", " Acme   Ltd ", 1.0, {}),
    ]
    got = {r.local_id: r for r in E.normalized(spark.createDataFrame(data, MENTIONS), countries.countries(spark)).collect()}
    assert (got["1"].name, got["1"].props["document_type"], got["1"].props["expiry_date"], got["1"].key) == ("P1234567", "passport", "2030-04-03", "document:PASSPORT:P1234567")
    assert (got["2"].name, got["3"].name, got["3"].key, got["8"].name) == ("12 Main St", "AE070331", "account:AE070331", "Acme Ltd")
    assert (got["4"].name, got["4"].props["iso2"], got["4"].key) == ("United Arab Emirates", "AE", "country:AE") and got["6"].key is None
    assert (got["5"].name, got["5"].props["dob"], got["5"].key, got["7"].name) == ("John Q. Doe", "1990-04-03", "national_id:AB1", "a@b.org")


def test_countries(spark):
    df = spark.createDataFrame([(1, " germany"), (2, "DE"), (3, "Deu"), (4, "Emirates"), (5, "xx"), (6, None)], "i int, c string")
    got = {r.i: r.iso2 for r in countries.normalized_countries(df, "c", countries.countries(spark)).collect()}
    assert got == {1: "DE", 2: "DE", 3: "DE", 4: "AE", 5: None, 6: None}
    raw = {"name": " Ann  Lee ", "status": "", "confidence": "x", "nationality": " A  B"}
    p = one(spark, countries.person_record(F.create_map(*[F.lit(x) for kv in raw.items() for x in kv])))
    assert (p.label, p.status, p.confidence, p.nationality, p.passport_number) == ("Ann Lee", "active", 1.0, "A B", None)


def test_chunks_merged(spark):
    m = spark.createDataFrame([("e", 0, "1", "Person", "Ann"), ("e", 1, "1", "Person", "Bob"), ("e", 1, "2", "Person", "Ann")], "evidence_id string, chunk int, local_id string, type string, name string")
    r = spark.createDataFrame([("e", 1, "1", "2", "RELATED_TO")], "evidence_id string, chunk int, source string, target string, type string")
    a = spark.createDataFrame([("e", 0, " ", 0.2), ("e", 1, "Two people.", 0.9), ("e", 2, "More.", 0.1)], "evidence_id string, chunk int, summary string, overall_confidence double")
    kept, rel, said = E.merged_chunks(m, r, a)
    assert rows(kept, "local_id", "name") == {("0:1", "Ann"), ("1:1", "Bob")} and rows(rel, "source", "target") == {("1:1", "0:1")}
    assert rows(said, "summary", "overall_confidence") == {("Two people.", 0.9)}


def test_write_review_and_delete(spark):
    ent = spark.createDataFrame([("p", "Person", "Ann", ["A."], {"father_name": "Omar  Ali", "gender": "female"}, 0.9, 1), ("d", "Document", "P1", [], {"number": "P1", "document_type": "passport", "issuer": "Xland", "place_of_birth": "Ubar"}, 0.9, 1), ("q", "Phone", "+1555", [], {"number": "+1555"}, 0.6, 1)], "entity_id string, type string, canonical_name string, aliases array<string>, attributes map<string,string>, confidence double, evidence_count long")
    m = spark.createDataFrame([("e1", "p", 0.9), ("e1", "d", 0.9), ("e1", "q", 0.6)], "evidence_id string, entity_id string, confidence double")
    r = spark.createDataFrame([("e1", "p", "d", "HAS_DOCUMENT", 0.9), ("e1", "p", "q", "HAS_PHONE", 0.9)], "evidence_id string, src string, dst string, type string, confidence double")
    ev = spark.createDataFrame([("e1", "upload")], "evidence_id string, source string")
    w = E.write(ev, E.facts(m)[0], E.facts(r)[0], ent)
    v = {x.vid: x for x in w.vertices.collect()}
    assert set(v) == {"p", "d"} and v["d"].tag == "document" and v["d"].key == "P1" and v["p"].key is None and json.loads(v["p"].evidence_ids) == ["e1"]
    assert json.loads(v["p"].props) == {"aliases": ["A."], "father_name": "Omar  Ali", "gender": "female"}
    assert rows(w.edges, "src", "dst", "edge_type", "status") == {("p", "d", "HAS_DOCUMENT", "accepted"), ("p", "q", "HAS_PHONE", "accepted")}
    assert rows(w.holds, "src", "field_key", "document_id") == {("p", "father_name", ""), ("p", "number", "d"), ("p", "place_of_birth", "d")} - {("p", "number", "d")}
    assert rows(w.values, "label") == {("omar ali",), ("ubar",)} and rows(w.support, "src", "dst") == {("p", "e1"), ("d", "e1")} and rows(w.evidence, "vid", "source_type") == {("e1", "text")}
    again = E.write(ev, E.facts(m)[0], E.facts(r)[0], ent)
    assert rows(again.holds, *w.holds.columns) == rows(w.holds, *w.holds.columns)

    facts = spark.createDataFrame(
        [(1, "entity", "e1", "q", None, None, None, None, 0.6, "in_review"), (2, "merge_suggestion", "e1", "p", "p", "z", None, None, 0.8, "in_review"), (3, "relationship", "e1", None, "p", "z", "PAYS", "pays", 0.7, "in_review"), (4, "relationship", "e1", None, "z", "p", "PAYS", None, 0.7, "in_review")],
        "fact_id int, kind string, evidence_id string, entity_id string, src string, dst string, type string, label string, confidence double, status string",
    ).withColumn("attributes", F.expr("map('a', 'b')"))
    items = spark.createDataFrame([(10, 1, "open"), (20, 2, "open"), (30, 3, "open"), (40, 4, "open"), (50, 4, "rejected")], "item_id int, fact_id int, state string")
    known = ent.unionByName(spark.createDataFrame([("z", "Person", "Annie", ["An"], {}, 0.9, 1)], ent.schema))
    d = E.decided(items, facts, known, spark.createDataFrame([(10, True), (20, True), (30, True), (40, False), (50, True)], "item_id int, approve boolean"))
    assert rows(d.entities, "entity_id", "evidence_id") == {("q", "e1")} and rows(d.support, "src", "dst") == {("q", "e1")}
    assert rows(d.edges, "src", "dst", "edge_type", "relationship_type") == {("p", "z", "RELATED_TO", "same_as"), ("p", "z", "PAYS", "pays")}
    assert {x.entity_id: x.aliases for x in d.registry.collect()}["z"] == ["A.", "An", "Ann"]
    assert rows(d.facts, "fact_id", "status") == {(1, "written"), (2, "written"), (3, "written"), (4, "rejected")} and rows(d.items, "item_id", "state") == {(10, "approved"), (20, "approved"), (30, "approved"), (40, "rejected"), (50, "rejected")}
    assert rows(E.queue(items.withColumn("created_at", F.col("item_id")), limit=2, facts=facts), "item_id", "kind") == {(10, "entity"), (20, "merge_suggestion")}

    tables = {"evidence": ev, "facts": facts, "items": items.withColumn("evidence_id", F.lit("e1")), "support": spark.createDataFrame([("p", "e1"), ("p", "e2"), ("d", "e1")], "entity_id string, evidence_id string"), "registry": ent, "vertices": w.vertices.select("vid", "tag"), "edges": w.edges}
    left = E.delete_cascade(tables, ev)
    assert left["evidence"].isEmpty() and left["facts"].isEmpty() and left["items"].isEmpty()
    assert rows(left["registry"], "entity_id") == {("p",), ("q",)} and rows(left["vertices"], "vid") == {("p",)} and rows(left["edges"], "dst") == {("q",)}


def test_enrichment(spark):
    edges = spark.createDataFrame([("a", "x", "HAS_PHONE"), ("b", "x", "HAS_PHONE"), ("c", "y", "HAS_EMAIL"), ("a", "z", "WORKS_AT"), ("b", "z", "WORKS_AT")], "src string, dst string, edge_type string")
    ent = spark.createDataFrame([("x", "Phone"), ("y", "Email"), ("z", "Company")], "entity_id string, type string")
    inferred = spark.createDataFrame([("a", "c", "RELATED_TO", "may know", 0.9), ("a", "q", "PAYS", "", 0.9), ("a", "b", "LIKES", "", 0.9)], "src string, dst string, type string, label string, confidence double")
    got = E.enriched(edges, ent, inferred=inferred)
    assert rows(got, "src", "dst", "label", "status") == {("a", "b", "shares_phone", "in_review"), ("a", "c", "may know", "proposed")}
    assert rows(E.enriched(edges, ent, earlier=got.where("dst = 'b'").select("src", "dst", "type"), inferred=inferred), "dst") == {("c",)}


def test_control(spark):
    ev = spark.createDataFrame([("a", "uploaded", None, None, 1), ("b", "failed", "parse: x", None, 2), ("c", "extracting", None, True, 3), ("d", "enriched", None, None, 4)], "evidence_id string, status string, error string, cancel_requested boolean, uploaded_at int")
    ids = spark.createDataFrame([("a",), ("b",), ("d",)], "evidence_id string")
    assert rows(E.cancelled(ev, ids), "evidence_id", "cancel_requested") == {("a", True), ("b", False), ("c", True), ("d", False)}
    on, off = E.stopped(ev, "write")
    assert rows(off, "evidence_id", "status", "error") == {("c", "cancelled", "write: stopped by user")} and on.count() == 3
    assert rows(E.retried(ev, ids), "evidence_id", "status", "error") == {("a", "uploaded", None), ("b", "uploaded", None), ("c", "extracting", None), ("d", "enriched", None)}
    assert rows(E.swept(ev), "evidence_id", "status") == {("a", "uploaded"), ("b", "failed"), ("c", "failed"), ("d", "enriched")}
    log = spark.createDataFrame([("d", "parse", 1, "x"), ("d", "write", 2, "y")], "evidence_id string, stage string, at int, detail string")
    assert rows(E.evidence_list(ev, None, 2, log), "evidence_id", "stage") == {("d", "write"), ("c", None)} and rows(E.evidence_list(ev, "failed"), "evidence_id") == {("b",)}
    ent = spark.createDataFrame([("1", "Person", "Ann Lee", 1), ("2", "Person", "Bob", 2), ("3", "Email", "ann@x", 3)], "entity_id string, type string, canonical_name string, updated_at int")
    assert [r.entity_id for r in E.entity_list(ent, None, " ANN ").collect()] == ["3", "1"] and rows(E.entity_list(ent, "Person", limit=1), "entity_id") == {("2",)}


# ---- the demo population, end to end


def test_demo_population(spark):
    v, e = demo.graph(spark)
    s = N.sources(v, e)
    links = lambda root, degree=1, least=0.0: {frozenset((r.p1, r.p2)): r for r in N.person_network(s, root, degree, least).links().collect()}
    people = lambda root, degree=3, least=0.0: dict(rows(N.person_network(s, root, degree, least).persons, "vid", "degree"))
    anna = links("anna")
    assert anna[frozenset(("anna", "bela"))].confidence == 0.91
    assert anna[frozenset(("anna", "bo"))].confidence == 0.14  # six born in one town
    chain = people("anna", 3, 0.3)
    assert chain == {"anna": 0, "bela": 1, "cora": 2, "dora": 3}
    assert links("cora")[frozenset(("cora", "bela"))].confidence == 0.7 and links("dora")[frozenset(("cora", "dora"))].confidence == 0.5
    cross = links("emil")[frozenset(("emil", "frida"))]
    assert cross.confidence == 0.42 and cross.label == "matching address"
    twins = links("gustav")[frozenset(("gustav", "gustaf"))]
    assert twins.confidence == 0.9999 and twins.label == "5 connections"
    assert people("hugo") == {"hugo": 0} and not links("hugo", 3)
    found = N.find_connection(s, "anna", "dora")
    assert found["path"] == ["anna", "bela", "cora", "dora"] and found["confidence"] == pytest.approx(0.91 * 0.7 * 0.5)
    got = {(r.person, r.connector): r.shared_with for r in N.attributes(s).collect()}
    assert got["gustav", "d-gust"] == ["gustaf"] and got["hugo", "d-hugo"] == []

    w = demo.seed(spark)
    bags = w.vertices.select("vid", "tag", records.properties(F.col("props")).alias("props"))
    _, again = graph_store.reindexed(bags.withColumn("props", F.map_filter("props", lambda k, _: k != "aliases")), w.edges)
    assert rows(again, "src", "dst", "field_key", "document_id") == rows(w.holds, "src", "dst", "field_key", "document_id")

    reasons = N.person_network(s, "emil").reasons
    readable = bags.select("vid", F.explode("props").alias("field_key", "raw"))
    said = views.described(reasons, readable).first()
    assert said.heading == "Matching value across different fields" and said.detail == "Address and Residence Address both give “9 Mill Lane, Westport”."
    assert views.described(reasons).first().detail.endswith("both give “9milllane,westport”.")
    assert rows(views.through_connector(reasons, "d-emil"), "p1", "p2") == {("emil", "frida")}


def test_descriptions(spark):
    v = spark.createDataFrame([("a", "person", "A"), ("b", "person", "B"), ("ph", "phone", "+1"), ("m", "company", "M"), ("n", "company", "N")], "vid string, tag string, label string")
    e = spark.createDataFrame([("a", "ph", "HAS_PHONE"), ("b", "ph", "HAS_PHONE"), ("a", "b", "PAYS"), ("a", "m", "WORKS_AT"), ("b", "n", "WORKS_AT"), ("m", "n", "OWNS")], "src string, dst string, edge_type string")
    net = N.person_network(N.sources(v, e), "a")
    got = {(r.kind, r.heading, r.detail) for r in views.described(net.reasons).collect()}
    assert got == {("shared_attribute", "Shared phone", "Both people hold +1."), ("direct", "Direct relationship", "pays"), ("linked_organisation", "Linked organisations", "M owns N")}
    vertices, edges = views.path_elements(spark.createDataFrame([("a", "A", 0), ("b", "B", 1)], "vid string, label string, degree int"), net.links())
    styled = views.edge_style(edges).first()
    assert vertices.count() == 2 and styled.weight == 3.0 and styled.label == "3 connections" and styled.id == "a->b@3 connections@0" and 0.9 < styled.shown_confidence < 1


def test_attribute_views(spark):
    a = spark.createDataFrame([("d", {"issue_date": "x", "number": "P1", "document_type": "emirates_id", "zeta": "Q", "father_name": "Omar Ali", "props": "{}"}, ["h"])], "id string, props map<string,string>, holders array<string>")
    matches = spark.createDataFrame([("omar ali", "p2"), ("omar ali", "h"), ("q", "h")], "value string, person string")
    got = [(r.field_key, r.label, r.kind, r.matched_with) for r in views.attribute_fields(a, matches).orderBy("place").collect()]
    assert got == [("document_type", "Document Type", "identity", []), ("number", "Number", "identity", []), ("issue_date", "Issue Date", "identity", []), ("father_name", "Father Name", "claim", ["p2"]), ("zeta", "Zeta", "claim", [])]
    assert one(spark, views.attribute_label(F.lit("document"), F.lit("P1"), F.lit("emirates_id"))) == "Emirates ID" and one(spark, views.attribute_label(F.lit("document"), F.lit("P1"), F.lit(None).cast("string"))) == "Document"
    things = spark.createDataFrame([("1", "phone"), ("2", "phone"), ("3", "document"), ("4", "car")], "id string, tag string")
    assert [r.tag for r in views.grouped(things).orderBy("place").collect()] == ["document", "car", "phone"] and [r.tag for r in views.grouped(things, False).orderBy("place").collect()] == ["phone", "car", "document"]
    links = spark.createDataFrame([("a", "b", 0.5), ("c", "a", 0.9), ("b", "c", 0.1)], "p1 string, p2 string, confidence double")
    assert [r.other for r in views.links_of(links, "a").collect()] == ["c", "b"] and views.weakest_hop(links).first().confidence == 0.1
    palette = ["red", "blue", "green"]
    assert [one(spark, views.degree_color(F.lit(d), palette)) for d in (0, 1, 9)] == [None, "red", "green"]
    h = 0
    for c in "phone":
        h = (h * 31 + ord(c)) % 2**32
    assert one(spark, views.tag_color(F.lit("phone"), palette)) == palette[h % 3]
    assert one(spark, views.role(F.array(F.lit("a")), ["b"])) == "sub" and one(spark, views.role(F.array(F.lit("a")), [])) == "main"
    parents = spark.createDataFrame([("p", 0.0, 0.0), ("q", 100.0, 0.0)], "vid string, x double, y double")
    children = spark.createDataFrame([("c1", "p", "a"), ("c2", "p", "b"), ("s", "p", "c"), ("s", "q", "c"), ("lost", "z", "d")], "id string, parent string, sort_key string")
    at = {r.id: (r.x, r.y) for r in views.ring_positions(parents, children).collect()}
    assert set(at) == {"c1", "c2", "s"} and at["s"] == (50.0, 0.0) and at["c1"][0] == pytest.approx(-at["c2"][0]) and (at["c1"][0] ** 2 + at["c1"][1] ** 2) ** 0.5 == pytest.approx(150)


# ---- risk


def test_risk_of_a_graph(spark):
    none = {}
    v = [("a", "person", "A", {"pep_status": "spouse of a minister"}), ("b", "person", "B", none), ("c", "person", "C", none), ("o", "company", "O", none), ("x", "sanction_entry", "X", none), ("k", "country", "K", {"risk_classification": risk.HIGH_RISK})]
    e = [("a", "o", "WORKS_AT", 0), ("b", "o", "WORKS_AT", 0), ("x", "b", "LISTS", 0), ("a", "k", "CITIZEN_OF", 0), ("a", "c", "TRANSFERRED_TO", 0), ("c", "a", "TRANSFERRED_TO", 1)]
    g = PropertyGraph(spark.createDataFrame(v, "vid string, tag string, label string, props map<string,string>"), spark.createDataFrame(e, "src string, dst string, edge_type string, rank long"))
    s = N.sources(g.vertices, g.edges)
    box = toolbox.Toolbox(g, s)
    r = box.calculate_risk("a").data["risk"].first()
    assert [f.code for f in r.factors] == ["indirect_sanction_exposure", "shared_bank_account", "pep_exposure", "high_risk_country"] and r.level == "high" and r.score == 1.0
    assert r.factors[0].evidence_ids == ["b"] and r.factors[0].value == pytest.approx(0.8) and r.factors[3].evidence_ids == ["k"] and r.distance == 1
    b = box.calculate_risk("b").data["risk"].first()
    assert [f.code for f in b.factors] == ["direct_sanction_match"] and b.factors[0].evidence_ids == ["x"] and b.summary == "Entity directly matches a sanctions record"
    assert toolbox.Toolbox(g).calculate_risk("o").data["risk"].first().summary == risk.NOTHING_FOUND
    net = N.person_network(s, "c", 3)
    assert rows(risk.exposure(net, g.listed(), "c"), "distance", "path") if False else risk.exposure(net, g.listed(), "c").first().distance == 2
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], "p1 string, p2 string")
    far = {x.vid: (x.distance, x.path) for x in risk.exposures(links, spark.createDataFrame([("a",)], "vid string")).collect()}
    assert far == {"b": (1, ["a"]), "c": (2, ["a"]), "d": (3, ["a"])}
    assert box.search_person("A").message == "found 1 people" and box.expand_node("a").data["edges"].count() == 4
    assert box.shortest_path("x", "b").data["paths"].count() == 1 and box.merge_entities("a", "c").data["edges"].count() == 4


# ---- stores and sources


def test_schemas(spark):
    name = "glt_schemas"
    catalog.drop_graph(spark, name)
    try:
        catalog.ensure_ingest_schema(spark, name)
        catalog.ensure_ingest_schema(spark, name)
        assert set(catalog.list_tags(spark, name)) == set(schemas.INGEST_TAGS) and set(catalog.list_edge_types(spark, name)) == set(schemas.INGEST_EDGES)
        assert [f.name for f in catalog.describe_tag(spark, name, "phone")][-1] == "number" and "field_key" in catalog.describe_edge_type(spark, name, "HAS_FIELD_VALUE").names
        with pytest.raises(catalog.SchemaError):
            catalog.create_tag(spark, name, "phone", "brand string")
        with pytest.raises(catalog.SchemaError):
            catalog.describe_tag(spark, name, "nothing")
        catalog.ensure_tag(spark, name, "calls", {"id": "int", "cost": "float", "label": "string"})
        assert catalog.describe_tag(spark, name, "calls").simpleString() == "struct<vid:string,label:string,id:bigint,cost:double>"
        catalog.create_index(spark, name, "tag", "person", ["label"])
        assert catalog.list_indexes(spark, name) == ["tag_person.label"]
        v = spark.createDataFrame([("a", "person", "Ann", {"x": "1"})], "vid string, tag string, label string, props map<string,string>")
        e = spark.createDataFrame([("a", "b", "PAYS", 0, {})], "src string, dst string, edge_type string, rank long, props map<string,string>")
        catalog.save(spark, name, v, e)
        assert catalog.execute(spark, name, "SELECT label FROM vertices WHERE vid = :who", who="a").first().label == "Ann" and catalog.describe(spark, name) == {"tags": ["person"], "edge_types": ["PAYS"]}
    finally:
        catalog.drop_graph(spark, name)
    assert len(schemas.TYPED_TAGS) == 15 and len(schemas.TYPED_EDGES) == 11
    for columns in [*schemas.TYPED_TAGS.values(), *schemas.OPERATIONAL_TAGS.values()]:
        assert schemas.tag_schema(columns)["vid"].nullable is False
    job = schemas.struct(schemas.OPERATIONAL_TAGS["background_job"])
    assert job["max_attempts"].metadata["default"] == "3" and not job["max_attempts"].nullable and job["error"].nullable
    bad = spark.createDataFrame([("a", "", "PAYS", {}), ("a", "b", "RELATED_TO", {"confidence": "2"}), ("a", "b", "PAYS", {"confidence": "2"})], "src string, dst string, edge_type string, props map<string,string>")
    assert rows(catalog.edge_errors(bad), "error") == {("dst is required",), ("confidence must be in 0..1",)}


def test_stored_rows(spark):
    key = graph_store.EDGE_KEY
    old = spark.createDataFrame([("a", "b", "R", 0, "x", 1)], "src string, dst string, edge_type string, rank long, note string, n int")
    new = spark.createDataFrame([("a", "b", "R", 0, None, 2), ("a", "c", "R", 0, "y", 3)], old.schema)
    assert rows(entity_store.upsert_edges(old, new), "dst", "note", "n") == {("b", "x", 2), ("c", "y", 3)}
    assert rows(graph_store.insert(old, new, key), "dst", "note", "n") == {("b", None, 2), ("c", "y", 3)}
    tied = spark.createDataFrame([("a", "b", "R", 0, "p", 1), ("a", "b", "R", 0, "q", 0)], old.schema)
    assert rows(graph_store.insert(old, tied, key), "note") == {("q",)}  # the same whatever their order
    v = spark.createDataFrame([("v1", "person", "Ann", {"a": "1", "b": "2"})], "vid string, tag string, label string, props map<string,string>")
    rec = spark.createDataFrame([("r1", "person", "Ann L", {"b": "3"}), ("r2", "person", "New", {"c": "4"}), ("r3", "person", "Wait", {})], "record string, tag string, label string, props map<string,string>")
    how = spark.createDataFrame([("r1", "merge", "v1"), ("r2", "create", None), ("r3", "review", None)], "record string, action string, id string")
    assert {r.vid: (r.label, r.props) for r in entity_store.store_resolved(v, rec, how).collect()} == {"v1": ("Ann", {"a": "1", "b": "3"}), "r2": ("New", {"c": "4"})}


def test_point_lookups(spark):
    g = PropertyGraph(
        spark.createDataFrame([("a", "person", "Ann", {"national_id": "1", "x": "p"}), ("a", "employee", None, {"x": "e"}), ("b", "person", None, {"national_id": "2"})], "vid string, tag string, label string, props map<string,string>"),
        spark.createDataFrame([("a", "b", "PAYS", 0), ("a", "b", "PAYS", 1), ("b", "z", "OWNS", 0)], "src string, dst string, edge_type string, rank long"),
    )
    assert g.exists("a") and g.exists("a", "person") and not g.exists("a", "phone") and not g.exists("q") and g.vertex("a").count() == 2
    with pytest.raises(catalog.SchemaError):
        g.vertex("a", "ghost", ["person"])
    assert g.edge("PAYS", "a", "b", 1).count() == 1 and g.edge_exists("PAYS", "a", "b") and not g.edge_exists("PAYS", "b", "a")
    assert g.existing_edges(g.edges.unionByName(spark.createDataFrame([("q", "b", "PAYS", 0)], g.edges.schema))).count() == 3
    assert g.find_by("person", "national_id", "2") == "b" and g.find_by("person", "label", "Ann") == "a" and g.find_by("person", "label", "Zoe") is None
    assert rows(g.candidates("person", ("label", "national_id")), "vid", "national_id") == {("a", "1"), ("b", "2")} and rows(g.one_step(g.vertices, "PAYS"), "vid", "other") == {("a", "b")}
    assert {r.vid: (r.tags, r.label, r.props) for r in g.nodes().collect()} == {"a": (["employee", "person"], "Ann", {"national_id": "1", "x": "p"}), "b": (["person"], "b", {"national_id": "2"})}
    assert g.schema() == {"tags": ["employee", "person"], "edge_types": ["OWNS", "PAYS"]} and g.neighbors("a", limit=0).isEmpty()
    c = g.context("b")
    assert c["edge_types"] == {"PAYS": 2, "OWNS": 1} and rows(c["neighbours"], "vid") == {("a",)} and c["properties"] == {"national_id": "2"}


def test_walks_from_a_hub(spark):
    e = [("r", "h", "R", 0)] + [("h", f"x{i:02}", "R", 0) for i in range(30)] + [(f"x{i:02}", "h", "R", 0) for i in range(30)]
    g = PropertyGraph(spark.createDataFrame([("r", "t", None)], "vid string, tag string, label string"), spark.createDataFrame(e, "src string, dst string, edge_type string, rank long"))
    every = g.walks("r", 4, None).collect()
    assert len(every) == 1 + 30 + 30 + 900
    assert [(w.step, w.vid) for w in g.walks("r", 4, 40).collect()] == sorted((w.step, w.vid) for w in every)[:40]


def test_workspace(spark, tmp_path):
    reg = workspace.GraphRegistry(tmp_path / "graphs.json")
    first = reg.create("One")
    reg.ensure("main", "Main")
    reg.ensure("main", "Other")
    reg.add("main", 3, 4)
    assert {r.name for r in reg.all()} == {"One", "Main"} and reg.get("main").edges == 4 and reg.get("x") is None
    reg.delete(first.id)
    assert [r.id for r in workspace.GraphRegistry(tmp_path / "graphs.json").all()] == ["main"]

    c = workspace.new_cases(spark.createDataFrame([("T", "me", None), ("U", "me", "high")], "title string, created_by string, priority string"))
    assert rows(c, "title", "status", "priority") == {("T", "open", "medium"), ("U", "open", "high")}
    fixed = spark.createDataFrame([("case:1", "T", "open", 1), ("case:2", "U", "shut", 2)], "case_id string, title string, status string, created_at int")
    assert [r.case_id for r in workspace.case_list(fixed).collect()] == ["case:2", "case:1"] and workspace.case(fixed, "case:1").count() == 1 and workspace.case_list(fixed, "shut").count() == 1
    s = workspace.subjects(spark.createDataFrame([("case:1", "p", "target", "me"), ("case:1", "p", "witness", "me")], "case_id string, entity_id string, subject_role string, added_by string"))
    assert s.count() == 1
    v, e = workspace.notes(spark.createDataFrame([("case:1", "Hello", "me"), ("case:1", "Hello", "me"), ("case:2", "Hello", "me")], "case_id string, body string, author_id string"))
    assert v.count() == 2 and rows(e, "src") == {("case:1",), ("case:2",)}
    i = spark.createDataFrame([("merge", "pending"), ("merge", "done"), ("fact", "pending")], "queue_type string, status string")
    assert workspace.pending_reviews(i).count() == 2 and workspace.pending_reviews(i, "merge").count() == 1 and workspace.pending_reviews(i, "merge", True).count() == 2

    now = datetime.datetime(2024, 1, 1)
    late, soon = now - datetime.timedelta(hours=1), now + datetime.timedelta(hours=1)
    jobs = spark.createDataFrame(
        [("1", "sum", "running", "[1]", 1, 3, "w0", soon, 1), ("2", "sum", "running", "{\"a\": [1, 2]}", 1, 3, "w0", late, 2), ("3", "what", "pending", "{}", 0, 3, None, None, 3), ("4", "sum", "pending", "{\"a\": [3]}", 3, 3, "", None, 4), ("5", "sum", "pending", "{}", 0, 3, "", None, 5)],
        "job_id string, job_type string, status string, payload_json string, attempt int, max_attempts int, lease_owner string, lease_expires_at timestamp, created_at int",
    )
    done = {r.job_id: r for r in workspace.run_jobs(jobs, "w1", {"sum": lambda p: {"sum": sum(p["a"])}}, now, limit=3).collect()}
    assert (done["2"].status, done["2"].result_json, done["2"].attempt) == ("completed", '{"sum": 3}', 2)
    assert (done["3"].status, done["3"].error) == ("failed", "unknown job type: what") and done["5"].status == "failed" and done["5"].error == "'a'"
    assert done["1"].lease_owner == "w0" and done["1"].status == "running" and done["4"].status == "pending"


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.md").write_text("hello")
    (tmp_path / "t" / "b.rev").write_bytes(b"abc")
    (tmp_path / "t" / "c.pdf").write_bytes(b"%PDF")
    text_files.READERS["rev"] = lambda raw: raw.decode()[::-1]
    try:
        got = {r.source.rsplit("/", 1)[-1]: (r.kind, r.text, r.error) for r in text_files.read_files(spark, str(tmp_path / "t")).collect()}
    finally:
        text_files.READERS.clear()
    assert got["a.md"] == ("text", "hello", None) and got["b.rev"] == ("rev", "cba", None) and got["c.pdf"][:2] == (None, None) and "unsupported" in got["c.pdf"][2]
    with pytest.raises(ValueError):
        text_files.source_type("x.docx")
    (tmp_path / "p.csv").write_text("name,age,entity_type\nAnn,30,person\nBob,,person\nZed,1,Car \n")
    rows_ = csv_profile.read_rows(spark, str(tmp_path / "p.csv"))
    assert rows(rows_, "_row", "name") == {(1, "Ann"), (2, "Bob"), (3, "Zed")}
    said = text_files.table_text(rows_).first()
    assert said.text.split("\n")[:2] == ["[row 1] name=Ann; age=30; entity_type=person", "[row 2] name=Bob; entity_type=person"] and said.hint.startswith("CSV with columns: ['name', 'age', 'entity_type']. 3 rows")
    p = {r.column: (r.type, r.null_ratio, r.samples) for r in csv_profile.inspect_csv(spark, str(tmp_path / "p.csv")).collect()}
    assert p["age"] == ("int", 0.3333, ["1", "30"]) and list(p) == ["name", "age", "entity_type"]
    box = toolbox.Toolbox(PropertyGraph(spark.createDataFrame([("v1", "person", "Ann", {})], "vid string, tag string, label string, props map<string,string>"), spark.createDataFrame([], "src string, dst string, edge_type string, rank long")))
    assert {k: v for k, v in box.ingest_csv(str(tmp_path / "p.csv"), "s").data.items() if k != "decisions"} == {"created": 1, "merged": 1, "review": 0}


def test_import_lines_and_first_rows(spark, tmp_path):
    lines = [f"{i % 40},{'x' if i == 7 else i},n{i}" for i in range(400)]
    (tmp_path / "t.csv").write_text("id,age,name\n" + "\n".join(lines) + "\n")
    made = csv_import.run(csv_profile.read_rows(spark, str(tmp_path / "t.csv")).repartition(1), "t", csv_import.Structure("t", ("age", "name"), id="id"))
    assert {r.vid: r.label for r in made.vertices.collect()} == {str(i): f"n{i}" for i in range(40)}
    typed = csv_import.run(csv_profile.read_rows(spark, str(tmp_path / "t.csv")), "t", csv_import.Structure("t", ("age", "name"), id="id"))
    assert typed.report() == {"rows": 400, "errors": 0, "created": 40, "duplicates": 360}
    wrong = csv_import.typed(csv_profile.read_rows(spark, str(tmp_path / "t.csv")), [csv_import.Column("age", "int", 1.0)])
    assert rows(csv_import.Import(made.vertices, None, wrong, made.structure).errors(), "line", "column") == {(9, "age")}


@pytest.mark.parametrize("near", [False, True])
def test_nearest_blocks_and_ties(spark, near):
    rng = random.Random(3)
    value = (lambda i: rng.gauss(4 * (i % 2), 0.1)) if near else (lambda i: rng.choice([0.0, 1.0, 2.0]))  # two far clouds, or ties
    data = [(i, [value(i) if near and k == 0 else rng.gauss(0, 1) if near else value(i) for k in range(4)]) for i in range(90)] + [(900, [0.0] * 4), (901, None)]
    df = spark.createDataFrame(data, "id int, vector array<double>").repartition(4)
    q = df.where("id % 3 = 0")

    def cosine(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0

    want = set()
    for i, v in data:
        if i % 3 == 0 and v is not None:
            best = sorted((-round(cosine(v, u), 9), j) for j, u in data if j != i and u is not None)[:5]
            want |= {(i, j, k + 1) for k, (_, j) in enumerate(best)}
    got = {(r.query, r.id, round(r.score, 9)) for r in R.nearest(q, df, 5, block=7, slice_rows=40).collect()}
    assert len(got) == len(want) and {x[0] for x in got} == {x[0] for x in want}
    for i in {x[0] for x in want}:  # equal scores may be told apart by the last bit
        mine = sorted(-s for a, _, s in got if a == i)
        assert mine == pytest.approx(sorted(-round(cosine(dict(data)[i], dict(data)[j]), 9) for a, j, _ in want if a == i), abs=1e-8)
