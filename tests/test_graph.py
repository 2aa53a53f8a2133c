"""Graph operators on small graphs with known answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scoring, text
from graphloom.operators import projection as P
from graphloom.operators import resolution, risk
from graphloom.operators.graph import PropertyGraph
from graphloom.sources import csv_profile


@pytest.fixture(scope="module")
def graph(spark):
    v = spark.createDataFrame([("a", "person", "Alice"), ("b", "person", "Bob"), ("c", "person", "Cara"), ("p", "phone", None)], "vid string, tag string, label string")
    e = spark.createDataFrame([("a", "b", "FRIEND", 0), ("a", "c", "FRIEND", 0), ("b", "c", "COWORKER", 0), ("a", "x", "FRIEND", 0)], "src string, dst string, edge_type string, rank long")
    return PropertyGraph(v, e)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def vids(df):
    return sorted(r["vid"] for r in df.collect())


def test_neighbours_drop_dangling_and_degrees_count_them(graph):
    assert vids(graph.neighbors("a")) == ["b", "c"]
    assert vids(graph.neighbors("c", direction="in")) == ["a", "b"]
    assert graph.degrees().where("vid = 'a' AND direction = 'out'").first()["n"] == 3


def test_search_scan_and_overview(graph):
    assert vids(graph.search("ali")) == ["a"]
    assert vids(graph.search("P")) == ["p"]  # no label: the vid
    assert vids(graph.scan_vertices("person", 2)) == ["a", "b"]
    kept, edges = graph.overview(["person"], 2)
    assert vids(kept) == ["a", "b"] and edges.count() == 1


def test_paths(spark, graph):
    assert {(r.vid, r.depth) for r in graph.k_hop(spark.createDataFrame([("b",)], "vid string"), 1).collect()} == {("b", 0), ("a", 1), ("c", 1)}
    assert [r.path for r in graph.shortest_paths("a", "c").collect()] == [["a", "c"]]
    assert graph.shortest_paths("c", "a").count() == 0


def test_scoring(spark):
    assert [one(spark, scoring.rarity(F.lit(n))) for n in (0, 1, 2, 3, 11)] == [0, 0, 1, 0.5, 0.1]
    assert one(spark, scoring.match_confidence(F.lit(" Address"), F.lit(2), F.lit(False))) == pytest.approx(0.42)
    df = spark.createDataFrame([(0.7,), (0.7,)], "c double")
    assert df.agg(scoring.noisy_or(F.col("c")).alias("x")).first()["x"] == pytest.approx(0.91)
    assert df.limit(0).agg(scoring.noisy_or(F.col("c")).alias("x")).first()["x"] == 0


def test_normalisation(spark):
    norm = lambda s: one(spark, text.normalize_value(F.lit(s)))
    assert norm("  Ahmed   Al-Mansouri ") == "ahmed al-mansouri"
    assert norm("784-1990-1234567-1") == "784199012345671"
    assert norm("  ") is None
    assert one(spark, text.value_vid(F.lit("ahmed al-mansouri"))) == "value:deb790f2c91ec58c8ddc521b16baf859"
    assert not one(spark, text.is_eligible(F.lit("Gender"), F.lit("female")))
    assert not one(spark, text.is_eligible(F.lit("born"), F.lit("1990")))
    assert [one(spark, text.classify_pep(F.lit(s))) for s in ("N/A", "Yes — immediate family of a PEP", "under assessment")] == [None, "associate", "self"]
    assert one(spark, text.sanitize_identifier(F.lit("9 Lives!"), "t")) == "_9_lives"
    value, error = text.coerce(F.lit("4x"), "int")
    assert one(spark, value) is None and one(spark, error)
    key = text.deterministic_key(F.lit("Document"), {"number": F.lit("P-123 4567"), "document_type": F.lit("passport")})
    assert one(spark, key) == "document:PASSPORT:P1234567"


def test_links(spark):
    o = spark.createDataFrame([("phone:1", "phone", "a"), ("phone:1", "phone", "b"), ("h", "company", "a"), ("h", "company", "b"), ("h", "company", "c")], "connector string, tag string, person string")
    rows = {(r.p1, r.p2): r.confidence for r in P.links(P.shared_reasons(o)).collect()}
    assert rows == {("a", "b"): pytest.approx(0.84), ("a", "c"): 0.2, ("b", "c"): 0.2}
    assert {(r.p1, r.p2) for r in P.shared_reasons(o, max_fanout=2).collect()} == {("a", "b")}
    assert [(r.connector, r.person_count) for r in P.suppressed_hubs(o, 2).collect()] == [("h", 3)]


def test_cross_key_fields(spark):
    o = spark.createDataFrame([("12 main st", "a", "address"), ("12 main st", "b", "employer_address")], "connector string, person string, field_key string")
    r = P.field_reasons(o).first()
    assert not r.same_key and r.field_key == "address" and r.confidence == pytest.approx(0.42)


def test_degrees_and_strongest_path(spark):
    links = [("a", "b", 0.9), ("b", "c", 0.9), ("a", "c", 0.5), ("c", "d", 0.8)]
    df = spark.createDataFrame(links, "p1 string, p2 string, confidence double")
    assert {(r.vid, r.degree) for r in P.person_degrees(df, "a", 9).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert P.best_path(df, "a", "d").first().path == ["a", "b", "c", "d"] and P.best_path(df, "a", "z").isEmpty()


def test_risk_and_gate(spark):
    c = spark.createDataFrame([("p", False, None, 0, "self", False), ("q", False, 2, 0, None, False), ("r", True, 1, 5, "self", True)], "vid string, direct boolean, distance int, transfers long, pep string, high_risk boolean")
    assert {(r.vid, r.score, r.level) for r in risk.risk_scores(c).collect()} == {("p", 0.7, "medium"), ("q", 0.48, "medium"), ("r", 1.0, "high")}
    assert [one(spark, resolution.confidence_gate(F.lit(x))) for x in (0.9, 0.5, 0.4)] == ["accepted", "in_review", "rejected"]


def test_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("name;age;active\nx;1;true\ny;;no\nz;3;yes\n")
    got = {r.column: (r.type, r.null_ratio) for r in csv_profile.profile(csv_profile.read_csv(spark, str(tmp_path / "p.csv"))).collect()}
    assert got == {"name": ("string", 0.0), "age": ("int", 0.3333), "active": ("bool", 0.0)}
