"""A small invented population in which each rule of the projection shows once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators.evidence import Written, facts, write

_COMMON = {"nationality": "Freedonia", "issuing_country": "Freedonia"}
_CROWD = ("Bo Arden", "Cy Blum", "Di Corr", "Ed Dunn", "Fay Egan")

#: (id, name, attributes). Anna - Bela - Cora - Dora is a chain; Emil and Frida agree across two keys;
#: Gustav and Gustaf are one man twice; the crowd shares Anna's town; Hugo is alone; all share a nationality, which links nobody.
PEOPLE = [
    ("anna", "Anna Berg", {"dob": "1980-02-01"}), ("bela", "Bela Berg", {"dob": "1983-04-09"}), ("cora", "Cora Lund", {"dob": "1979-12-24"}), ("dora", "Dora Holm", {"dob": "1990-06-30"}),
    ("emil", "Emil Strand", {"dob": "1975-08-17"}), ("frida", "Frida Dahl", {"dob": "1993-01-05"}), ("gustav", "Gustav Kron", {"dob": "1982-10-11"}), ("gustaf", "Gustaf Kron", {"dob": "1982-10-11"}), ("hugo", "Hugo Vik", {"dob": "1968-03-03"}),
    *[(name.split()[0].lower(), name, {"dob": f"19{70 + i}-05-1{i}"}) for i, name in enumerate(_CROWD)],
]
#: (id, holders, type, number, attributes)
DOCUMENTS = [
    ("d-anna", ("anna",), "passport", "F1000001", {"father_name": "Nils Berg", "mother_name": "Ida Ros", "place_of_birth": "Sylvania"}),
    ("d-bela", ("bela",), "passport", "F1000002", {"father_name": "Nils Berg", "mother_name": "Ida Ros", "address": "4 Canal Row"}),
    ("d-cora", ("cora",), "residence card", "R-55-10", {"address": "4 Canal Row", "emergency_contact": "Otto Lind 7781"}),
    ("d-dora", ("dora",), "passport", "F1000004", {"emergency_contact": "Otto Lind 7781"}),
    ("d-emil", ("emil",), "passport", "F1000005", {"address": "9 Mill Lane, Westport"}),
    ("d-frida", ("frida",), "residence card", "R-55-12", {"residence_address": "9 Mill Lane, Westport"}),
    ("d-gust", ("gustav", "gustaf"), "passport", "F1000007", {"father_name": "Arvid Kron", "place_of_birth": "Klopstokia"}),
    ("d-hugo", ("hugo",), "passport", "F1000008", {"place_of_birth": "Vulgaria"}),
    *[(f"d-{name.split()[0].lower()}", (name.split()[0].lower(),), "residence card", f"R-60-{i}", {"place_of_birth": "Sylvania"}) for i, name in enumerate(_CROWD)],
]


def population(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(evidence, mentions, relations, entities) of the population, as the evidence stages make them."""
    e = [(i, "Person", n, [], {**a, **_COMMON}, None, 1.0, 1) for i, n, a in PEOPLE]
    e += [(i, "Document", number, [], {**a, **_COMMON, "number": number, "document_type": kind}, None, 1.0, 1) for i, _, kind, number, a in DOCUMENTS]
    entities = spark.createDataFrame(e, "entity_id string, type string, canonical_name string, aliases array<string>, attributes map<string,string>, key string, confidence double, evidence_count long")
    mentions = spark.createDataFrame([("demo", x[0], 1.0) for x in e], "evidence_id string, entity_id string, confidence double")
    relations = spark.createDataFrame([("demo", h, d, "HAS_DOCUMENT", 1.0) for d, hs, *_ in DOCUMENTS for h in hs], "evidence_id string, src string, dst string, type string, confidence double")
    return spark.createDataFrame([("demo", "demo population")], "evidence_id string, source string"), mentions, relations, entities


def seed(spark: SparkSession) -> Written:
    """The population written: what a graph gets."""
    evidence, mentions, relations, entities = population(spark)
    return write(evidence, facts(mentions)[0], facts(relations)[0], entities)


def graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """vertices(vid, tag, label) and edges(src, dst, edge_type, rank, field_key, document_id) of the population."""
    w = seed(spark)
    vertices = w.vertices.select("vid", "tag", "label").unionByName(w.values.select("vid", "tag", "label"))
    edges = w.holds.select("src", "dst", "edge_type", "rank", "field_key", "document_id")
    return vertices, edges.unionByName(w.edges.select("src", "dst", "edge_type", "rank"), allowMissingColumns=True)
