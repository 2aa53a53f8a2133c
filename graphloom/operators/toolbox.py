"""The operators that a client or an agent calls by name, on one graph."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.countries import person_record
from graphloom.operators import network, risk
from graphloom.operators.graph import PropertyGraph
from graphloom.operators.resolution import resolve_records
from graphloom.sources import csv_profile, text_files


@dataclass(frozen=True)
class ToolResult:
    ok: bool
    data: dict[str, Any] = field(default_factory=dict)
    message: str = ""


def import_persons(records: DataFrame, existing: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(decisions, counts) for the persons among records(record_id, entity_type, raw map): other types are left out."""
    p = records.where("entity_type = 'person'").select(F.col("record_id").alias("record"), person_record(F.col("raw")).alias("p")).select("record", "p.*")
    decisions = resolve_records(p, existing)
    n = {r.action: r["count"] for r in decisions.groupBy("action").count().collect()}
    return decisions, {"created": n.get("create", 0), "merged": n.get("merge", 0), "review": n.get("review", 0)}


class Toolbox:
    """Tools over a graph; results are DataFrames in `data`, evaluated when they are read."""

    def __init__(self, graph: PropertyGraph, sources: network.Sources | None = None):
        self.graph, self.sources = graph, sources

    def search_person(self, text: str) -> ToolResult:
        found = self.graph.search(text, ["person"], limit=None)
        return ToolResult(True, {"results": found}, f"found {found.count()} people")

    def expand_node(self, vid: str, depth: int = 1) -> ToolResult:
        vertices, edges = self.graph.expand(vid, max(1, min(depth, 5)))
        return ToolResult(True, {"vertices": vertices, "edges": edges}, "graph expansion complete")

    def shortest_path(self, source: str, target: str, max_steps: int = 5) -> ToolResult:
        return ToolResult(True, {"paths": self.graph.shortest_paths(source, target, max(1, min(max_steps, 10)))}, "shortest path computed")

    def merge_entities(self, source: str, target: str) -> ToolResult:
        """A plan: nothing is changed (graph_store.remap carries one out)."""
        return ToolResult(True, {"source": source, "target": target, "edges": self.graph.neighbors_batch(self._one(source))}, "merge planned")

    def calculate_risk(self, vid: str) -> ToolResult:
        """With the person's network if sources were given, else from one hop alone."""
        exposed = None
        if self.sources is not None:
            net = network.person_network(self.sources, vid, risk.EXPOSURE_DEGREE)
            exposed = risk.exposure(net, self.graph.listed(), vid) if net else None
        scored = risk.risk_scores(risk.contexts(self.graph, self._one(vid), exposed))
        return ToolResult(True, {"risk": scored.withColumn("summary", risk.explanation(F.col("factors")))}, "risk calculated")

    def ingest_csv(self, path: str, source: str) -> ToolResult:
        spark = self.graph.vertices.sparkSession
        rows = csv_profile.numbered(csv_profile.read_csv(spark, path))
        p = self.graph.vertices.where("tag = 'person'")
        bag = {c: F.col("props")[c].alias(c) for c in ("passport_number", "national_id", "date_of_birth", "nationality")}
        decisions, counts = import_persons(text_files.records(rows, source), p.select(F.col("vid").alias("id"), "label", *bag.values()))
        return ToolResult(True, {"decisions": decisions, **counts}, "csv ingestion complete")

    def _one(self, vid: str) -> DataFrame:
        return self.graph.vertices.sparkSession.createDataFrame([(vid,)], "vid string")
