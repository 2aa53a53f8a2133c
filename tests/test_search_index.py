"""The search index held against a scan."""

from __future__ import annotations

import random

import pytest

from graphloom.operators.graph import PropertyGraph
from graphloom.sinks import search_index


@pytest.fixture(scope="module")
def both(spark):
    r = random.Random(2)
    rows = [(f"v{i}", r.choice(["person", "company", "field_value"]), r.choice([None, " ", "".join(r.choice("abÉé 12") for _ in range(r.randrange(14)))])) for i in range(300)]
    rows += [("v1", "company", "Two Tags"), ("x" * 40, "person", "aaaaaaaa"), ("hot", "person", None)]
    v = spark.createDataFrame(rows, "vid string, tag string, label string")
    return PropertyGraph(v, spark.createDataFrame([], "src string, dst string, edge_type string, rank long")), search_index.store(v, "search_test", buckets=8)


@pytest.mark.parametrize("text", ["ab", "aba", " BaB ", "é1", "ÉÉ a", "v1", "v12", "", "aaaaa", "nowhere", "tags", "%", "xxxxxxx"])
def test_searches_equal_a_scan(both, text):
    graph, index = both
    for tags in (None, ["company", "field_value"]):
        want = sorted(map(tuple, graph.search(text, tags, None).select("vid", "tag", "label").collect()), key=repr)
        assert sorted(map(tuple, index.search(text, tags, None).collect()), key=repr) == want
    assert [r.vid for r in index.search(text, limit=3).collect()] == [r.vid for r in graph.search(text, limit=3).collect()]


def test_a_search_reads_its_buckets_alone(spark, both):
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan doesn't tell what it prunes
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(both[1].candidates(both[1].counts.first().gram)._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 8" in plan
    files = both[1].postings.inputFiles()
    assert len(files) <= 8 * search_index.SHARES
