"""Patterns, ranks, paths and as-of joins against plain loops."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pytest

from graphloom.operators import analytics
from graphloom.operators import graph as G
from graphloom.operators.asof import asof_join

EDGES = "src string, dst string"


def _random_edges(seed: int, n: int, m: int) -> list[tuple]:
    """A hub, random edges both ways, loops, repeated edges and null ends."""
    rng = random.Random(seed)
    edges = [(f"v{rng.randrange(n)}", f"v{rng.randrange(n)}") for _ in range(m)] + [("hub", f"v{i}") for i in range(0, n, 2)]
    return edges + edges[:5] + [("v1", "v1"), (None, "v2"), ("v3", None)]


def _neighbours(edges: list[tuple]) -> dict[str, set]:
    near = defaultdict(set)
    for a, b in edges:
        if a and b and a != b:
            near[a].add(b)
            near[b].add(a)
    return near


@pytest.mark.parametrize("seed", [1, 2])
def test_triangles_and_squares(spark, seed):
    rows = _random_edges(seed, 24, 70)
    edges, near = spark.createDataFrame(rows, EDGES), _neighbours(rows)
    want = {frozenset(t) for t in combinations(sorted(near), 3) if all(b in near[a] for a, b in combinations(t, 2))}
    got = [frozenset(r) for r in analytics.triangles(edges).collect()]
    assert len(got) == len(want) and set(got) == want

    counts = {r.vid: r for r in analytics.triangle_counts(edges).collect()}
    assert {v: r.degree for v, r in counts.items()} == {v: len(x) for v, x in near.items()}
    for v, r in counts.items():
        n = sum(v in t for t in want)
        assert r.n_triangles == n and (r.clustering is None if r.degree < 2 else abs(r.clustering - n / (r.degree * (r.degree - 1) / 2)) < 1e-12)

    cycles = {frozenset(map(frozenset, ((a, c), (b, d)))) for a, c in combinations(sorted(near), 2) for b, d in combinations(sorted(near[a] & near[c]), 2)}
    assert analytics.squares(edges).selectExpr("sum(n * (n - 1) div 2)").first()[0] == len(cycles)
    each = defaultdict(int)
    for cycle in cycles:
        for v in frozenset.union(*cycle):
            each[v] += 1
    assert {r.vid: r.n_squares for r in analytics.square_counts(edges).collect()} == dict(each)


def test_a_hub_is_no_centre(spark):
    """A star's pairs are its neighbours' square; none of them is looked at."""
    star = spark.createDataFrame([("hub", f"v{i}") for i in range(200)] + [("v0", "v1")], EDGES)
    assert analytics._wedges(star).count() <= 2
    assert analytics.triangles(star).collect()[0].z == "hub"
    assert analytics.squares(star).isEmpty()


@pytest.mark.parametrize("weighted", [False, True])
def test_pagerank(spark, weighted):
    rng = random.Random(7)
    rows = [(a, b, rng.choice([0.5, 1.0, 3.0])) for a, b in _random_edges(3, 30, 60)] + [("v1", "v4", 0.0), ("v1", "v5", None)]
    edges = spark.createDataFrame(rows, EDGES + ", weight double")
    vertices = spark.createDataFrame([("alone",), ("v1",), (None,), ("v1",)], "vid string")
    used = edges if weighted else edges.drop("weight")
    names = sorted({x for r in rows for x in r[:2] if x} | {"alone"})
    at, n = {v: i for i, v in enumerate(names)}, len(names)
    w = np.zeros((n, n))
    for a, b, x in rows:
        if a and b:
            w[at[a], at[b]] += (x or 0) if weighted else 1
    out, rank = w.sum(axis=1), np.full(n, 1 / n)
    share = np.divide(w, out[:, None], out=np.zeros_like(w), where=out[:, None] > 0)
    for _ in range(500):
        rank = 0.15 / n + 0.85 * (rank @ share + rank[out == 0].sum() / n)
    got = {r.vid: r["rank"] for r in analytics.pagerank(vertices, used, tolerance=1e-7, max_rounds=100).collect()}
    assert sorted(got) == names and abs(sum(got.values()) - 1) < 1e-9
    assert max(abs(got[v] - rank[at[v]]) for v in names) < 1e-6


def test_pagerank_of_nothing(spark):
    assert analytics.pagerank(spark.createDataFrame([], "vid string"), spark.createDataFrame([], EDGES)).count() == 0


@pytest.mark.parametrize("named", [500, 1])
def test_shortest_paths_from_both_ends(spark, monkeypatch, named):
    monkeypatch.setattr(G, "NAMED", named)
    rows = [(a, b) for a, b in _random_edges(11, 26, 45)]
    near = defaultdict(set)
    for a, b in rows:
        if a and b:
            near[a].add(b)
    graph = G.PropertyGraph(spark.createDataFrame([("v1",)], "vid string"), spark.createDataFrame([(a, b, "T") for a, b in rows], EDGES + ", edge_type string"))

    def plain(src: str, dst: str, most: int) -> list[list[str]]:
        paths = [[src]]
        for _ in range(most + 1):
            if hits := [p for p in paths if p[-1] == dst]:
                return sorted(hits)
            paths = [[*p, b] for p in paths for b in near[p[-1]] if b not in p]
        return []

    for src, dst, most in [("hub", "v5", 5), ("v0", "v9", 5), ("v2", "v2", 3), ("v7", "v12", 2), ("v4", "nowhere", 5)]:
        assert sorted(r.path for r in graph.shortest_paths(src, dst, most).collect()) == plain(src, dst, most)


def _asof(left: list[tuple], right: list[tuple], equal: bool, back: timedelta | None) -> list[tuple]:
    out = []
    for key, time, i in left:
        fits = [(t, v) for k, t, v in right if None not in (key, time, k, t) and k == key and (t < time or equal and t == time) and (back is None or t >= time - back)]
        out.append((i, *(max(fits) if fits else (None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize(("equal", "back"), [(True, None), (False, None), (True, 3)])
def test_asof_join(spark, equal, back):
    """A hot key, a hot time, ties, repeated rows, nulls; parts as small as they come."""
    rng, t0 = random.Random(5), datetime(2024, 1, 1)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", "c", None])
    time = lambda: rng.choice([t0 + timedelta(hours=rng.randrange(200))] * 4 + [t0 + timedelta(hours=100)] * 2 + [None])
    left = [(key(), time(), i // 2) for i in range(300)]
    right = [(key(), time(), rng.randrange(9)) for i in range(200)]
    a, b = spark.createDataFrame(left, "k string, at timestamp, i int"), spark.createDataFrame(right, "k string, since timestamp, v int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = asof_join(a, b, ["k"], "at", "since", ["since", "v"], allow_equal=equal, tolerance=f"{back} hours" if back else None)
        assert got.columns == ["k", "at", "i", "since", "v"]
        assert sorted(((r.i, r.since, r.v) for r in got.collect()), key=str) == _asof(left, right, equal, timedelta(hours=back) if back else None)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_asof_join_of_empty_tables(spark):
    a, b = spark.createDataFrame([("k", datetime(2024, 1, 1))], "k string, at timestamp"), spark.createDataFrame([], "k string, since timestamp, v int")
    assert [tuple(r) for r in asof_join(a, b, ["k"], "at", "since", ["v"]).collect()] == [("k", datetime(2024, 1, 1), None)]
    assert asof_join(a.limit(0), b, ["k"], "at", "since", ["v"]).count() == 0
    with pytest.raises(ValueError, match="both sides"):
        asof_join(a, b.withColumnRenamed("v", "at"), ["k"], "at", "since", ["at"])
