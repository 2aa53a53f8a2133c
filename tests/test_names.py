"""The name index held against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from graphloom.functions import likeness
from graphloom.functions.records import token_sort_similarity
from graphloom.operators import resolution

SYLLABLES = "an be co da el fi go ha is jo ka lu mo ni or pe ra sa ti vo".split()


def names(seed: int):
    r = random.Random(seed)

    def name() -> str:
        return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 3)))

    def near(n: str) -> str:
        made = list(n)
        for _ in range(r.randint(0, 4)):
            i = r.randrange(len(made) + 1)
            if r.random() < 0.5 and made:
                made.pop(min(i, len(made) - 1))
            else:
                made.insert(i, r.choice("abcdeoé "))
        return "".join(made)

    left = [name() for _ in range(200)]
    right = [near(r.choice(left)) for _ in range(200)] + [name() for _ in range(50)] + ["", "a", "aaaa aaaa", "aaa aaaaa"]
    return [(r.choice("pq"), x) for x in left + ["a", "aaaaaaaa"]], [(r.choice("pq"), y) for y in right]


@pytest.mark.parametrize("least", [0.6, 0.75, 0.93])
def test_indexed_pairs_are_all_pairs(spark, least):
    left, right = names(1)
    fold = lambda rows: {(b, " ".join(sorted(n.lower().split()))) for b, n in rows if n.split()}
    x, y = fold(left), fold(right)
    every = [(b, p, q, token_sort_similarity(p, q)) for b, p in x for c, q in y if b == c]
    got = resolution.name_scores(spark.createDataFrame(left, "block string, x string"), spark.createDataFrame(right, "block string, y string"), least)
    assert {(r.block, r.x, r.y) for r in got.collect()} == {(b, p, q) for b, p, q, s in every if s >= least}
    met = resolution.name_candidates(spark.createDataFrame(sorted(x), "block string, x string"), spark.createDataFrame(sorted(y), "block string, y string"), least).count()
    assert met < len(every) * {0.6: 0.2, 0.75: 0.03, 0.93: 0.01}[least]


def test_a_cascade_looks_for_near_names_alone(spark):
    """With and without a judge: what it answers doesn't hang on how far names are looked for."""
    m = spark.createDataFrame([("m1", "P", "Maria Garcia"), ("m2", "P", "Garcia Mariah"), ("m3", "P", "Someone Else"), ("m4", "P", "Marla Garzia")], "mention string, type string, name string")
    r = spark.createDataFrame([("e1", "P", "Maria Garcia"), ("e2", "P", "Maria Garzia"), ("e3", "P", "Otto Unlike")], "id string, type string, name string")
    plain = {(x.mention, x.method, x.id) for x in resolution.cascade(m, r).collect()}
    assert plain == {("m1", "fuzzy", "e1"), ("m2", "fuzzy", "e1"), ("m3", "new", None), ("m4", "new", None)}
    judged = resolution.cascade(m, r, adjudicate=lambda asked: asked.select("mention", "id", resolution.F.lit(True).alias("same"), resolution.F.lit(0.8).alias("confidence")))
    assert {(x.mention, x.method, x.id) for x in judged.collect()} == {("m1", "fuzzy", "e1"), ("m2", "fuzzy", "e1"), ("m3", "new", None), ("m4", "embedding+llm", "e2")}


@pytest.mark.parametrize("least", [0.43, 0.6, 0.9])
def test_names_as_arrays_are_alike_as_one_by_one(least):
    r = random.Random(4)
    made = lambda: " ".join("".join(r.choice("abcdeé語 ") for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 9)))
    xs = [made() for _ in range(600)] + ["a" * 64, "b" * 65, "ab" * 40, "", " "]
    ys = [made() for _ in range(60)] + ["a" * 64, "a" * 63, "b" * 65, "ab" * 39, ""]
    want = {(i, j): s for i, x in enumerate(xs) for j, y in enumerate(ys) if (s := token_sort_similarity(x, y)) >= least}
    got = {(int(i), int(j)): float(s) for part in likeness.alike(xs, ys, np.full(len(xs), least)) for i, j, s in zip(*part, strict=True) if s >= least}
    assert got == want


def test_records_are_looked_for_no_further_than_they_can_match(spark, monkeypatch):
    """Without birth dates and nationalities no premium lowers what a name needs; a passport needs no names."""
    seen, candidates = [], resolution.fuzzy_candidates
    monkeypatch.setattr(resolution, "fuzzy_candidates", lambda m, r, *more: seen.append((m.columns, m.count())) or candidates(m, r, *more))
    e = spark.createDataFrame([("e1", "Ann Lee", "P1"), ("e2", "Carla Montez Diaz", None)], "id string, label string, passport_number string")
    r = spark.createDataFrame([("a", "Whoever", "P1"), ("b", "Diaz Carla Montez", None), ("c", "Carla Montez", None)], "record string, label string, passport_number string")
    got = {x.record: (x.action, x.id) for x in resolution.resolve_records(r, e).collect()}
    assert got == {"a": ("merge", "e1"), "b": ("merge", "e2"), "c": ("review", None)} and seen == [(["mention", "type", "name"], 2)]


@pytest.mark.parametrize("block_rows", [5_000, 9])
def test_best_candidates_are_the_best_of_all(spark, block_rows):
    """Equal names, equal scores, aliases, premiums and parts: against every pair, one by one."""
    r = random.Random(7)
    pick = lambda: r.choice(["", "1970", "1980", None])
    name = lambda: " ".join("".join(r.choice("abc") for _ in range(r.randint(2, 5))) for _ in range(r.randint(1, 2)))
    m = [(f"m{k}", r.choice(["p", "q", None]), r.choice([name(), "abc ab", ""]), pick(), pick()) for k in range(60)]
    e = [(f"e{k}", r.choice(["p", "q", None]), r.choice([name(), "ab  ABC"]), [name(), "ab abc", None][: r.randint(0, 3)], pick(), pick()) for k in range(70)]
    want = set()
    for mention, kind, n, b, c in m:
        scores = {}
        for i, other, first, more, b2, c2 in e:
            for y in [first, *more]:
                if kind and kind == other and n and y:
                    s = token_sort_similarity(n.lower(), y.lower()) + (0.07 if b and b == b2 else 0.0) + (0.03 if c and c == c2 else 0.0)
                    scores[i] = max(scores.get(i, 0), round(min(1.0, s), 4))
        best = sorted((-s, i) for i, s in scores.items() if s >= 0.5)[:3]
        want |= {(mention, i, -s, k + 1) for k, (s, i) in enumerate(best)}
    asked = spark.createDataFrame(m, "mention string, type string, name string, birth string, nationality string")
    known = spark.createDataFrame(e, "id string, type string, name string, aliases array<string>, birth string, nationality string")
    got = {(x.mention, x.id, x.score, x.rank) for x in resolution.fuzzy_candidates(asked, known, 0.5, 3, block_rows=block_rows).collect()}
    assert got == want and len(want) > 60


def test_pairs_of_one_name_are_no_rows(spark, monkeypatch):
    """300 mentions and 300 entities of one name: each part gets one asked name and the first entities alone."""
    met, real = [], resolution._in_parts
    monkeypatch.setattr(resolution, "_in_parts", lambda x, y, *more: met.append((x.count(), y.count())) or real(x, y, *more))
    m = spark.range(300).selectExpr("id AS mention", "'P' AS type", "'Ann Lee' AS name")
    got = resolution.fuzzy_candidates(m, m.selectExpr("mention AS id", "type", "'Lee Ann' AS name"), 0.5, 5)
    assert {(x.id, x.n) for x in got.groupBy("id").agg(resolution.F.count("*").alias("n")).collect()} == {(k, 300) for k in range(5)}
    assert met == [(1, 5)]


@pytest.mark.parametrize("least", [0.86, 0.9, 0.97])
def test_index_and_arrays_tell_the_same(spark, monkeypatch, least):
    """Names with letters that go and come, blanks of all kinds: by their pieces, and each with each."""
    r = random.Random(9)
    left = ["".join(r.choice("0123456789abcdef ") for _ in range(r.randint(1, 45))) for _ in range(150)] + ["ann\xa0lee", "a"]
    right = ["lee ann", "Ann  Lee", "a"]
    for n in left * 3:
        made = list(n)
        for _ in range(r.randint(0, 6)):
            made[(k := r.randrange(len(made) + 1)) : k + r.randint(0, 1)] = r.choice(["", "x", "7"])
        right.append("".join(made))
    x, y = (spark.createDataFrame([("p", n) for n in names], f"block string, {c} string") for c, names in (("x", left), ("y", right)))
    told = []
    for cost in (0, 1e9):
        monkeypatch.setattr(resolution, "ROW_COST", cost)
        told.append({(t.x, t.y): t.score for t in resolution.name_scores(x, y, least).collect()})
    fold = lambda names: {" ".join(sorted(n.lower().split())) for n in names} - {""}
    want = {(p, q): s for p in fold(left) for q in fold(right) if (s := token_sort_similarity(p, q)) >= least}
    assert told == [want, want] and len(want) > 100


def test_pieces_bring_few_names_together(spark):
    """Hexadecimal digits, any two of which are in most names: the index's work, before anything is counted, is a sliver of all pairs."""
    names = spark.range(2_000).selectExpr("'p' AS block", "md5(string(id)) AS x")
    a, b = resolution._pieces(names, names.withColumnRenamed("x", "y").selectExpr("block", "reverse(y) AS y"), 0.93)
    assert a.join(b, ["block", "g"]).count() < 2_000 * 2_000 / 1_000
