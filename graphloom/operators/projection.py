"""Person-to-person links through what people share, with explained confidence.

Owners are counted before pairs are formed: a connector of more than max_fanout
owners is reported as a hub and never joined with itself, so a connector makes
max_fanout * (max_fanout - 1) / 2 pairs at most, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scoring import match_confidence, noisy_or
from graphloom.operators.lineage import cut, discard
from graphloom.schema import BRIDGE_CONFIDENCE, DEGREE_CAP, DIRECT_CONFIDENCE, MAX_FANOUT


def counted(owners: DataFrame) -> DataFrame:
    """owners(connector, tag, person, ...) with n, the connector's distinct owners. Partial counts come first, so a hub is no hot key."""
    n = owners.select("connector", "person").distinct().groupBy("connector").agg(F.count("*").alias("n"))
    return owners.join(n, "connector")


def suppressed_hubs(owners: DataFrame, max_fanout: int = MAX_FANOUT) -> DataFrame:
    n = owners.groupBy("connector", "tag").agg(F.countDistinct("person").alias("person_count"))
    return n.where(F.col("person_count") > max_fanout)


def _band(owners: DataFrame, max_fanout: int) -> DataFrame:
    n = owners.select("connector", "person").distinct().groupBy("connector").agg(F.count("*").alias("n")).where(F.col("n").between(2, max_fanout))
    return owners.join(n, "connector")


def shared_reasons(owners: DataFrame, max_fanout: int = MAX_FANOUT) -> DataFrame:
    """p1 < p2, connector, kind, confidence: one reason for each pair of a connector's owners."""
    o = _band(owners.select("connector", "tag", "person").distinct(), max_fanout)
    pairs = o.alias("a").join(o.alias("b"), F.expr("a.connector = b.connector AND a.person < b.person"))
    return pairs.select(F.col("a.person").alias("p1"), F.col("b.person").alias("p2"), F.col("a.connector").alias("connector"), F.lit("shared_attribute").alias("kind"), match_confidence(F.col("a.tag"), F.col("a.n"), F.lit(True)).alias("confidence"))


def field_reasons(owners: DataFrame, max_fanout: int = MAX_FANOUT) -> DataFrame:
    """Reasons from value owners(connector, person, field_key): the least shared key, else the least of both and a cross-key score."""
    keys = owners.groupBy("connector", "person").agg(F.collect_set("field_key").alias("keys"))
    o = _band(keys, max_fanout)
    pairs = o.alias("a").join(o.alias("b"), F.expr("a.connector = b.connector AND a.person < b.person"))
    shared, union = F.array_intersect("a.keys", "b.keys"), F.array_union("a.keys", "b.keys")
    same = F.size(shared) > 0
    key = F.coalesce(F.when(same, F.array_min(shared)).otherwise(F.array_min(union)), F.lit(""))
    return pairs.select(
        F.col("a.person").alias("p1"), F.col("b.person").alias("p2"), F.col("a.connector").alias("connector"), F.lit("shared_field").alias("kind"), key.alias("field_key"), same.alias("same_key"), match_confidence(key, F.col("a.n"), same).alias("confidence")
    )


def direct_reasons(edges: DataFrame, persons: DataFrame) -> DataFrame:
    """Reasons from edges(src, dst) between two persons(vid)."""
    e = edges.where("src <> dst").join(persons.select(F.col("vid").alias("src")), "src", "left_semi").join(persons.select(F.col("vid").alias("dst")), "dst", "left_semi")
    return e.select(F.least("src", "dst").alias("p1"), F.greatest("src", "dst").alias("p2"), F.lit(None).cast("string").alias("connector"), F.lit("direct").alias("kind"), F.lit(DIRECT_CONFIDENCE).alias("confidence"))


def bridge_reasons(owners: DataFrame, bridges: DataFrame, max_fanout: int = MAX_FANOUT) -> DataFrame:
    """Reasons through bridges(src, dst) between two connectors, both within the fan-out."""
    n = owners.select("connector", "person").distinct()
    o = n.join(n.groupBy("connector").agg(F.count("*").alias("n")).where(F.col("n") <= max_fanout), "connector").select("connector", "person")
    b = bridges.where("src <> dst").select("src", "dst").distinct()
    found = o.select(F.col("connector").alias("src"), F.col("person").alias("x")).join(b, "src").join(o.select(F.col("connector").alias("dst"), F.col("person").alias("y")), "dst").where("x <> y")
    return found.select(F.least("x", "y").alias("p1"), F.greatest("x", "y").alias("p2"), "src", "dst", F.lit("linked_organisation").alias("kind"), F.lit(BRIDGE_CONFIDENCE).alias("confidence"))


def links(*reasons: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """p1, p2, via_count, confidence: all reasons of a pair as one noisy-OR."""
    every = reasons[0].select("p1", "p2", "confidence")
    for r in reasons[1:]:
        every = every.unionByName(r.select("p1", "p2", "confidence"))
    out = every.groupBy("p1", "p2").agg(F.count("*").alias("via_count"), F.round(noisy_or(F.col("confidence")), 4).alias("confidence"))
    return out.where(F.col("confidence") >= min_confidence)


def person_degrees(found: DataFrame, root: str, degree: int, cap: int = DEGREE_CAP) -> DataFrame:
    """Persons within `degree` links of root: vid, degree. Levels are checkpointed; degree is clamped to 1..cap."""
    both = found.select(F.col("p1").alias("a"), F.col("p2").alias("b")).unionByName(found.select(F.col("p2").alias("a"), F.col("p1").alias("b")))
    seen = found.sparkSession.createDataFrame([(root, 0)], "vid string, degree int")
    frontier = seen
    for d in range(1, min(cap, max(1, degree)) + 1):
        new = both.join(frontier.select(F.col("vid").alias("a")), "a", "left_semi").select(F.col("b").alias("vid")).distinct()
        frontier = cut(new.join(seen, "vid", "left_anti").select("vid", F.lit(d).alias("degree")))
        seen = seen.unionByName(frontier)
    return seen


def best_path(found: DataFrame, source: str, target: str) -> DataFrame:
    """vid (the target), confidence, hops, path: the path of greatest product of confidence over links found(p1, p2, confidence); then fewest hops, then least ids. No row without a path.

    Labels are corrected in rounds: what a round improves goes one link further, and what is
    weaker than the target's best so far goes nowhere. A label loses or keeps confidence and gains a hop with
    each link, so the labels that no link improves are the best ones, whatever the order. A
    confidence of 0 counts as the least above it, so that it still connects.
    """
    c = F.greatest("confidence", F.lit(1e-9)).alias("c")
    both = cut(found.select(F.col("p1").alias("a"), F.col("p2").alias("b"), c).unionByName(found.select(F.col("p2").alias("a"), F.col("p1").alias("b"), c)))
    kind = "vid string, l struct<c: double, hops: int, path: array<string>>"
    labels = frontier = found.sparkSession.createDataFrame([(source, (-1.0, 0, [source]))], kind)
    bound = 0.0
    while True:
        step = frontier.where(F.col("vid") != target).join(both, F.col("vid") == F.col("a"))
        label = F.struct((F.col("l.c") * F.col("c")).alias("c"), (F.col("l.hops") + 1).alias("hops"), F.concat("l.path", F.array("b")).alias("path"))
        step = step.select(F.col("b").alias("vid"), label.alias("l")).where(F.col("l.c") <= bound)
        best = step.groupBy("vid").agg(F.min("l").alias("l"))
        old = labels.select(F.col("vid").alias("_v"), F.col("l").alias("_l"))
        better = cut(best.join(old, F.col("vid") == F.col("_v"), "left").where(F.col("_v").isNull() | (F.col("l") < F.col("_l"))).select("vid", "l"))
        if better.isEmpty():
            break
        before, gone = labels, frontier
        labels = cut(labels.join(better, "vid", "left_anti").unionByName(better))
        discard(before, gone)
        frontier = better
        at = labels.where(F.col("vid") == target).select("l.c").first()
        bound = at[0] if at else 0.0
    return labels.where(F.col("vid") == target).select("vid", (-F.col("l.c")).alias("confidence"), F.col("l.hops").alias("hops"), F.col("l.path").alias("path"))
