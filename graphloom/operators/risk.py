"""Risk scores: an entity's context, its exposure through a network, factors and their explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import classify_pep
from graphloom.operators.graph import PropertyGraph
from graphloom.operators.lineage import cut
from graphloom.operators.network import Network

# Listing tags, the mark of a high-risk country, factor weights, level thresholds, degrees of exposure.
LISTINGS = ("sanction_entry", "watchlist_entry")
HIGH_RISK = "High-risk jurisdiction"
FACTORS = {"direct_sanction_match": 1.0, "indirect_sanction_exposure": 0.8, "shared_bank_account": 0.5, "pep_exposure": 0.7, "high_risk_country": 0.3}
LEVELS = (("high", 0.8), ("medium", 0.45))
EXPOSURE_DEGREE = 3
# What is said of each factor (exposure with its degrees between two halves), and where there is none.
SAID = {
    "direct_sanction_match": "Entity directly matches a sanctions record",
    "indirect_sanction_exposure": ("Entity is connected within ", " degree(s) to a sanctioned entity"),
    "shared_bank_account": "Entity shares bank account links with flagged entities",
    "pep_self": "Entity is a politically exposed person — enhanced due diligence required",
    "pep_associate": "Entity is a relative or close associate of a politically exposed person",
    "high_risk_country": "Entity is associated with a high-risk jurisdiction",
}
NOTHING_FOUND = "No significant risk indicators were detected based on the current graph evidence."


def contexts(g: PropertyGraph, entities: DataFrame, exposed: DataFrame | None = None) -> DataFrame:
    """The context of each of entities(vid), for risk_scores, from one hop around it.

    A listing counts only beside the entity itself. exposed(vid, distance, path) are nearest
    listed persons (exposure, exposures); they count only without a listing of one's own.
    vertices need tag and a props map; transfers are all TRANSFERRED_TO edges at the entity.
    """
    ids = entities.select("vid").distinct()
    own = g.vertices.join(ids, "vid", "left_semi").groupBy("vid").agg(F.max(F.col("props")["pep_status"]).alias("pep_status"))
    hop = g.undirected().join(ids.withColumnRenamed("vid", "a"), "a", "left_semi")
    transfers = hop.where("edge_type = 'TRANSFERRED_TO'").groupBy(F.col("a").alias("vid")).agg(F.count("*").alias("transfers"))
    risky = g.vertices.where((F.col("tag") == "country") & (F.col("props")["risk_classification"] == HIGH_RISK)).select(F.col("vid").alias("b"), F.lit("countries").alias("what"))
    flags = g.vertices.where(F.col("tag").isin(*LISTINGS)).select(F.col("vid").alias("b"), F.lit("listings").alias("what"))
    beside = hop.select("a", "b").distinct().join(risky.unionByName(flags).distinct(), "b").groupBy(F.col("a").alias("vid"))
    beside = beside.agg(*[F.sort_array(F.collect_set(F.when(F.col("what") == w, F.col("b")))).alias(w) for w in ("listings", "countries")])
    c = ids.join(own, "vid", "left").join(transfers, "vid", "left").join(beside, "vid", "left")
    c = c.join(exposed, "vid", "left") if exposed is not None else c.withColumns({"distance": F.lit(None).cast("int"), "path": F.lit(None).cast("array<string>")})
    direct = F.coalesce(F.size("listings") > 0, F.lit(False))
    return c.select(
        "vid", direct.alias("direct"), F.when(~direct, F.col("distance")).alias("distance"), F.coalesce("transfers", F.lit(0)).alias("transfers"), classify_pep(F.col("pep_status")).alias("pep"),
        F.coalesce(F.size("countries") > 0, F.lit(False)).alias("high_risk"), "listings", F.when(~direct, F.col("path")).alias("path"), "countries",
    )


def exposure(net: Network, listed: DataFrame, root: str) -> DataFrame:
    """vid, distance, path: the nearest of listed(vid) in root's network, and all that are as near; no row if there is none."""
    near = net.persons.where(F.col("vid") != root).join(listed.select("vid").distinct(), "vid", "left_semi")
    return near.groupBy("degree").agg(F.sort_array(F.collect_list("vid")).alias("path")).orderBy("degree").limit(1).select(F.lit(root).alias("vid"), F.col("degree").alias("distance"), "path")


def exposures(links: DataFrame, listed: DataFrame, degree: int = EXPOSURE_DEGREE) -> DataFrame:
    """vid, distance, path of every person within `degree` links(p1, p2) of one of listed(vid), for all at once.

    One level of all persons at a time, written each; path is the least of the nearest listed
    persons, so that rows don't grow with them. Listed persons have no distance of their own.
    """
    both = cut(links.select(F.col("p1").alias("a"), F.col("p2").alias("b")).unionByName(links.select(F.col("p2").alias("a"), F.col("p1").alias("b"))).distinct())
    seen = cut(listed.select("vid", F.lit(0).alias("distance"), F.col("vid").alias("_from")).distinct())
    frontier = seen
    for d in range(1, degree + 1):
        new = both.join(frontier.select(F.col("vid").alias("a"), "_from"), "a").groupBy(F.col("b").alias("vid")).agg(F.min("_from").alias("_from"))
        frontier = cut(new.join(seen, "vid", "left_anti").select("vid", F.lit(d).alias("distance"), "_from"))
        seen = seen.unionByName(frontier)
    return seen.where("distance > 0").select("vid", "distance", F.array("_from").alias("path"))


def _factors() -> dict[str, tuple[Column, Column, Column]]:
    """code: (value, explanation, evidence) of each factor; a null value is no factor."""
    direct, d = F.coalesce(F.col("direct"), F.lit(False)), F.col("distance")
    pep = F.col("pep")
    near, away = SAID["indirect_sanction_exposure"]
    return {
        "direct_sanction_match": (F.when(direct, 1.0), F.lit(SAID["direct_sanction_match"]), F.col("listings")),
        "indirect_sanction_exposure": (F.when(~direct & d.isNotNull(), F.greatest(F.lit(0.0), 0.8 - 0.2 * (d - 1))), F.concat(F.lit(near), d.cast("string"), F.lit(away)), F.col("path")),
        "shared_bank_account": (F.when(F.col("transfers") > 0, F.least(F.col("transfers") / 3, F.lit(1.0))), F.lit(SAID["shared_bank_account"]), F.lit(None)),
        "pep_exposure": (
            F.when(pep == "self", 1.0).when(pep == "associate", 0.7),
            F.when(pep == "self", SAID["pep_self"]).otherwise(SAID["pep_associate"]),
            F.array(F.col("vid").cast("string")),
        ),
        "high_risk_country": (F.when(F.col("high_risk"), 1.0), F.lit(SAID["high_risk_country"]), F.col("countries")),
    }


def risk_scores(context: DataFrame) -> DataFrame:
    """context(vid, direct, distance, transfers, pep, high_risk; listings, path, countries if known) with score, level and factors.

    A direct listing counts whole; else the nearest listed person within the network,
    less with each step. The sum is capped at 1. factors has code, weight, value,
    explanation and evidence_ids of each that holds, in this order.
    """
    c = context.withColumns({x: F.lit(None).cast("array<string>") for x in ("listings", "path", "countries") if x not in context.columns})
    total, found = F.lit(0.0), []
    for code, (value, said, ids) in _factors().items():
        weight = F.lit(FACTORS[code])
        total = total + weight * F.coalesce(value, F.lit(0.0))
        one = F.struct(F.lit(code).alias("code"), weight.alias("weight"), value.cast("double").alias("value"), said.alias("explanation"), F.coalesce(ids.cast("array<string>"), F.array().cast("array<string>")).alias("evidence_ids"))
        found.append(F.when(value.isNotNull(), one))
    score = F.round(F.least(F.lit(1.0), total), 4)
    level = F.when(F.col("score") >= LEVELS[0][1], LEVELS[0][0]).when(F.col("score") >= LEVELS[1][1], LEVELS[1][0]).otherwise("low")
    out = c.withColumn("score", score).withColumn("level", level).withColumn("factors", F.filter(F.array(*found), lambda f: f.isNotNull()))
    return out.drop(*[x for x in ("listings", "path", "countries") if x not in context.columns])


def explanation(factors: Column) -> Column:
    """The factors' explanations as one text, or that there are none."""
    return F.when(F.size(factors) == 0, F.lit(NOTHING_FOUND)).otherwise(F.array_join(F.transform(factors, lambda f: f["explanation"]), " "))
