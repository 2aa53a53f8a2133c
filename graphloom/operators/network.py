"""A person's network, level by level, with explained links; the connection of two persons."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.records import humanize
from graphloom.functions.scoring import match_confidence, noisy_or
from graphloom.operators.lineage import cut
from graphloom.operators.projection import best_path
from graphloom.schema import BRIDGE, BRIDGE_CONFIDENCE, BRIDGE_TAGS, CONNECTION_CAP, DEGREE_CAP, DIRECT, DIRECT_CONFIDENCE, EXPANDABLE_TAGS, FIELD_EDGE, FIELD_TAG, MAX_FANOUT, MAX_PERSONS, SHARED, WEAK

#: Columns of a reason, and their types; those that a kind of reason lacks are null.
REASON = {
    "p1": "string", "p2": "string", "kind": "string", "connector": "string", "connector_tag": "string", "connector_label": "string", "linked": "string", "linked_tag": "string", "linked_label": "string",
    "edge_types": "array<string>", "field_key": "string", "field_keys": "array<string>", "same_key": "boolean", "document_ids": "array<string>", "label": "string", "confidence": "double",
}
_OWNERS = {"connector": None, "tag": "cast(null as string)", "label": "connector", "person": None, "edge_type": "cast(null as string)", "field_key": "cast(null as string)", "document_id": "cast(null as string)"}
_ENDS = {"src": None, "dst": None, "edge_type": "cast(null as string)", "rank": "0L", "label": "lower(replace(edge_type, '_', ' '))"}


def _columns(df: DataFrame, wanted: dict[str, str | None]) -> DataFrame:
    return df.select(*[F.col(c) if c in df.columns else F.expr(e).alias(c) for c, e in wanted.items()])


@dataclass(frozen=True)
class Sources:
    """What links persons.

    owners(connector, tag, person; label, edge_type, field_key, document_id if known): who is
    attached to what. direct(src, dst, edge_type; rank, label): edges between persons.
    bridges(src, dst, edge_type; rank, label): edges between connectors. persons(vid, ...): who
    exists; without it, whoever owns something or is at the end of a direct edge.
    """

    owners: DataFrame
    direct: DataFrame
    bridges: DataFrame | None = None
    persons: DataFrame | None = None
    members: DataFrame | None = None

    def prepared(self) -> Sources:
        """Everything computed once and kept: what each level reads again, with the owners counted.

        members has a row for each connector and person; a connector's owners don't depend on
        the level, so they are counted here, by partial sums, and never again.
        """
        if self.members is not None:
            return self
        owners = _columns(self.owners, _OWNERS)
        one = owners.groupBy("connector", "person").agg(
            F.min("tag").alias("tag"), F.min("label").alias("label"), F.sort_array(F.collect_set("edge_type")).alias("edge_types"),
            *[F.sort_array(F.collect_set(F.when(F.trim(c) != "", F.trim(c)))).alias(f"{c}s") for c in ("field_key", "document_id")],
        )
        one = cut(one)
        n = one.groupBy("connector").agg(F.count("*").alias("n"))
        members = cut(one.join(n, "connector"))
        direct = cut(_columns(self.direct, _ENDS).distinct())
        bridges = None if self.bridges is None else cut(_columns(self.bridges, _ENDS).distinct())
        persons = self.persons
        if persons is None:
            persons = cut(members.select(F.col("person").alias("vid")).unionByName(direct.select(F.explode(F.array("src", "dst")).alias("vid"))).distinct())
        return replace(self, direct=direct, bridges=bridges, persons=persons, members=members)

    def has_person(self, vid: str) -> bool:
        return not self.persons.where(F.col("vid") == vid).isEmpty()

    def held_by(self, persons: DataFrame) -> DataFrame:
        """What persons(person) own."""
        return self.members.join(persons, "person", "left_semi")

    def holders(self, connectors: DataFrame) -> DataFrame:
        """The owners of connectors(connector)."""
        return self.members.join(connectors, "connector", "left_semi")

    def edges_at(self, persons: DataFrame) -> DataFrame:
        """src, dst, edge_type, rank, label of direct edges with an end among persons(person), once each."""
        direct = self.direct.where("src <> dst")
        out = direct.join(persons.withColumnRenamed("person", "src"), "src", "left_semi")
        into = direct.join(persons.withColumnRenamed("person", "dst"), "dst", "left_semi").join(persons.withColumnRenamed("person", "src"), "src", "left_anti")
        return out.unionByName(into)

    def bridges_at(self, connectors: DataFrame) -> DataFrame:
        """this, other, edge_type, said of bridges from connectors(connector) to connectors that aren't among them."""
        b = self.bridges.where("src <> dst")
        b = b.select(F.col("src").alias("this"), F.col("dst").alias("other"), "edge_type", F.col("label").alias("said")).unionByName(b.select(F.col("dst").alias("this"), F.col("src").alias("other"), "edge_type", F.col("label").alias("said")))
        return b.join(connectors.withColumnRenamed("connector", "this"), "this", "left_semi").join(connectors.withColumnRenamed("connector", "other"), "other", "left_anti")


@dataclass(frozen=True)
class Network:
    persons: DataFrame  # vid, degree
    reasons: DataFrame  # degree and the columns of REASON
    hubs: DataFrame  # connector, tag, label, person_count
    truncated: bool

    def links(self) -> DataFrame:
        """p1, p2, degree, via_count, confidence, label: one row a pair, the reasons compounded."""
        one = F.col("_one")
        said = F.when(one.kind == "shared_attribute", F.concat(F.lit("shared "), humanize(one.connector_tag))).when(
            one.kind == "shared_field", F.concat(F.lit("matching "), humanize(F.coalesce(F.when(one.field_key != "", one.field_key), F.lit("field"))))
        )
        found = self.reasons.groupBy("p1", "p2", "degree").agg(
            F.count("*").alias("via_count"), F.round(noisy_or(F.col("confidence")), 4).alias("confidence"), F.first(F.struct("kind", "connector_tag", "field_key", "label")).alias("_one")
        )
        label = F.when(F.col("via_count") == 1, F.coalesce(said, one.label)).otherwise(F.concat(F.col("via_count").cast("string"), F.lit(" connections")))
        return found.select("p1", "p2", "degree", "via_count", "confidence", label.alias("label"))

    def ordered(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(persons, links, hubs) as a client gets them: by degree and vid, by degree and ends, greatest hub first."""
        return self.persons.orderBy("degree", "vid"), self.links().orderBy("degree", "p1", "p2"), self.hubs.orderBy(F.desc("person_count"), "connector")


def connector_types(available: list[str], asked: list[str] | None = None) -> dict[str, list[str]]:
    """Edge types by class, of those that exist; weak ones only if asked for."""
    wanted = {*DIRECT, *SHARED, *BRIDGE} if asked is None else {a.strip().upper() for a in asked if a.strip()}
    usable = wanted & set(available)
    return {"direct": [t for t in DIRECT if t in usable], "shared": [t for t in (*SHARED, *WEAK) if t in usable], "bridge": [t for t in BRIDGE if t in usable]}


def _named(vertices: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """vid, tag (the least but person, which prevails), label (the vid where there is none)."""
    label = F.when(F.trim("label") != "", F.col("label")) if "label" in vertices.columns else F.lit(None).cast("string")
    return vertices.groupBy("vid").agg(F.min(F.struct(F.col("tag") != "person", "tag")).alias("_t"), F.min(label).alias("_l")).select("vid", F.col("_t.tag").alias("tag"), F.coalesce("_l", "vid").alias("label"))


def sources(vertices: DataFrame, edges: DataFrame, asked: list[str] | None = None) -> Sources:
    """Sources of a graph, prepared: persons at the ends of direct edges, what persons attach to, and what links that.

    vertices(vid, tag, label if known); edges(src, dst, edge_type; rank, props map and, for
    field values, field_key and document_id if known). A relationship_type among the props
    is a direct edge's label. Classes of edges that a graph lacks are empty.
    """
    spark = vertices.sparkSession
    kinds = connector_types([*DIRECT, *SHARED, *WEAK, *BRIDGE], asked)
    named = cut(_named(vertices))
    persons = named.where("tag = 'person'").select("vid", "label")
    bag = F.col("props") if "props" in edges.columns else F.lit(None).cast("map<string,string>")
    text = lambda name: (F.coalesce(F.col(name), bag[name]) if name in edges.columns else bag[name]).cast("string").alias(name)
    rank = F.col("rank").cast("long") if "rank" in edges.columns else F.lit(0).cast("long")
    said = F.trim(bag["relationship_type"])
    label = F.coalesce(F.when(said != "", said), humanize(F.col("edge_type"))).alias("label")
    every = edges.select("src", "dst", "edge_type", rank.alias("rank"), text("field_key"), text("document_id"), label).where(F.col("edge_type").isin([t for ts in kinds.values() for t in ts] or ["\0"]))
    every = cut(every.distinct())

    def of(kind: str) -> DataFrame:
        return every.where(F.col("edge_type").isin(kinds[kind] or ["\0"]))

    shared = of("shared")
    at = [F.col("edge_type"), F.col("field_key"), F.col("document_id")]
    ends = shared.select(F.col("src").alias("connector"), F.col("dst").alias("person"), *at).unionByName(shared.select(F.col("dst").alias("connector"), F.col("src").alias("person"), *at))
    things = named.where("tag <> 'person'").withColumnRenamed("vid", "connector")
    owners = ends.join(persons.select(F.col("vid").alias("person")), "person", "left_semi").join(things, "connector").distinct()
    direct = of("direct").drop("field_key", "document_id")
    for end in ("src", "dst"):
        direct = direct.join(persons.select(F.col("vid").alias(end)), end, "left_semi")
    orgs = named.where(F.col("tag").isin(*BRIDGE_TAGS))
    bridges = of("bridge").select("src", "dst", "edge_type", "rank")
    for end in ("src", "dst"):
        bridges = bridges.join(orgs.select(F.col("vid").alias(end), F.col("label").alias(f"_{end}")), end)
    bridges = bridges.select("src", "dst", "edge_type", "rank", F.concat_ws(" ", "_src", humanize(F.col("edge_type")), "_dst").alias("label"))
    if not (kinds["shared"] and kinds["bridge"]):
        bridges = None
    return Sources(owners if kinds["shared"] else spark.createDataFrame([], "connector string, tag string, person string"), direct, bridges, persons).prepared()


def _reasons(found: DataFrame, **columns: Column) -> DataFrame:
    return found.select(*[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in REASON.items()])


def _level(s: Sources, frontier: DataFrame, max_fanout: int) -> tuple[DataFrame, DataFrame]:
    """(reasons, hubs) through what the frontier(vid) touches."""
    at = frontier.select(F.col("vid").alias("person"))
    near = cut(s.held_by(at).select("connector").distinct())
    mine = s.holders(near)
    hubs = mine.where(F.col("n") > max_fanout).groupBy("connector").agg(F.min("tag").alias("tag"), F.min("label").alias("label"), F.max("n").alias("person_count"))
    band = mine.where(F.col("n") <= max_fanout)
    two = band.where("n >= 2")
    types = two.groupBy("connector").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("edge_types")))).alias("every_type"))
    pairs = two.alias("a").join(two.alias("b"), F.expr("a.connector = b.connector AND a.person < b.person")).join(types.withColumnRenamed("connector", "_c"), F.col("a.connector") == F.col("_c"))
    field = F.col("a.tag") == FIELD_TAG
    both, union = F.array_intersect("a.field_keys", "b.field_keys"), F.array_sort(F.array_union("a.field_keys", "b.field_keys"))
    same = F.when(field, F.size(both) > 0)
    key = F.when(field, F.coalesce(F.when(same, F.array_min(both)).otherwise(F.array_min(union)), F.lit("")))
    reasons = _reasons(
        pairs, p1=F.col("a.person"), p2=F.col("b.person"), kind=F.when(field, "shared_field").otherwise("shared_attribute"), connector=F.col("a.connector"), connector_tag=F.col("a.tag"), connector_label=F.col("a.label"),
        edge_types=F.when(field, F.array(F.lit(FIELD_EDGE))).otherwise(F.col("every_type")), field_key=key, field_keys=F.when(field, union), same_key=same,
        document_ids=F.when(field, F.array_sort(F.array_union("a.document_ids", "b.document_ids"))), confidence=match_confidence(F.coalesce(key, F.col("a.tag")), F.col("a.n"), F.coalesce(same, F.lit(True))),
    )
    # an edge between two frontier persons is found from both ends, and counts once
    direct = s.edges_at(at)
    reasons = reasons.unionByName(
        _reasons(direct, p1=F.least("src", "dst"), p2=F.greatest("src", "dst"), kind=F.lit("direct"), edge_types=F.array("edge_type"), label=F.col("label"), confidence=F.lit(DIRECT_CONFIDENCE))
    )
    if s.bridges is None:
        return reasons, hubs
    org = F.col("tag").isin(*BRIDGE_TAGS)
    here = band.where(org).select(F.col("connector").alias("this"), F.col("person").alias("x"), F.col("tag").alias("_tag"), F.col("label").alias("_label"))
    b = cut(s.bridges_at(near))
    there = s.holders(b.select(F.col("other").alias("connector")).distinct()).where(org & (F.col("n") <= max_fanout))
    there = there.select(F.col("connector").alias("other"), F.col("person").alias("y"), F.col("tag").alias("_tag2"), F.col("label").alias("_label2"))
    found = here.join(b, "this").join(there, "other").where("x <> y")
    bridged = _reasons(
        found, p1=F.least("x", "y"), p2=F.greatest("x", "y"), kind=F.lit("linked_organisation"), connector=F.col("this"), connector_tag=F.col("_tag"), connector_label=F.col("_label"),
        linked=F.col("other"), linked_tag=F.col("_tag2"), linked_label=F.col("_label2"), edge_types=F.array("edge_type"), label=F.col("said"), confidence=F.lit(BRIDGE_CONFIDENCE),
    )
    return reasons.unionByName(bridged), hubs


def person_network(s: Sources, root: str, degree: int = 1, min_confidence: float = 0.0, max_fanout: int = MAX_FANOUT, max_persons: int = MAX_PERSONS, cap: int = DEGREE_CAP) -> Network | None:
    """Persons within `degree` links of root, and why; None where root is no person.

    A level's links below min_confidence (judged on that level's reasons) lead
    nowhere. Persons are admitted by vid until max_persons; a link stays if both
    ends are in. A reason met again on a later level counts once. Each level is
    checkpointed, so plans stay short and lost executors cost one level.
    """
    s = s.prepared()
    if not s.has_person(root):
        return None
    persons = s.direct.sparkSession.createDataFrame([(root, 0)], "vid string, degree int")
    frontier, every, hubs, truncated, count = persons, None, None, False, 1
    for level in range(1, max(1, min(int(degree), cap)) + 1):
        reasons, found_hubs = _level(s, frontier, max_fanout)
        if min_confidence > 0:
            strong = reasons.groupBy("p1", "p2").agg(noisy_or(F.col("confidence")).alias("_c")).where(F.col("_c") >= min_confidence)
            reasons = reasons.join(strong.select("p1", "p2"), ["p1", "p2"], "left_semi")
        reasons = cut(reasons.select(*REASON, F.lit(level).alias("level")))
        every = reasons if every is None else every.unionByName(reasons)
        hubs = found_hubs if hubs is None else hubs.unionByName(found_hubs)
        ends = reasons.select(F.explode(F.array("p1", "p2")).alias("vid")).distinct()
        frontier, room = cut(ends.join(persons, "vid", "left_anti")), max_persons - count
        got = frontier.count()
        if got > room:  # only a cap needs an order, of at most max_persons rows
            truncated, got = True, room
            frontier = cut(frontier.orderBy("vid").limit(room))
        if not got:
            break
        count += got
        persons = persons.unionByName(frontier.select("vid", F.lit(level).alias("degree")))
    pair = Window.partitionBy("p1", "p2")
    same = Window.partitionBy("p1", "p2", "kind", F.least("connector", "linked"), F.greatest("connector", "linked"), F.array_join("edge_types", "\0"), F.array_join("field_keys", "\0")).orderBy("level")
    kept = every.withColumn("degree", F.min("level").over(pair)).withColumn("_i", F.row_number().over(same)).where("level = degree OR _i = 1")
    for end in ("p1", "p2"):
        kept = kept.join(persons.select(F.col("vid").alias(end)), end, "left_semi")
    return Network(persons, kept.select("degree", *REASON), hubs.distinct(), truncated)


def connection(s: Sources, source: str, target: str, max_degree: int = CONNECTION_CAP, max_persons: int = MAX_PERSONS) -> DataFrame | None:
    """source, target, connected, confidence, path, truncated, hops of the strongest path in source's network; one row. None where source is no person.

    The network's links stay tables, and so do the paths until the best one is known. hops:
    the path's links in order. truncated tells that persons were left out by max_persons, so
    that "not connected" may be wrong.
    """
    net = person_network(s, source, max_degree, max_persons=max_persons, cap=max_degree)
    if net is None:
        return None
    found = cut(net.links())
    best = best_path(found, source, target)
    ends = F.explode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(i, least(path[i - 1], path[i]) AS p1, greatest(path[i - 1], path[i]) AS p2))"))
    hops = best.where("size(path) > 1").select(ends.alias("e")).select("e.*").join(found, ["p1", "p2"])
    hops = hops.agg(F.array_sort(F.collect_list(F.struct("i", "p1", "p2", "degree", "via_count", "confidence", "label"))).alias("hops"))
    asked = s.direct.sparkSession.createDataFrame([(source, target, net.truncated)], "source string, target string, truncated boolean")
    row = asked.join(best.drop("hops").withColumnRenamed("vid", "target"), "target", "left").withColumn("k", F.lit(1)).join(hops.withColumn("k", F.lit(1)), "k")
    none = F.array().cast("array<string>")
    return row.select("source", "target", F.col("path").isNotNull().alias("connected"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("path", none).alias("path"), "truncated", "hops")


def find_connection(s: Sources, source: str, target: str, max_degree: int = CONNECTION_CAP, max_persons: int = MAX_PERSONS) -> dict | None:
    """`connection` as a client gets it: the path and its links.

    An error for one person asked twice, or a target that is no person; None where the source is none.
    """
    if source == target:
        return {"error": "same_person"}
    s = s.prepared()
    if not s.has_person(target):
        return {"error": "target_not_found"}
    found = connection(s, source, target, max_degree, max_persons)
    if found is None:
        return None
    r = found.first()
    if not r.connected:
        return {"connected": False, "path": [], "links": [], "confidence": 0.0, "truncated": r.truncated, "max_degree_searched": max_degree}
    hops = [{k: v for k, v in h.asDict().items() if k != "i"} for h in r.hops]
    return {"connected": True, "path": r.path, "links": hops, "confidence": r.confidence, "truncated": r.truncated}


def attributes(s: Sources, persons: DataFrame | None = None, tags: tuple[str, ...] = EXPANDABLE_TAGS) -> DataFrame:
    """person, connector, tag, label, edge_type, n, shared_with: what persons(vid), or all, own of the tags, and who else does: everybody, in order.

    That is what one asks of a few persons. For all persons at once `holders` has the same in as many
    rows as there are owners, where a connector of n owners would be told n times here.
    """
    s = s.prepared()
    mine = s.held_by(persons.select(F.col("vid").alias("person"))) if persons is not None else s.members
    mine = mine.where(F.col("tag").isin(*tags))
    near = mine.select("connector").distinct()
    every = (s.holders(near) if persons is not None else mine).groupBy("connector").agg(F.sort_array(F.collect_set("person")).alias("_all"))
    return mine.join(every, "connector").select("person", "connector", "tag", "label", F.col("edge_types")[0].alias("edge_type"), "n", F.array_except("_all", F.array("person")).alias("shared_with"))


def holders(s: Sources, tags: tuple[str, ...] = EXPANDABLE_TAGS) -> DataFrame:
    """connector, tag, label, person, representative, n: all owners of connectors with the tags, each with the least owner; no hub is left out."""
    own = s.prepared().members.where(F.col("tag").isin(*tags))
    least = own.groupBy("connector").agg(F.min("person").alias("representative"))
    return own.join(least, "connector").select("connector", "tag", "label", "person", "representative", "n")
