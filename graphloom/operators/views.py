"""Summaries that a client shows: groups, histograms, indexes, strongest links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T

# Words in capitals; keys that say what a document is, in reading order; keys of the record, not of its subject.
ACRONYMS = ("id", "uae")
IDENTITY_KEYS = ("document_type", "number", "name", "label", "issuing_country", "issue_date", "expiry_date")
# Headings of the kinds of reason, and what begins, joins and ends their details.
HEADINGS = {"direct": "Direct relationship", "attribute": "Shared ", "field": "Matching ", "fields": "Matching value across different fields", "organisations": "Linked organisations"}
DETAILS = {"attribute": "Both people hold ", "field": "Both documents give ", "and": " and ", "fields": " both give ", "quotes": ("“", "”.")}
SYSTEM_KEYS = ("confidence", "entity_type", "created_at", "updated_at", "evidence_ids", "props", "degree", "is_new")


def links_by_person(links: DataFrame) -> DataFrame:
    """vid, n, strongest: links(p1, p2, confidence) counted at both ends."""
    ends = links.select(F.explode(F.array("p1", "p2")).alias("vid"), "confidence")
    return ends.groupBy("vid").agg(F.count("*").alias("n"), F.max("confidence").alias("strongest"))


def strongest_links(links: DataFrame, top: int = 3) -> DataFrame:
    """The top links of each person: vid, other, confidence, rank."""
    both = links.select(F.col("p1").alias("vid"), F.col("p2").alias("other"), "confidence").unionByName(links.select(F.col("p2").alias("vid"), F.col("p1").alias("other"), "confidence"))
    w = Window.partitionBy("vid").orderBy(F.desc("confidence"), "other")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def tag_histogram(vertices: DataFrame, top: int | None = 8) -> DataFrame:
    n = vertices.groupBy("tag").agg(F.count("*").alias("n"))
    return n if top is None else n.orderBy(F.desc("n"), "tag").limit(top)


def match_index(reasons: DataFrame) -> DataFrame:
    """Persons of each matched value (the reasons' connector)."""
    return reasons.select("connector", F.explode(F.array("p1", "p2")).alias("person")).distinct().groupBy("connector").agg(F.count("*").alias("persons"), F.min("person").alias("first_person"))


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Unordered pairs of new(p1, p2) that old lacks."""
    key = lambda d: d.select(F.least("p1", "p2").alias("p1"), F.greatest("p1", "p2").alias("p2")).distinct()
    return key(new).join(key(old), ["p1", "p2"], "left_anti")


def collapse(vertices: DataFrame, edges: DataFrame, owners: DataFrame, root: str, gone: str) -> tuple[DataFrame, DataFrame]:
    """What stays when vertex `gone` is collapsed. owners(src, dst, edge_type, owner) tells which expansions showed an edge.

    An edge goes with its last owner; then a vertex that is neither root, nor `gone`, nor at an edge goes.
    """
    key = ["src", "dst", "edge_type"]
    kept = edges.join(owners.where(F.col("owner") != gone).select(*key).distinct(), key, "left_semi")
    ends = kept.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()
    return vertices.where(F.col("vid").isin(root, gone)).unionByName(vertices.where(~F.col("vid").isin(root, gone)).join(ends, "vid", "left_semi")), kept


def expand_into(vertices: DataFrame, edges: DataFrame, more_vertices: DataFrame, more_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A shown graph and an expansion: vertices are added if absent, edges overwritten."""
    key = ["src", "dst", "edge_type", "rank"]
    return vertices.unionByName(more_vertices.join(vertices.select("vid"), "vid", "left_anti")), edges.join(more_edges.select(*key), key, "left_anti").unionByName(more_edges)


def title_words(c: Column) -> Column:
    """Words of a snake-, kebab- or blank-separated name, capitalised; ID and UAE in capitals."""
    one = lambda w: F.when(F.lower(w).isin(*ACRONYMS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))
    return F.array_join(F.transform(F.filter(F.split(c, r"[\s_-]+"), lambda w: w != ""), one), " ")


def attribute_label(tag: Column, label: Column, document_type: Column) -> Column:
    """What a thing is called beside its person: documents by their kind, others by their label."""
    kind = title_words(F.coalesce(document_type, F.lit("")))
    return F.when(tag == "document", F.when(kind != "", kind).otherwise("Document")).otherwise(label)


def described(reasons: DataFrame, readable: DataFrame | None = None) -> DataFrame:
    """reasons (columns of network.REASON) with heading and detail: each reason in words.

    A field value is known in its normal form only. readable(vid, field_key, raw) are the
    properties of documents and persons: the value is shown as the first of the citing
    documents, or one of both persons, gives it.
    """
    if readable is None:
        value = F.col("connector_label")
        r = reasons
    else:
        raw = readable.select(F.col("vid").alias("_vid"), F.col("field_key").alias("_key"), T.normalize_value(F.col("raw")).alias("_norm"), F.col("raw").alias("_raw")).where("_norm IS NOT NULL")
        r = reasons.withColumn("_id", F.xxhash64("p1", "p2", "connector"))
        said = r.where("kind = 'shared_field'").select("_id", "connector_label", "field_keys", F.posexplode(F.concat(F.coalesce("document_ids", F.array().cast("array<string>")), F.array("p1", "p2"))).alias("_at", "_vid"))
        said = said.join(raw, "_vid").where(F.expr("_norm = connector_label AND array_contains(field_keys, _key)"))
        said = said.groupBy("_id").agg(F.min_by("_raw", F.struct("_at", "_key")).alias("_said"))
        r, value = r.join(said, "_id", "left").drop("_id"), F.coalesce("_said", "connector_label")
    kind, quoted = F.col("kind"), F.concat(F.lit(DETAILS["quotes"][0]), value, F.lit(DETAILS["quotes"][1]))
    fields = F.array_join(F.transform("field_keys", title_words), DETAILS["and"])
    heading = (
        F.when(kind == "direct", HEADINGS["direct"])
        .when(kind == "shared_attribute", F.concat(F.lit(HEADINGS["attribute"]), F.lower(title_words(F.col("connector_tag")))))
        .when(kind == "shared_field", F.when(F.col("same_key"), F.concat(F.lit(HEADINGS["field"]), F.lower(title_words(F.col("field_key"))))).otherwise(HEADINGS["fields"]))
        .otherwise(HEADINGS["organisations"])
    )
    detail = (
        F.when(kind == "shared_attribute", F.concat(F.lit(DETAILS["attribute"]), F.col("connector_label"), F.lit(".")))
        .when(kind == "shared_field", F.when(F.col("same_key"), F.concat(F.lit(DETAILS["field"]), quoted)).otherwise(F.concat(fields, F.lit(DETAILS["fields"]), quoted)))
        .otherwise(F.col("label"))
    )
    return r.withColumn("heading", heading).withColumn("detail", detail).drop("_said")


def attribute_fields(attributes: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """id, place, field_key, label, value, kind, matched_with: the facts among attributes(id, props map; holders), in reading order.

    What says which document it is comes first, in a fixed order; then the claims that
    matches(value, person) has for others than the holders; then the rest by label.
    """
    a = attributes if "holders" in attributes.columns else attributes.withColumn("holders", F.array().cast("array<string>"))
    f = a.select("id", "holders", F.explode("props").alias("field_key", "value")).where(~F.col("field_key").isin(*SYSTEM_KEYS))
    place = F.array_position(F.array(*[F.lit(k) for k in IDENTITY_KEYS]), F.col("field_key"))
    f = f.withColumns({"_i": place, "kind": F.when(place > 0, "identity").otherwise("claim"), "label": title_words(F.col("field_key"))})
    if matches is not None:
        f = f.withColumn("_v", F.when(F.col("kind") == "claim", T.normalize_value(F.col("value"))))
        asked = f.where("_v IS NOT NULL").select("id", "field_key", "_v", "holders").join(matches.select(F.col("value").alias("_v"), "person").distinct(), "_v").where("NOT array_contains(holders, person)")
        f = f.join(asked.groupBy("id", "field_key").agg(F.sort_array(F.collect_set("person")).alias("matched_with")), ["id", "field_key"], "left")
    else:
        f = f.withColumn("matched_with", F.lit(None).cast("array<string>"))
    f = f.withColumn("matched_with", F.coalesce("matched_with", F.array().cast("array<string>")))
    w = Window.partitionBy("id").orderBy(F.col("kind") != "identity", F.when(F.col("kind") == "identity", F.col("_i")), F.size("matched_with") == 0, "label", "field_key")
    return f.select("id", F.row_number().over(w).alias("place"), "field_key", "label", "value", "kind", "matched_with")


def through_connector(reasons: DataFrame, connector: str) -> DataFrame:
    """The pairs p1, p2 that a thing is a reason for: it links them, or it is a document that states what they share."""
    cited = (F.col("kind") == "shared_field") & F.coalesce(F.array_contains("document_ids", connector), F.lit(False))
    return reasons.where((F.col("kind") != "direct") & ((F.col("connector") == connector) | cited)).select("p1", "p2").distinct()


def other_end(vid: str) -> Column:
    return F.when(F.col("p1") == vid, F.col("p2")).otherwise(F.col("p1"))


def links_of(links: DataFrame, vid: str) -> DataFrame:
    """other, confidence of one person's links, the strongest first."""
    return links.where((F.col("p1") == vid) | (F.col("p2") == vid)).select(other_end(vid).alias("other"), "confidence").orderBy(F.desc("confidence"), "other")


def weakest_hop(links: DataFrame) -> DataFrame:
    """The row of a path's links with the least confidence."""
    return links.orderBy("confidence", "p1", "p2").limit(1)


def grouped(things: DataFrame, documents_first: bool = True) -> DataFrame:
    """place, tag, n, ids of things(id, tag): documents first and then by tag, or the largest group first. For one person's or canvas's things."""
    g = things.groupBy("tag").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))
    order = [F.col("tag") != "document", "tag"] if documents_first else [F.desc("n"), "tag"]
    return g.select(F.row_number().over(Window.orderBy(*order)).alias("place"), "tag", "n", "ids")


# ---- how vertices and edges are drawn


def edge_style(edges: DataFrame) -> DataFrame:
    """edges(src, dst, edge_type, rank, props map) with id, weight, shown_confidence and label.

    Weight is the number of reasons, 1 if there are none; a stored edge is certain; its
    relationship_type prevails over the type.
    """
    p = F.col("props")
    said, n = F.trim(p["relationship_type"]), p["via_count"].try_cast("double")
    return edges.withColumns({
        "id": F.format_string("%s->%s@%s@%d", "src", "dst", "edge_type", "rank"),
        "weight": F.when(n > 0, n).otherwise(F.lit(1.0)),
        "shown_confidence": F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p["confidence"].try_cast("double"))), F.lit(1.0)),
        "label": F.when(said != "", p["relationship_type"]).otherwise(F.col("edge_type")),
    })


def role(tags: Column, main: list[str]) -> Column:
    """main or sub: a vertex is main where no main tags are set, or it has one."""
    return F.lit("main") if not main else F.when(F.arrays_overlap(tags, F.array(*[F.lit(t) for t in main])), "main").otherwise("sub")


def degree_color(degree: Column, palette: list[str]) -> Column:
    """The palette's colour of a degree from 1, its last one for greater degrees; null for none."""
    return F.when(degree >= 1, F.element_at(F.array(*[F.lit(c) for c in palette]), F.least(F.round(degree).cast("int"), F.lit(len(palette)))))


def tag_color(tag: Column, palette: list[str]) -> Column:
    """The palette's colour of a tag by a 32-bit polynomial hash of its characters, base 31."""
    codes = F.transform(F.filter(F.split(tag, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % (1 << 32))
    return F.element_at(F.array(*[F.lit(c) for c in palette]), (h % len(palette)).cast("int") + 1)


def path_elements(persons: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A path's persons(vid, label, degree) and links (of Network) as vertices and edges to draw."""
    v = persons.select("vid", F.array(F.lit("person")).alias("tags"), "label", F.create_map(F.lit("degree"), F.col("degree").cast("string")).alias("props"))
    bag = [x for n, c in (("degree", "degree"), ("confidence", "confidence"), ("via_count", "via_count"), ("relationship_type", "label")) for x in (F.lit(n), F.col(c).cast("string"))]
    return v, links.select(F.col("p1").alias("src"), F.col("p2").alias("dst"), F.col("label").alias("edge_type"), F.lit(0).cast("long").alias("rank"), F.create_map(*bag).alias("props"))


def ring_positions(parents: DataFrame, children: DataFrame, base: float = 150.0, spacing: float = 90.0) -> DataFrame:
    """id, x, y: children(id, parent, sort_key) around parents(vid, x, y).

    A child of one parent is on the parent's ring, in order, from an angle that the parent's
    id sets; the ring grows with its children. A child of several is at their middle, and
    those of the same parents fan out across the line between the first two. Children without
    a placed parent are left out.
    """
    c = children.distinct().join(parents.withColumnRenamed("vid", "parent"), "parent")
    c = c.groupBy("id", "sort_key").agg(F.array_sort(F.collect_list(F.struct("parent", "x", "y"))).alias("p"))
    group = F.array_join(F.transform("p", lambda q: q["parent"]), "|")
    c = c.withColumn("_g", group)
    w = Window.partitionBy("_g")
    c = c.withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy("sort_key", "id")) - 1, "_a": F.col("p")[0], "_b": F.get("p", F.lit(1))})
    angle = F.radians(F.pmod(F.xxhash64("_g"), F.lit(360)).cast("double")) + 2 * F.pi() * F.col("_i") / F.col("_n")
    radius = F.greatest(F.lit(base), F.col("_n") * spacing / (2 * F.pi()))
    shift = (F.col("_i") - (F.col("_n") - 1) / 2) * spacing
    dx, dy = F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y")
    length = F.sqrt(dx * dx + dy * dy)
    middle = lambda k: F.aggregate("p", F.lit(0.0), lambda s, q: s + q[k]) / F.size("p")
    one = F.size("p") == 1
    x = F.when(one, F.col("_a.x") + radius * F.cos(angle)).otherwise(middle("x") + F.when(length > 0, -dy / length).otherwise(0.0) * shift)
    y = F.when(one, F.col("_a.y") + radius * F.sin(angle)).otherwise(middle("y") + F.when(length > 0, dx / length).otherwise(1.0) * shift)
    return c.select("id", x.alias("x"), y.alias("y"))
