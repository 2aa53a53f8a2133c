"""Accepted entities, evidence and relationships as rows of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sinks import graph_store
from graphloom.sinks.schemas import KEY_COLUMN, TAG_OF


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def tag_of(entity_type: Column) -> Column:
    """An entity type's tag; an unknown one in lower case."""
    return F.coalesce(_map(TAG_OF)[entity_type], F.lower(entity_type))


def entity_rows(entities: DataFrame) -> DataFrame:
    """vid, tag, label, entity_type, key, props, confidence, evidence_ids, updated_at of entities(entity_id, type, name, confidence; aliases, attributes map, evidence_id).

    props is a JSON object of the attributes and the aliases; attributes of one called
    extra_props, an object of its own, are taken up where they aren't given. key is the
    attribute that identifies the tag; evidence_ids names the evidence at hand alone.
    """
    e = entities.withColumns({c: F.lit(None).cast(t) for c, t in {"aliases": "array<string>", "attributes": "map<string,string>", "evidence_id": "string"}.items() if c not in entities.columns})
    empty = F.expr("map()").cast("map<string,string>")
    own = F.map_filter(F.coalesce("attributes", empty), lambda k, _: ~k.isin("aliases", "extra_props"))
    extra = F.coalesce(F.from_json(F.col("attributes")["extra_props"], "map<string,string>"), empty)
    bag = F.map_concat(F.map_filter(extra, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own)
    aliases = F.coalesce(F.to_json("aliases"), F.lit("[]"))
    body = F.to_json(bag)
    props = F.concat(F.lit('{"aliases":'), aliases, F.when(body == "{}", F.lit("}")).otherwise(F.concat(F.lit(","), F.substring(body, 2, 1 << 30))))
    tag = tag_of(F.col("type"))
    key = F.when(_map(KEY_COLUMN)[tag].isNotNull(), F.coalesce(bag[_map(KEY_COLUMN)[tag]], F.lit("")))
    evidence = F.when(F.col("evidence_id").isNotNull(), F.to_json(F.array("evidence_id"))).otherwise("[]")
    return e.select(F.col("entity_id").alias("vid"), tag.alias("tag"), F.col("name").alias("label"), F.col("type").alias("entity_type"), key.alias("key"), props.alias("props"), F.col("confidence").cast("double"), evidence.alias("evidence_ids"), F.current_timestamp().alias("updated_at"))


def evidence_rows(evidence: DataFrame) -> DataFrame:
    """The vertices of evidence(evidence_id, source; source_type)."""
    kind = F.col("source_type") if "source_type" in evidence.columns else F.lit("text")
    return evidence.select(F.col("evidence_id").alias("vid"), F.lit("evidence").alias("tag"), F.col("source").alias("label"), F.lit("evidence").alias("entity_type"), F.col("source").alias("source_name"), kind.alias("source_type")).dropDuplicates(["vid"])


def supported_by(support: DataFrame) -> DataFrame:
    """SUPPORTED_BY edges of support(entity_id, evidence_id, confidence): one an entity and evidence, with the greatest confidence."""
    best = support.groupBy(F.col("entity_id").alias("src"), F.col("evidence_id").alias("dst")).agg(F.max("confidence").alias("extraction_confidence"))
    return best.select("src", "dst", F.lit("SUPPORTED_BY").alias("edge_type"), F.lit(0).cast("long").alias("rank"), "extraction_confidence")


def relationship_rows(relations: DataFrame, status: str = "accepted") -> DataFrame:
    """Edge rows of relations(src, dst, type, confidence, evidence_id; attributes map, label): one an edge, that of the last evidence by id."""
    r = relations.withColumns({c: F.lit(None).cast(t) for c, t in {"attributes": "map<string,string>", "label": "string"}.items() if c not in relations.columns})
    r = r.select(
        "src", "dst", F.col("type").alias("edge_type"), F.lit(0).cast("long").alias("rank"), F.col("confidence").cast("double"), F.lit(status).alias("status"), F.coalesce("evidence_id", F.lit("")).alias("evidence_ids"),
        F.coalesce(F.to_json("attributes"), F.lit("{}")).alias("props"), F.coalesce("label", F.lit("")).alias("relationship_type"),
    )
    rest = ["confidence", "status", "evidence_ids", "props", "relationship_type"]
    last = r.groupBy(*graph_store.EDGE_KEY).agg(F.max_by(F.struct(*rest), F.struct("evidence_ids", "confidence", "props", "relationship_type")).alias("_r"))
    return last.select(*graph_store.EDGE_KEY, "_r.*")


def upsert_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows: of one key, a value that new lacks (null) stays as it was."""
    rest = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in rest if c in new.columns])
    return old.join(n, keys, "full").select(*keys, *[F.coalesce(f"_{c}", c).alias(c) if c in new.columns else F.col(c) for c in rest])


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert_rows(old, new, graph_store.EDGE_KEY)


def store_resolved(vertices: DataFrame, records: DataFrame, resolved: DataFrame) -> DataFrame:
    """vertices(vid, tag, label, props map) with records(record, tag, label, props map) as resolve_records decided: a merge sets an entity's properties, the rest are new vertices.

    What waits for a review isn't stored. A new vertex's id is the record's; several records
    merged into one entity set its properties in the order of their ids.
    """
    r = records.join(resolved.where("action <> 'review'").select("record", "action", "id"), "record")
    new = r.where("action = 'create'").select(F.col("record").cast("string").alias("vid"), "tag", "label", "props")
    each = r.where("action = 'merge'").select(F.col("id").alias("vid"), "record", F.explode("props").alias("k", "v")).where("v IS NOT NULL")
    last = each.groupBy("vid", "k").agg(F.max_by("v", "record").alias("v")).groupBy("vid").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("props"))
    kept = graph_store.upsert_props(vertices.select("vid", "props"), last.join(vertices.select("vid"), "vid", "left_semi"), ["vid"])
    return vertices.drop("props").join(kept, "vid").select("vid", "tag", "label", "props").unionByName(new)
