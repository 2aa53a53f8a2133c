"""Writes to a graph's tables as DataFrame transformations: old rows and changes in, new rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from graphloom.functions import text as T

VERTEX_KEY, EDGE_KEY = ["vid", "tag"], ["src", "dst", "edge_type", "rank"]


def insert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """New rows replace old ones of the same key whole; of new rows with one key, the greatest `order` stays, without one the greatest row."""
    if set(old.columns) - {order} != set(new.columns) - {order}:
        raise ValueError(f"columns differ: {sorted(old.columns)} and {sorted(new.columns)}")
    names = [c for c in new.columns if c not in keys and c != order]
    plain = [F.to_json(c) if isinstance(new.schema[c].dataType, MapType) else F.col(c) for c in names]  # maps have no order
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*names), F.col(order) if order else F.struct(*plain)).alias("_r")).select(*keys, "_r.*") if names else new.select(*keys).distinct()
    return old.drop(order).join(last, keys, "left_anti").unionByName(last) if order else old.join(last, keys, "left_anti").unionByName(last)


def upsert_props(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Properties of new rows are set one by one; others stay. props is a map; new holds a key once."""
    o, n = old.select(*keys, F.col("props").alias("_o")), new.select(*keys, F.col("props").alias("_n"))
    empty = F.expr("map()").cast("map<string,string>")
    o_, n_ = F.coalesce("_o", empty), F.coalesce("_n", empty)
    kept = F.map_filter(o_, lambda k, _: ~F.array_contains(F.map_keys(n_), k))
    return o.join(n, keys, "full").select(*keys, F.map_concat(kept, n_).alias("props"))


def delete_vertices(vertices: DataFrame, edges: DataFrame, vids: DataFrame, with_edges: bool = False) -> tuple[DataFrame, DataFrame]:
    v = vertices.join(vids.select("vid"), "vid", "left_anti")
    if not with_edges:
        return v, edges
    for end in ("src", "dst"):
        edges = edges.join(vids.select(F.col("vid").alias(end)), end, "left_anti")
    return v, edges


def delete_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys.select(*EDGE_KEY), EDGE_KEY, "left_anti")


def first_occurrences(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, with copies(count of the key's later rows)."""
    names = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*names), F.col(order)).alias("_r"), (F.count("*") - 1).alias("copies"))
    return best.select(*keys, "_r.*", "copies")


def field_values(props: Column) -> Column:
    """Sorted distinct (field_key, value) of a map's eligible values; nested values, as JSON text, are left out."""
    each = F.transform(F.map_entries(props), lambda e: F.struct(e["key"].alias("field_key"), T.normalize_value(e["value"]).alias("value"), e["value"].rlike(r"^\s*[\[{]").alias("nested")))
    kept = F.filter(each, lambda e: F.coalesce(~e["nested"] & T.is_eligible(e["field_key"], e["value"]), F.lit(False)))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda e: F.struct(e["field_key"].alias("field_key"), e["value"].alias("value")))))


def field_value_index(owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Value vertices and HAS_FIELD_VALUE edges of owners(owner, props map; document_id, document_type if known).

    One vertex a value; one edge an owner, value, key and document. Edges of one owner and
    value are told apart by rank, so no key of a value gets lost.
    """
    also = [F.col(c) if c in owners.columns else F.lit("").alias(c) for c in ("document_id", "document_type")]
    pairs = owners.select("owner", *also, F.explode(field_values(F.col("props"))).alias("_f")).select("owner", "_f.*", "document_id", "document_type").distinct()
    v = pairs.select("value").distinct().select(T.value_vid(F.col("value")).alias("vid"), F.lit("field_value").alias("tag"), F.col("value").alias("label"))
    rank = F.pmod(F.xxhash64("field_key", "document_id"), F.lit(1 << 62))
    e = pairs.select(F.col("owner").alias("src"), T.value_vid(F.col("value")).alias("dst"), F.lit("HAS_FIELD_VALUE").alias("edge_type"), rank.alias("rank"), "field_key", "document_id", "document_type")
    return v, e


def reindexed(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The value index anew from stored persons and the documents that they hold (HAS_DOCUMENT): same input, same index.

    vertices(vid, tag, props map), edges(src, dst, edge_type).
    """
    own = vertices.where("tag = 'person'").select(F.col("vid").alias("owner"), F.lit("").alias("document_id"), F.lit("").alias("document_type"), "props")
    held = edges.where("edge_type = 'HAS_DOCUMENT'").select("src", "dst").distinct().join(own.select(F.col("owner").alias("src")), "src", "left_semi")
    documents = vertices.where("tag = 'document'").select(F.col("vid").alias("dst"), "props")
    theirs = held.join(documents, "dst").select(F.col("src").alias("owner"), F.col("dst").alias("document_id"), F.coalesce(F.col("props")["document_type"], F.lit("document")).alias("document_type"), "props")
    return field_value_index(own.unionByName(theirs))


def remap(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """A merge carried out: ends follow mapping(old, new); loops it makes and repeated edges go."""
    for end in ("src", "dst"):
        m = mapping.select(F.col("old").alias(end), F.col("new").alias("_new"))
        edges = edges.join(m, end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
    return edges.where("src <> dst").dropDuplicates(EDGE_KEY)
