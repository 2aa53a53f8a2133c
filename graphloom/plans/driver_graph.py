"""The driver's tables as a property graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import PropertyGraph
from graphloom.operators.network import Sources
from graphloom.sinks import adjacency, graph_store, search_index

#: Names of what a session has stored: by kind and the files it comes from.
_stored: dict[tuple, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _once(spark: SparkSession, sf_dir: str, kind: str, tables: tuple[str, ...], write: Callable[[str], object]) -> str:
    """The name under which a session has written something of the tables' files as they are now: written when first asked for."""
    files = []
    for name in tables:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
        files += sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found)
    key = (spark.sparkContext.applicationId, kind, *files)
    if key not in _stored:
        name = f"graphloom_{kind}_{len(_stored)}"
        write(name)
        _stored[key] = name
    return _stored[key]


def stored(spark: SparkSession, sf_dir: str, kind: str, made: Callable[[], Sources]) -> adjacency.Stored:
    """The adjacency of a kind, stored when a session first asks for it, then opened."""
    return adjacency.opened(spark, _once(spark, sf_dir, kind, ("customer", "orders", "lineitem"), lambda name: adjacency.store(made(), name)))


def searched(spark: SparkSession, sf_dir: str) -> search_index.SearchIndex:
    """The search index of `hierarchy`, stored when a session first asks for it."""
    tables = ("region", "nation", "supplier", "customer")
    return search_index.opened(spark, _once(spark, sf_dir, "search", tables, lambda name: search_index.store(hierarchy(spark, sf_dir).vertices, name)))


def _id(prefix: str, *columns: str):
    return F.concat(F.lit(prefix), F.concat_ws(":", *[F.col(c).cast("string") for c in columns]))


def hierarchy(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """region <- nation <- supplier and customer; edges LOCATED_AT point up."""
    t = lambda n: table(spark, sf_dir, n)
    v = t("region").select(_id("r:", "r_regionkey").alias("vid"), F.lit("region").alias("tag"), F.col("r_name").alias("label"))
    v = v.unionByName(t("nation").select(_id("n:", "n_nationkey").alias("vid"), F.lit("nation").alias("tag"), F.col("n_name").alias("label")))
    v = v.unionByName(t("supplier").select(_id("s:", "s_suppkey").alias("vid"), F.lit("supplier").alias("tag"), F.col("s_name").alias("label")))
    v = v.unionByName(t("customer").select(_id("c:", "c_custkey").alias("vid"), F.lit("person").alias("tag"), F.col("c_name").alias("label")))
    e = t("nation").select(_id("n:", "n_nationkey").alias("src"), _id("r:", "n_regionkey").alias("dst"), F.lit("PART_OF").alias("edge_type"))
    e = e.unionByName(t("supplier").select(_id("s:", "s_suppkey").alias("src"), _id("n:", "s_nationkey").alias("dst"), F.lit("LOCATED_AT").alias("edge_type")))
    e = e.unionByName(t("customer").select(_id("c:", "c_custkey").alias("src"), _id("n:", "c_nationkey").alias("dst"), F.lit("CITIZEN_OF").alias("edge_type")))
    return PropertyGraph(v, e.withColumn("rank", F.lit(0).cast("long")))


def offer_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """connector (a supplier's offer of a part, tag company), tag, person."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(_id("o:", "l_partkey", "l_suppkey").alias("connector"), F.lit("company").alias("tag"), _id("c:", "o_custkey").alias("person")).distinct()


def part_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(_id("p:", "l_partkey").alias("connector"), F.lit("part").alias("tag"), _id("c:", "o_custkey").alias("person")).distinct()


def direct_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RELATED_TO between the customers of consecutive orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("next"))
    return o.join(n, "o_orderkey").select(_id("c:", "o_custkey").alias("src"), _id("c:", "next").alias("dst"), F.col("o_orderkey").alias("rank"))


def bridge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAYS between the offers of one order with adjacent line numbers."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _id("o:", "l_partkey", "l_suppkey").alias("src"))
    n = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("src").alias("dst"))
    return li.join(n, ["l_orderkey", "l_linenumber"]).select("src", "dst").where("src <> dst").distinct()


def value_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """connector (a date), person, field_key: dates of orders and shipments of a person."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    a = o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("connector"), _id("c:", "o_custkey").alias("person"), F.lit("order_date").alias("field_key"))
    b = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("connector"), _id("c:", "o_custkey").alias("person"), F.lit("ship_date").alias("field_key"))
    return a.unionByName(b).distinct()


def field_graph(spark: SparkSession, sf_dir: str, direct: bool = False) -> PropertyGraph:
    """Customers and the days of their orders as field values: first shipment or order, with priority and status; orders' customers RELATED_TO the next ones if `direct`."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("kind"))
    li = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_shipdate")
    said = lambda day: F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), "kind")
    owner = _id("c:", "o_custkey").alias("owner")
    a = o.select(owner, F.create_map(F.lit("order_day"), said("o_orderdate")).alias("props"))
    b = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(owner, F.create_map(F.lit("ship_day"), said("l_shipdate")).alias("props"))
    values, held = graph_store.field_value_index(a.unionByName(b))
    persons = table(spark, sf_dir, "customer").select(_id("c:", "c_custkey").alias("vid"), F.lit("person").alias("tag"), F.col("c_name").alias("label"))
    edges = held.select("src", "dst", "edge_type", "rank", "field_key", "document_id")
    if direct:
        related = direct_edges(spark, sf_dir).select("src", "dst", F.lit("RELATED_TO").alias("edge_type"), "rank")
        edges = edges.unionByName(related, allowMissingColumns=True)
    return PropertyGraph(persons.unionByName(values.select("vid", "tag", "label")), edges)
