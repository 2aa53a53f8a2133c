"""Graphs as catalog databases, with the checks their rows must pass."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from graphloom.schema import EDGE, VERTEX
from graphloom.sinks import schemas

_PROFILED = {"int": LongType(), "float": DoubleType(), "bool": BooleanType(), "string": StringType()}

# The one property that each tag must have.
REQUIRED = {
    "person": "full_name", "address": "full_address", "bank_account": "account_number", "company": "name", "country": "code", "crypto_wallet": "address", "document": "title", "domain": "domain_name",
    "email": "address", "ip_address": "ip", "phone": "number", "sanction_entry": "sanction_list", "transaction": "amount", "watchlist_entry": "watchlist_name", "website": "url",
}
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def checked(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def create_graph(spark: SparkSession, name: str, exist_ok: bool = True) -> None:
    spark.sql(f"CREATE DATABASE {'IF NOT EXISTS ' if exist_ok else ''}{checked(name)}")


def drop_graph(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS {checked(name)} CASCADE")


def graphs(spark: SparkSession) -> list[str]:
    return sorted(d.name for d in spark.catalog.listDatabases())


def save(spark: SparkSession, name: str, vertices: DataFrame, edges: DataFrame) -> None:
    """Tables partitioned by tag and edge type, so a filter on either reads only its folders."""
    vertices.select(*VERTEX.names).write.mode("overwrite").partitionBy("tag").saveAsTable(f"{checked(name)}.vertices")
    edges.select(*EDGE.names).write.mode("overwrite").partitionBy("edge_type").saveAsTable(f"{checked(name)}.edges")


def load(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    return spark.table(f"{checked(name)}.vertices"), spark.table(f"{checked(name)}.edges")


def describe(spark: SparkSession, name: str) -> dict[str, list[str]]:
    v, e = load(spark, name)
    return {"tags": sorted(r[0] for r in v.select("tag").distinct().collect()), "edge_types": sorted(r[0] for r in e.select("edge_type").distinct().collect())}


# ---- typed tables of a graph: tag_<tag> and edge_<type>


def _table(name: str, kind: str, what: str) -> str:
    return f"{checked(name)}.{kind}_{checked(what)}".lower()


def _create(spark: SparkSession, table: str, schema: StructType) -> None:
    """The table if it isn't there; SchemaError if it is there with other columns."""
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema)
        defaults = ", ".join(f"'default.{f.name}' = '{f.metadata['default']}'" for f in schema if "default" in (f.metadata or {}))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet{f' TBLPROPERTIES ({defaults})' if defaults else ''}")
    lacking = [f.name for f in schema if (f.name, f.dataType) not in {(g.name, g.dataType) for g in spark.table(table).schema}]
    if lacking:
        raise SchemaError(f"{table} lacks {', '.join(lacking)}")


class SchemaError(Exception):
    """A table, tag or edge type isn't what it should be."""


def create_tag(spark: SparkSession, name: str, tag: str, columns: str | StructType) -> None:
    _create(spark, _table(name, "tag", tag), columns if isinstance(columns, StructType) else schemas.tag_schema(columns))


def create_edge_type(spark: SparkSession, name: str, edge_type: str, columns: str | StructType) -> None:
    _create(spark, _table(name, "edge", edge_type), columns if isinstance(columns, StructType) else schemas.edge_schema(columns))


def ensure_tag(spark: SparkSession, name: str, tag: str, kinds: dict[str, str]) -> None:
    """The tag of an imported file: its columns by their profiled types, and a label."""
    create_tag(spark, name, tag, StructType([StructField("vid", StringType(), False), StructField("label", StringType()), *[StructField(checked(c), _PROFILED[k]) for c, k in kinds.items() if c not in ("vid", "label")]]))


def ensure_edge_type(spark: SparkSession, name: str, edge_type: str, kinds: dict[str, str]) -> None:
    ends = [StructField(c, StringType(), False) for c in ("src", "dst")] + [StructField("rank", LongType(), False), StructField("label", StringType())]
    create_edge_type(spark, name, edge_type, StructType([*ends, *[StructField(checked(c), _PROFILED[k]) for c, k in kinds.items() if c not in ("src", "dst", "rank", "label")]]))


def create_index(spark: SparkSession, name: str, kind: str, what: str, columns: list[str]) -> None:
    """Statistics of the columns of a tag's ("tag") or an edge type's ("edge") table, by which scans are planned; Parquet's own do the rest. Again: they are rebuilt."""
    table = _table(name, kind, what)
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR COLUMNS {', '.join(checked(c) for c in columns)}")
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('index.{'_'.join(columns)}' = '{','.join(columns)}')")


def _listed(spark: SparkSession, name: str, kind: str) -> list[str]:
    return sorted(t.name[len(kind) + 1 :] for t in spark.catalog.listTables(checked(name)) if t.name.startswith(f"{kind}_"))


def list_tags(spark: SparkSession, name: str) -> list[str]:
    return _listed(spark, name, "tag")


def list_edge_types(spark: SparkSession, name: str) -> list[str]:
    return [e.upper() for e in _listed(spark, name, "edge")]


def list_indexes(spark: SparkSession, name: str) -> list[str]:
    """Names of the indexes, each of a table and its columns."""
    found = []
    for kind in ("tag", "edge"):
        for what in _listed(spark, name, kind):
            found += [f"{kind}_{what}.{r.key.removeprefix('index.')}" for r in spark.sql(f"SHOW TBLPROPERTIES {_table(name, kind, what)}").collect() if r.key.startswith("index.")]
    return sorted(found)


def describe_tag(spark: SparkSession, name: str, tag: str) -> StructType:
    return _described(spark, _table(name, "tag", tag))


def describe_edge_type(spark: SparkSession, name: str, edge_type: str) -> StructType:
    return _described(spark, _table(name, "edge", edge_type))


def _described(spark: SparkSession, table: str) -> StructType:
    if not spark.catalog.tableExists(table):
        raise SchemaError(f"no table {table}")
    return spark.table(table).schema


def apply_schema(spark: SparkSession, name: str, tags: dict[str, str], edge_types: dict[str, str]) -> None:
    """The graph and its tables; a second time nothing but the check of their columns."""
    create_graph(spark, name)
    for tag, columns in tags.items():
        create_tag(spark, name, tag, columns)
    for kind, columns in edge_types.items():
        create_edge_type(spark, name, kind, columns)


def ensure_ingest_schema(spark: SparkSession, name: str) -> None:
    apply_schema(spark, name, schemas.INGEST_TAGS, schemas.INGEST_EDGES)


def execute(spark: SparkSession, name: str, sql: str, **args) -> DataFrame:
    """A query of the graph's tables in SQL; values go in as parameters (:name), never as text."""
    load_views(spark, name)
    return spark.sql(sql, args=args)


def load_views(spark: SparkSession, name: str) -> None:
    """The graph's vertices and edges, if saved, as views of these names."""
    for part in ("vertices", "edges"):
        if spark.catalog.tableExists(f"{checked(name)}.{part}"):
            spark.table(f"{name}.{part}").createOrReplaceTempView(part)


def edge_errors(edges: DataFrame) -> DataFrame:
    """src, dst, edge_type, error of rows that break a rule: both ends, and a RELATED_TO's confidence in 0..1."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    confidence = F.col("props")["confidence"].try_cast("double") if "props" in edges.columns else F.lit(None).cast("double")
    rules = [F.when(blank(F.col("src")), "src is required"), F.when(blank(F.col("dst")), "dst is required"), F.when((F.col("edge_type") == "RELATED_TO") & ~confidence.between(0, 1), "confidence must be in 0..1")]
    return edges.select("src", "dst", "edge_type", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("error"))


def vertex_errors(vertices: DataFrame) -> DataFrame:
    """vid, tag, error of rows that break a rule: an id, a label, confidence in 0..1, the tag's own property."""
    confidence = F.col("props")["confidence"].try_cast("double")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = [F.when(blank(F.col("vid")), "vid is required"), F.when(blank(F.col("label")), "label is required"), F.when(~confidence.between(0, 1), "confidence must be in 0..1")]
    for tag, name in REQUIRED.items():
        rules.append(F.when((F.col("tag") == tag) & blank(F.col("props")[name]), f"{name} is required"))
    return vertices.select("vid", "tag", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("error"))
