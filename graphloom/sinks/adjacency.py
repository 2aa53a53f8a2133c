"""A graph's adjacency as stored, bucketed tables: a person's network reads the buckets that it needs.

    {name}_members_by_person     what each person owns, with the connector's count of owners
    {name}_members_by_connector  the same rows by connector
    {name}_edges                 direct edges, from either end
    {name}_bridges               edges between connectors, from either end
    {name}_persons               who exists

Each is bucketed and sorted by what it is looked up by. A few keys are looked up as literals, so
that Spark reads their buckets alone, and of these the row groups that may hold them; many keys
are joined, and the stored side isn't exchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.lineage import scratch
from graphloom.operators.network import Sources

#: Keys that are looked up as literals; more are joined.
LITERALS = 500
_SIDES = {"members_by_person": "person", "members_by_connector": "connector", "edges": "vid", "bridges": "this", "persons": "vid"}


@dataclass(frozen=True)
class Stored(Sources):
    """Sources whose levels are looked up in stored tables."""

    name: str = ""
    by_connector: DataFrame | None = None

    def prepared(self) -> Stored:
        return self

    def held_by(self, persons: DataFrame) -> DataFrame:
        return looked_up(self.members, "person", persons)

    def holders(self, connectors: DataFrame) -> DataFrame:
        return looked_up(self.by_connector, "connector", connectors)

    def edges_at(self, persons: DataFrame) -> DataFrame:
        at = persons.withColumnRenamed("person", "vid")
        near = looked_up(self.direct, "vid", at)
        # From the far end only where the near end isn't among them: each edge once.
        into = near.where("vid <> src").join(persons.withColumnRenamed("person", "src"), "src", "left_anti")
        return near.where("vid = src").unionByName(into).select("src", "dst", "edge_type", "rank", "label")

    def bridges_at(self, connectors: DataFrame) -> DataFrame:
        near = looked_up(self.bridges, "this", connectors.withColumnRenamed("connector", "this"))
        return near.join(connectors.withColumnRenamed("connector", "other"), "other", "left_anti").select("this", "other", "edge_type", "said")


def looked_up(table: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of a stored table with the keys: by literals if these are few (that is looked at first), else by a join."""
    some = keys.select(key).distinct().limit(LITERALS + 1).collect()
    if len(some) <= LITERALS:
        return table.where(F.col(key).isin([r[0] for r in some]))
    return table.join(keys.select(key), key, "left_semi")


def store(s: Sources, name: str, path: str | None = None, buckets: int | None = None) -> Stored:
    """Write the tables of s, prepared, under a name of the catalog; path: a folder that all executors can write (scratch without it).

    Written once for a graph, whatever is asked of it later. buckets: the shuffle partitions, 32 at
    least; a bucket is one file, written by the task that the shuffle gives it to. Tables of that name are replaced.
    """
    spark = s.direct.sparkSession
    path = (path or scratch(spark, f"adjacency-{name}")).rstrip("/")
    buckets = buckets or max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    p = s.prepared()
    ends = p.direct.where("src <> dst")
    bridges = p.bridges if p.bridges is not None else spark.createDataFrame([], "src string, dst string, edge_type string, rank long, label string")
    bridges = bridges.where("src <> dst")
    tables = {
        "members_by_person": p.members,
        "members_by_connector": p.members,
        "edges": ends.withColumn("vid", F.col("src")).unionByName(ends.withColumn("vid", F.col("dst"))),
        "bridges": bridges.select(F.col("src").alias("this"), F.col("dst").alias("other"), "edge_type", F.col("label").alias("said")).unionByName(bridges.select(F.col("dst").alias("this"), F.col("src").alias("other"), "edge_type", F.col("label").alias("said"))),
        "persons": p.persons.select("vid"),
    }
    for kind, df in tables.items():
        key = _SIDES[kind]
        df.repartition(buckets, key).write.format("parquet").mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", f"{path}/{kind}").saveAsTable(f"{name}_{kind}")
    return opened(spark, name, bridges=p.bridges is not None)


def opened(spark: SparkSession, name: str, bridges: bool = True) -> Stored:
    """What `store` wrote under the name."""
    t = {kind: spark.table(f"{name}_{kind}") for kind in _SIDES}
    return Stored(t["members_by_person"], t["edges"], t["bridges"] if bridges else None, t["persons"], t["members_by_person"], name, t["members_by_connector"])
