"""Substring search by stored postings of three characters each.

    {name}_texts      vid, tag, label, name (what is searched, in lower case), by vid
    {name}_postings   gram, vid: which names hold a run of three characters, by gram
    {name}_counts     gram, n: how many do, by gram

A search looks up how common its runs are, intersects the postings of the rarest, and looks at
the names that are left; only buckets of these runs and names are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.lineage import cut, scratch
from graphloom.sinks.adjacency import looked_up

#: Length of a run; runs of a search whose postings are read; shares that a bucket of postings is written in.
RUN, RAREST, SHARES = 3, 4, 4
_KEYS = {"texts": "vid", "postings": "gram", "counts": "gram"}


@dataclass(frozen=True)
class SearchIndex:
    texts: DataFrame
    postings: DataFrame
    counts: DataFrame

    def candidates(self, text: str) -> DataFrame | None:
        """vid of names that hold the rarest runs of a text in lower case; None if it is too short to have one."""
        runs = sorted({text[i : i + RUN] for i in range(len(text) - RUN + 1)})
        if not runs:
            return None
        known = self.counts.where(F.col("gram").isin(runs)).collect()  # a row for each run
        if len(known) < len(runs):
            return self.postings.where("false").select("vid")
        rarest = [r.gram for r in sorted(known, key=lambda r: (r.n, r.gram))[:RAREST]]
        found = self.postings.where(F.col("gram").isin(rarest)).groupBy("vid").agg(F.count("*").alias("n"))
        return found.where(F.col("n") == len(rarest)).select("vid")

    def search(self, text: str, tags: list[str] | None = None, limit: int | None = 50) -> DataFrame:
        """vid, tag, label of vertices whose label (else vid) holds the text, whatever its case, by vid: what PropertyGraph.search finds.

        Texts of fewer than three characters are looked for in all names.
        """
        asked = text.strip().lower()
        found = self.candidates(asked)
        near = self.texts if found is None else looked_up(self.texts, "vid", cut(found))
        near = near.where(F.col("name").contains(asked))
        near = near.where(F.col("tag").isin(tags)) if tags else near.where("tag <> 'field_value'")
        near = near.select("vid", "tag", "label").orderBy("vid")
        return near if limit is None else near.limit(limit)


def store(vertices: DataFrame, name: str, path: str | None = None, buckets: int | None = None) -> SearchIndex:
    """Write the index of vertices(vid, tag, label) under a name of the catalog; tables of that name are replaced.

    A run that many names hold is written by several tasks, as shares of its bucket.
    """
    spark = vertices.sparkSession
    path = (path or scratch(spark, f"search-{name}")).rstrip("/")
    buckets = buckets or max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    label = F.coalesce(F.when(F.trim("label") != "", F.col("label")), F.col("vid"))
    texts = cut(vertices.select("vid", "tag", "label", F.lower(label).alias("name")))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - (RUN - 1)), lambda i: F.substring(F.col("name"), i, F.lit(RUN))))
    postings = cut(texts.where(F.length("name") >= RUN).select(F.explode(runs).alias("gram"), "vid").distinct())
    counts = postings.groupBy("gram").agg(F.count("*").alias("n"))
    bucket, share = F.pmod(F.hash("gram"), F.lit(buckets)), F.pmod(F.xxhash64("vid"), F.lit(SHARES))  # Spark's own number of a bucket
    tables = {"texts": texts.repartition(buckets, "vid"), "postings": postings.repartition(buckets * SHARES, bucket, share), "counts": counts.repartition(buckets, "gram")}
    for kind, df in tables.items():
        df.write.format("parquet").mode("overwrite").bucketBy(buckets, _KEYS[kind]).sortBy(_KEYS[kind]).option("path", f"{path}/{kind}").saveAsTable(f"{name}_{kind}")
    return opened(spark, name)


def opened(spark: SparkSession, name: str) -> SearchIndex:
    return SearchIndex(*(spark.table(f"{name}_{kind}") for kind in _KEYS))
