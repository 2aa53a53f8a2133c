"""Scans, neighbourhoods and paths over a property graph of two DataFrames."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.lineage import cut
from graphloom.sinks.catalog import SchemaError


#: Vertices of a frontier that are asked for by name.
NAMED = 500


@dataclass(frozen=True)
class PropertyGraph:
    """vertices(vid, tag, label, ...) and edges(src, dst, edge_type, rank, ...)."""

    vertices: DataFrame
    edges: DataFrame

    def undirected(self) -> DataFrame:
        """Edges from each end: a, b, edge_type, rank, direction; equi-joins on a need no OR."""
        e = self.edges
        out = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "edge_type", "rank", F.lit("out").alias("direction"))
        return out.unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"), "edge_type", "rank", F.lit("in").alias("direction")))

    def _from(self, direction: str, edge_type: str | None) -> DataFrame:
        e = self.undirected()
        e = e if direction == "both" else e.where(F.col("direction") == direction)
        return e if edge_type is None else e.where(F.col("edge_type") == edge_type)

    def scan_vertices(self, tag: str, limit: int | None = None) -> DataFrame:
        """A tag's vertices by vid; limited before the other tags are joined."""
        ids = self.vertices.where(F.col("tag") == tag).select("vid").distinct().orderBy("vid")
        return self.vertices.join(ids.limit(limit) if limit is not None else ids, "vid", "left_semi")

    def get(self, vids: DataFrame) -> DataFrame:
        """The rows of vids(vid) that exist, of all their tags."""
        return self.vertices.join(vids.select("vid"), "vid", "left_semi")

    def vertex(self, vid: str, tag: str | None = None, registered: Collection[str] | None = None) -> DataFrame:
        """The rows of one vertex, of a tag or all. SchemaError for a tag that isn't registered, if it is said which are."""
        if tag is not None and registered is not None and tag not in registered:
            raise SchemaError(f"unknown tag: {tag}")
        v = self.vertices.where(F.col("vid") == vid)
        return v if tag is None else v.where(F.col("tag") == tag)

    def exists(self, vid: str, tag: str | None = None) -> bool:
        return not self.vertex(vid, tag).isEmpty()

    def edge(self, edge_type: str, src: str, dst: str, rank: int = 0) -> DataFrame:
        e = self.edges.where((F.col("edge_type") == edge_type) & (F.col("src") == src) & (F.col("dst") == dst))
        return e.where(F.col("rank") == rank)

    def edge_exists(self, edge_type: str, src: str, dst: str, rank: int = 0) -> bool:
        return not self.edge(edge_type, src, dst, rank).isEmpty()

    def existing_edges(self, keys: DataFrame) -> DataFrame:
        """Those of keys(edge_type, src, dst, rank) that exist."""
        key = ["edge_type", "src", "dst", "rank"]
        return keys.select(*key).distinct().join(self.edges.select(*key), key, "left_semi")

    def find_by(self, tag: str, field: str, value: str) -> str | None:
        """The least vid of a tag whose column, or property, equals a value."""
        column = F.col(field) if field in self.vertices.columns else F.col("props")[field]
        return self.vertices.where((F.col("tag") == tag) & (column == value)).agg(F.min("vid")).first()[0]

    def candidates(self, tag: str, fields: tuple[str, ...] = ("label", "date_of_birth", "nationality")) -> DataFrame:
        """vid and the fields of all vertices of a tag: what names are compared with."""
        return self.vertices.where(F.col("tag") == tag).select("vid", *[F.col(f) if f in self.vertices.columns else F.col("props")[f].alias(f) for f in fields])

    def one_step(self, vids: DataFrame, edge_type: str) -> DataFrame:
        """vid, other: where edges of a type lead from each of vids(vid)."""
        return self.edges.where(F.col("edge_type") == edge_type).join(vids.select(F.col("vid").alias("src")), "src", "left_semi").select(F.col("src").alias("vid"), F.col("dst").alias("other")).distinct()

    def nodes(self) -> DataFrame:
        """vid, tags, label (the vid where there is none), props (later tags by name prevail): one row a vertex."""
        v = self.vertices if "props" in self.vertices.columns else self.vertices.withColumn("props", F.expr("map()").cast("map<string,string>"))
        bags = v.select("vid", "tag", F.explode("props").alias("k", "v")).groupBy("vid", "k").agg(F.max_by("v", "tag").alias("v")).groupBy("vid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("props"))
        one = v.groupBy("vid").agg(F.sort_array(F.collect_set("tag")).alias("tags"), F.min(F.when(F.trim("label") != "", F.col("label"))).alias("_l"))
        return one.join(bags, "vid", "left").select("vid", "tags", F.coalesce("_l", "vid").alias("label"), F.coalesce("props", F.expr("map()").cast("map<string,string>")).alias("props"))

    def schema(self) -> dict[str, list[str]]:
        return {"tags": sorted(r[0] for r in self.vertices.select("tag").distinct().collect()), "edge_types": sorted(r[0] for r in self.edges.select("edge_type").distinct().collect())}

    def neighbors(self, vid: str, edge_type: str | None = None, direction: str = "out", limit: int | None = None) -> DataFrame:
        """Neighbours that have a vertex row: all, or the first `limit` by vid."""
        ids = self._from(direction, edge_type).where(F.col("a") == vid).select(F.col("b").alias("vid")).distinct()
        if limit is not None:
            ids = ids.join(self.vertices.select("vid"), "vid", "left_semi").orderBy("vid").limit(limit)
        return self.get(ids)

    def neighbors_batch(self, vids: DataFrame, edge_types: list[str] | None = None, direction: str = "both") -> DataFrame:
        """Distinct edges that touch the frontier vids(vid)."""
        e = self._from(direction, None)
        e = e.where(F.col("edge_type").isin(edge_types)) if edge_types else e
        hit = e.join(vids.select(F.col("vid").alias("a")), "a", "left_semi")
        out = F.col("direction") == "out"
        return hit.select(F.when(out, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(out, F.col("b")).otherwise(F.col("a")).alias("dst"), "edge_type", "rank").distinct()

    def degrees(self) -> DataFrame:
        """Distinct neighbours (dangling ones too) of each vertex by edge type and direction."""
        return self.undirected().groupBy(F.col("a").alias("vid"), "edge_type", "direction").agg(F.countDistinct("b").alias("n"))

    def overview(self, tags: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
        """An equal number of each tag's first vertices, and the edges between them."""
        each = -(-limit // len(tags))
        first = self.vertices.where(F.col("tag").isin(tags)).withColumn("_n", F.row_number().over(Window.partitionBy("tag").orderBy("vid"))).where(F.col("_n") <= each)
        kept = first.orderBy("_n", "tag").limit(limit).drop("_n")
        ids = kept.select("vid").distinct()
        e = self.edges.join(ids.withColumnRenamed("vid", "src"), "src", "left_semi").join(ids.withColumnRenamed("vid", "dst"), "dst", "left_semi")
        return kept, e.select("src", "dst", "edge_type").distinct()

    def search(self, text: str, tags: list[str] | None = None, limit: int | None = 50) -> DataFrame:
        """Vertices whose label (else vid) holds the text, whatever its case."""
        v = self.vertices.where(F.col("tag").isin(tags)) if tags else self.vertices.where("tag <> 'field_value'")
        name = F.coalesce(F.when(F.trim("label") != "", F.col("label")), F.col("vid"))
        v = v.where(F.lower(name).contains(text.strip().lower())).orderBy("vid")
        return v if limit is None else v.limit(limit)

    def k_hop(self, roots: DataFrame, depth: int, direction: str = "both", edge_type: str | None = None) -> DataFrame:
        """vid and least distance of what roots(vid) reach in depth steps. Each level is checkpointed."""
        e = self._from(direction, edge_type).select("a", "b").distinct()
        seen = roots.select("vid", F.lit(0).alias("depth")).distinct()
        frontier = seen
        for d in range(1, depth + 1):
            new = e.join(frontier.select(F.col("vid").alias("a")), "a", "left_semi").select(F.col("b").alias("vid")).distinct()
            frontier = cut(new.join(seen, "vid", "left_anti").select("vid", F.lit(d).alias("depth")))
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
        return seen

    def _step(self, frontier: DataFrame, n: int, direction: str, edge_type: str | None) -> DataFrame:
        """Edges (a, b) that leave the n vertices of frontier(vid) in a direction; few are asked for by name, which the scan can look at."""
        start, end = ("src", "dst") if direction == "out" else ("dst", "src")
        e = self.edges if edge_type is None else self.edges.where(F.col("edge_type") == edge_type)
        if n <= NAMED:
            e = e.where(F.col(start).isin([r.vid for r in frontier.collect()]))
        else:
            e = e.join(frontier.select(F.col("vid").alias(start)), start, "left_semi")
        return e.select(F.col(start).alias("a"), F.col(end).alias("b")).where("b IS NOT NULL").distinct()

    def shortest_paths(self, src: str, dst: str, max_steps: int = 5, edge_type: str | None = None) -> DataFrame:
        """All shortest directed paths as arrays of vids; src alone if it is dst.

        Both ends grow, the one with the smaller frontier first, until their last levels
        meet: a path has then one vertex in each level, and is rebuilt from the meeting ones.
        """
        spark = self.vertices.sparkSession
        sides = {"out": [spark.createDataFrame([(src,)], "vid string")], "in": [spark.createDataFrame([(dst,)], "vid string")]}
        crossed: dict[str, list[DataFrame]] = {"out": [], "in": []}
        size = {"out": 1, "in": 1}
        met = sides["out"][0].join(sides["in"][0], "vid", "left_semi")
        while met.isEmpty():
            if len(crossed["out"]) + len(crossed["in"]) >= max_steps:
                return spark.createDataFrame([], "path array<string>")
            way = "out" if size["out"] <= size["in"] else "in"
            levels = sides[way]
            step = cut(self._step(levels[-1], size[way], way, edge_type))
            new = step.select(F.col("b").alias("vid")).distinct()
            for level in levels:
                new = new.join(level, "vid", "left_anti")
            new = cut(new)
            size[way] = new.count()
            if not size[way]:
                return spark.createDataFrame([], "path array<string>")
            levels.append(new)
            crossed[way].append(step)
            met = sides["out"][-1].join(sides["in"][-1], "vid", "left_semi")
        paths = met.select(F.col("vid").alias("first"), F.col("vid").alias("last"), F.array("vid").alias("path"))
        for step in reversed(crossed["out"]):
            paths = paths.join(step, F.col("first") == F.col("b")).select(F.col("a").alias("first"), "last", F.concat(F.array("a"), "path").alias("path"))
        for step in reversed(crossed["in"]):
            paths = paths.join(step, F.col("last") == F.col("b")).select("first", F.col("a").alias("last"), F.concat("path", F.array("a")).alias("path"))
        return paths.select("path")

    def expand(self, root: str, depth: int = 1) -> tuple[DataFrame, DataFrame]:
        """(vid, depth) around root, itself included though unknown, and the edges that the steps crossed."""
        near = self.k_hop(self.vertices.sparkSession.createDataFrame([(root,)], "vid string"), depth)
        inner = near.where(F.col("depth") < depth).select("vid")
        return near, self.neighbors_batch(inner)

    def neighbors_with_edges(self, vid: str, edge_type: str | None = None, direction: str = "both", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Neighbours (the first `limit` by vid) and the edges among root and them."""
        ids = self.neighbors(vid, edge_type, direction).select("vid").distinct()
        ids = ids if limit is None else ids.orderBy("vid").limit(limit)
        root = self.vertices.sparkSession.createDataFrame([(vid,)], "vid string")
        e = self.neighbors_batch(root, [edge_type] if edge_type else None, direction)
        ends = ids.unionByName(root)
        for end in ("src", "dst"):
            e = e.join(ends.withColumnRenamed("vid", end), end, "left_semi")
        return self.get(ids), e

    def walks(self, root: str, depth: int = 2, limit: int | None = 60) -> DataFrame:
        """Ends of outgoing walks of 1 to depth steps: step, vid, edge_type, a row a walk; the first `limit` in this order.

        Walks that end alike are counted together, level by level, and drawn apart at the end
        only, as far as the limit goes: a hub costs its edges, not its walks.
        """
        e = self.edges.select("src", "dst", "edge_type")
        at = cut(e.where(F.col("src") == root).groupBy(F.col("dst").alias("vid"), "edge_type").agg(F.count("*").alias("n")))
        every = at.select(F.lit(1).alias("step"), "vid", "edge_type", "n")
        for d in range(2, depth + 1):
            here = at.groupBy(F.col("vid").alias("src")).agg(F.sum("n").alias("_n"))
            at = cut(here.join(e, "src").groupBy(F.col("dst").alias("vid"), "edge_type").agg(F.sum("_n").alias("n")))
            every = every.unionByName(at.select(F.lit(d).alias("step"), "vid", "edge_type", "n"))
        if limit is not None:  # at most `limit` kinds of walk, each at most `limit` times
            every = every.orderBy("step", "vid", "edge_type").limit(limit).withColumn("n", F.least("n", F.lit(limit)))
        every = every.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n", "_i")
        return every if limit is None else every.orderBy("step", "vid", "edge_type").limit(limit)

    def context(self, vid: str) -> dict:
        """One entity's properties, its neighbours (vid, tags, label, props) and its edges' types with their numbers."""
        hop = self.undirected().where(F.col("a") == vid)
        nodes = PropertyGraph(self.get(hop.select(F.col("b").alias("vid")).distinct().unionByName(self.vertices.sparkSession.createDataFrame([(vid,)], "vid string"))), self.edges).nodes()
        own = nodes.where(F.col("vid") == vid).first()
        return {"properties": own.props if own else {}, "neighbours": nodes.where(F.col("vid") != vid), "edge_types": {r.edge_type: r["count"] for r in hop.groupBy("edge_type").count().collect()}}

    def risk_context(self, vid: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
        """What expand gives, two steps around an entity."""
        return self.expand(vid, depth)

    def entity_context(self) -> DataFrame:
        """vid, edge_type, n, neighbours: incident edges of each type with multiplicity, and distinct neighbours."""
        return self.undirected().groupBy(F.col("a").alias("vid"), "edge_type").agg(F.count("*").alias("n"), F.countDistinct("b").alias("neighbours"))

    def listed(self, tags: tuple[str, ...] = ("sanction_entry", "watchlist_entry")) -> DataFrame:
        """vid, listing: entities beside a listing, listings themselves left out."""
        flags = self.vertices.where(F.col("tag").isin(*tags)).select("vid").distinct()
        hit = self.undirected().join(flags.withColumnRenamed("vid", "a"), "a", "left_semi").select(F.col("b").alias("vid"), F.col("a").alias("listing")).distinct()
        return hit.join(flags, "vid", "left_anti").join(self.vertices.select("vid").distinct(), "vid", "left_semi")

    def visible(self, hidden_tags: list[str], hidden_types: list[str]) -> tuple[DataFrame, DataFrame]:
        """What stays when tags and edge types are hidden: a vertex goes with any hidden tag, an edge with either end."""
        gone = self.vertices.where(F.col("tag").isin(hidden_tags)).select("vid").distinct()
        e = self.edges.where(~F.col("edge_type").isin(hidden_types)) if hidden_types else self.edges
        for end in ("src", "dst"):
            e = e.join(gone.withColumnRenamed("vid", end), end, "left_anti")
        return self.vertices.join(gone, "vid", "left_anti"), e
