"""CSV files as vertices and edges: structure from headers and profiles, typed values, a report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_
from os.path import commonprefix

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import coerce
from graphloom.sinks.graph_store import first_occurrences
from graphloom.sources.csv_profile import numbered, profile, read_rows

# Header parts that tell the two ends of an edge, types, ids and labels.
PAIRS = (("source", "target"), ("src", "dst"), ("from", "to"), ("sender", "receiver"), ("start", "end"), ("node1", "node2"), ("entity1", "entity2"), ("person1", "person2"))
TYPE_HINTS = ("type", "relationship", "relation", "label", "edge_type", "category")
ID_HINTS = ("id", "name", "key", "uuid", "vid", "identifier")
LABEL_HINTS = ("name", "label", "title")
NEAR_UNIQUE, MIN_TAG = 0.98, 3


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    distinct_ratio: float


@dataclass(frozen=True)
class Structure:
    """A node table has an id; an edge list has two ends and perhaps a column of types."""

    tag: str
    properties: tuple[str, ...]
    id: str | None = None
    ends: tuple[str, str] | None = None
    type: str | None = None
    edge_type: str = ""


def _plain(text: str, fallback: str) -> str:
    s = "".join(c if c.isalnum() or c == "_" else " " for c in text)
    s = "_".join(s.split()).strip("_").lower() or fallback
    return f"_{s}" if s[0].isdigit() else s


#: What a header says of its column: (role, how the header must match, the words, weight). A pair's two
#: ends share a weight; the heavier rule wins, then the column further left.
RULES = (
    *(("source", "within", (a,), len(PAIRS) - k) for k, (a, _) in enumerate(PAIRS)),
    *(("target", "within", (b,), len(PAIRS) - k) for k, (_, b) in enumerate(PAIRS)),
    ("type", "within", TYPE_HINTS, 1),
    ("id", "whole", ID_HINTS, 1),
)


def assigned(columns: DataFrame) -> DataFrame:
    """source, target, type, id: the columns of each role in a table, one row. Roles that no column has are null.

    columns(i, column, distinct_ratio): place, header, share of distinct values. All rules are
    scored for all columns in one projection. A pair of ends needs one column for either end (a header
    that has both words is the source's); without a pair, ends are the two columns that vary most without telling
    rows apart; without these, the table has an id: a header that says so, or what varies most.
    """
    head = F.lower("column")
    rules = F.array(*[F.struct(F.lit(role).alias("role"), _matches(head, how, words).alias("fits"), F.lit(weight).alias("weight")) for role, how, words, weight in RULES])
    scored = columns.select("i", "column", "distinct_ratio", F.filter(rules, lambda r: r["fits"]).alias("rules"))
    weights = lambda role: F.transform(F.filter("rules", lambda r: r["role"] == role), lambda r: r["weight"])
    scored = scored.select("i", "column", "distinct_ratio", weights("source").alias("source"), weights("target").alias("target"), (F.size(weights("type")) > 0).alias("typed"), (F.size(weights("id")) > 0).alias("named"))
    # Ends by header: a weight that one column has as source and one other as target.
    sides = scored.select("i", "column", F.explode("source").alias("weight"), F.lit(True).alias("left")).unionByName(scored.select("i", "column", F.explode(F.array_except("target", "source")).alias("weight"), F.lit(False).alias("left")))
    one = lambda left: F.when(F.count_if(F.col("left") == left) == 1, F.max(F.when(F.col("left") == left, F.col("column"))))
    pairs = sides.groupBy("weight").agg(one(True).alias("source"), one(False).alias("target")).where("source IS NOT NULL AND target IS NOT NULL")
    by_name = pairs.agg(F.max_by(F.struct("source", "target"), "weight").alias("named_ends"))
    # Ends by variety.
    most = F.when(F.col("named"), F.col("distinct_ratio") <= 0.9).otherwise(F.col("distinct_ratio") < NEAR_UNIQUE)
    varied = scored.where((F.col("distinct_ratio") > 0) & most).agg(F.array_sort(F.collect_list(F.struct((-F.col("distinct_ratio")).alias("r"), "i", "column"))).alias("v"))
    rest = scored.agg(
        F.array_sort(F.collect_list(F.when(F.col("typed"), F.struct("i", "column")))).alias("types"),
        F.min(F.struct((~F.col("named")).alias("n"), F.when(~F.col("named"), -F.col("distinct_ratio")).alias("r"), F.col("i"), F.col("column"))).alias("key"),
    )
    found = by_name.withColumn("k", F.lit(1)).join(varied.withColumn("k", F.lit(1)), "k").join(rest.withColumn("k", F.lit(1)), "k")  # a row each
    ends = F.coalesce("named_ends", F.when(F.size("v") > 1, F.struct(F.col("v")[0]["column"].alias("source"), F.col("v")[1]["column"].alias("target"))))
    found = found.select(ends.alias("ends"), "types", "key")
    spare = F.filter("types", lambda t: ~t["column"].isin(F.col("ends.source"), F.col("ends.target")))
    return found.select("ends.source", "ends.target", F.when(F.col("ends").isNotNull(), F.get(spare, F.lit(0))["column"]).alias("type"), F.when(F.col("ends").isNull(), F.col("key.column")).alias("id"))


def _matches(head, how: str, words: tuple[str, ...]):
    return head.isin(*words) if how == "whole" else reduce(or_, (head.contains(w) for w in words))


def infer(spark: SparkSession, columns: list[Column], stem: str) -> Structure:
    """An edge list if two columns can be its ends, else a table of nodes. ValueError without columns."""
    if not columns:
        raise ValueError("a file without columns has no structure")
    table = spark.createDataFrame([(i, c.name, float(c.distinct_ratio)) for i, c in enumerate(columns)], "i int, column string, distinct_ratio double")
    role = assigned(table).first()
    names = [c.name for c in columns if c.name not in (role.source, role.target, role.type, role.id)]
    if role.id:
        return Structure(_plain(stem, "entity"), tuple(names), id=role.id)
    shared = commonprefix([role.source.lower(), role.target.lower()]).strip("_ ")
    tag = _plain(shared, "entity") if len(shared) >= MIN_TAG else "entity"
    return Structure(tag, tuple(names), ends=(role.source, role.target), type=role.type, edge_type=_plain(stem, "related_to").upper())


def label_column(columns: list[Column]) -> str | None:
    """A string column whose name hints at a label, else the first string column."""
    strings = [c.name for c in columns if c.type == "string"]
    return next((n for h in LABEL_HINTS for n in strings if h in n.lower()), strings[0] if strings else None)


def columns_of(rows: DataFrame) -> list[Column]:
    return [Column(r["column"], r["type"], r.distinct_ratio) for r in profile(rows).collect()]


def typed(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """Typed columns and _errors: names of the values that don't fit, which become null."""
    made, errors = [], []
    for c in columns:
        value, wrong = coerce(F.col(f"`{c.name}`"), c.type)
        made.append(value.alias(c.name))
        errors.append(F.when(wrong, F.lit(c.name)))
    return rows.select("_row", *made, F.filter(F.array(*errors), lambda x: x.isNotNull()).alias("_errors"))


@dataclass(frozen=True)
class Import:
    vertices: DataFrame  # vid, tag, label, props
    edges: DataFrame | None  # src, dst, edge_type, rank, props
    rows: DataFrame  # typed rows with _row and _errors
    structure: Structure

    def errors(self) -> DataFrame:
        """line, column of each value that doesn't fit; the header is line 1."""
        return self.rows.select((F.col("_row") + 1).alias("line"), F.explode("_errors").alias("column"))

    def report(self) -> dict[str, int]:
        n = self.rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum((F.size("_errors") > 0).cast("int")), F.lit(0)).alias("errors")).first()
        main = self.edges if self.edges is not None else self.vertices
        made = main.agg(F.count("*").alias("n"), F.coalesce(F.sum("copies"), F.lit(0)).alias("copies")).first()
        return {"rows": n.rows, "errors": n.errors, "created": made.n, "duplicates": made.copies}


def run(rows: DataFrame, stem: str, structure: Structure | None = None) -> Import:
    """Rows of strings as a graph. The first row of a key stays; `copies` counts the others. Rows without a key are left out.

    Rows are numbered by their place in the files, or by a column _row if they have one:
    give it for rows that don't come straight from files.
    """
    columns = columns_of(rows.drop("_row"))
    s = structure or infer(rows.sparkSession, columns, stem)
    t = typed(rows if "_row" in rows.columns else numbered(rows), columns)
    text = lambda n: F.col(f"`{n}`").cast("string")
    props = F.map_filter(F.create_map(*[x for n in s.properties for x in (F.lit(n), text(n))]), lambda _, v: v.isNotNull()) if s.properties else F.expr("map()").cast("map<string,string>")
    if s.id:
        label = label_column([c for c in columns if c.name in s.properties])
        v = t.where(F.trim(text(s.id)) != "").select("_row", text(s.id).alias("vid"), F.lit(s.tag).alias("tag"), F.coalesce(text(label), text(s.id)).alias("label") if label else text(s.id).alias("label"), props.alias("props"))
        return Import(first_occurrences(v, ["vid"], "_row").drop("_row"), None, t, s)
    src, dst = (text(n) for n in s.ends)
    kind = F.coalesce(F.upper(F.trim(F.regexp_replace(text(s.type), r"\W+", "_"))), F.lit(s.edge_type)) if s.type else F.lit(s.edge_type)
    e = t.where((F.trim(src) != "") & (F.trim(dst) != "")).select("_row", src.alias("src"), dst.alias("dst"), kind.alias("edge_type"), F.lit(0).cast("long").alias("rank"), props.alias("props"))
    e = first_occurrences(e, ["src", "dst", "edge_type", "rank"], "_row").drop("_row")
    v = e.select(F.explode(F.array("src", "dst")).alias("vid")).distinct().select("vid", F.lit(s.tag).alias("tag"), F.col("vid").alias("label"), F.expr("map()").cast("map<string,string>").alias("props"))
    return Import(v, e, t, s)


def import_csv(spark: SparkSession, path: str, sep: str | None = None) -> Import:
    return run(read_rows(spark, path, sep), path.rsplit("/", 1)[-1].rsplit(".", 1)[0])
