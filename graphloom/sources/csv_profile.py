"""Profiles of CSV columns: type, null and distinct ratios, and node or edge structure."""

from __future__ import annotations

import csv
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.lineage import cut

DELIMITERS = ",;\t|"


def sniff_delimiter(head: str) -> str:
    """The delimiter that the first lines hold equally often, and most often."""
    lines = [x for x in head.splitlines() if x.strip()][:20]
    def rank(d: str) -> tuple[int, int]:
        counts = Counter(x.count(d) for x in lines)
        most, times = max(counts.items(), key=lambda kv: (kv[1], kv[0])) if counts else (0, 0)
        return (times if most else 0, most)
    return max(DELIMITERS, key=rank)


def _head(spark: SparkSession, path: str, encoding: str) -> list[str]:
    return [r[0] for r in spark.read.option("encoding", encoding).text(path).limit(20).collect()]


def records(spark: SparkSession, path: str, sep: str, encoding: str = "utf-8") -> DataFrame:
    """file, _record (from 0 in its file) and text of each record of CSV files, which are split like any text.

    A line break within quotes belongs to its record. Whether a split begins within quotes hangs
    on all that is before it in its file, so each line is taken as what it does to that state: quotes
    are open or not behind it whatever was before it, or as before it, or the other way round. Such
    steps are put together within a split, then over a file's splits (a row each).
    A quote opens only at the start of a field and two of them within quotes are one, as everywhere.
    """
    d = re.escape(sep)
    field = f'(?:"(?:[^"]++|"")*+"[^{d}]*+|[^"{d}][^{d}]*+|)'
    opens = f'^(?:{field}{d})*+"(?:[^"]++|"")*+$'
    lines = spark.read.option("encoding", encoding).option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    closed_before, open_before = F.col("value").rlike(opens), F.concat(F.lit('"'), "value").rlike(opens)
    lines = lines.withColumns({"always": F.when(closed_before == open_before, closed_before), "swaps": (closed_before & ~open_before).cast("int")})
    here = Window.partitionBy("file", "block").orderBy("at")
    lines = lines.withColumn("_turn", F.sum(F.col("always").isNotNull().cast("int")).over(here))  # a step that sets the state begins a new count of swaps
    since = Window.partitionBy("file", "block", "_turn").orderBy("at")
    lines = lines.withColumns({"_set": F.first("always").over(since), "_odd": F.sum("swaps").over(since) % 2 == 1})
    lines = cut(lines.drop("always", "swaps", "_turn"))
    splits = lines.groupBy("file", "block").agg(F.max_by(F.struct("_set", "_odd"), "at").alias("step"))
    splits = splits.select("file", "block", F.col("step._set").alias("_set"), F.col("step._odd").alias("_odd"))
    earlier = Window.partitionBy("file").orderBy("block")
    splits = splits.withColumn("_turn", F.sum(F.col("_set").isNotNull().cast("int")).over(earlier))
    upto = Window.partitionBy("file", "_turn").orderBy("block")
    behind = F.coalesce(F.first("_set").over(upto), F.lit(False)) != (F.sum(F.col("_odd").cast("int")).over(upto) % 2 == 1)
    splits = splits.withColumn("_behind", behind).select(F.col("file").alias("f"), F.col("block").alias("b"), F.coalesce(F.lag("_behind").over(earlier), F.lit(False)).alias("_start"))
    lines = lines.join(F.broadcast(splits), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).drop("f", "b")
    lines = lines.withColumn("_open", F.coalesce("_set", "_start") != F.col("_odd"))
    lines = lines.withColumn("_first", ~F.coalesce(F.lag("_open").over(here), F.col("_start"))).withColumn("_n", F.sum(F.col("_first").cast("int")).over(here))
    lines = cut(lines.where(F.col("_open") | ~F.col("_first") | (F.trim(F.regexp_replace("value", "\r$", "")) != "")).select("file", "block", "at", "value", "_open", "_first", "_n"))
    counts = lines.groupBy("file", "block").agg(F.sum(F.col("_first").cast("int")).alias("n"))
    counts = counts.select(F.col("file").alias("f"), F.col("block").alias("b"), (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("_before"))
    here = Window.partitionBy("file", "block").orderBy("at")  # blank lines between records are gone
    lines = lines.withColumn("_n", F.sum(F.col("_first").cast("int")).over(here)).join(F.broadcast(counts), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    lines = lines.select("file", "block", "at", "value", (F.col("_before") + F.col("_n") - 1).alias("_record"), (F.col("_first") & ~F.col("_open")).alias("_whole"))
    parts = lines.where("NOT _whole").groupBy("file", "_record").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("parts"))
    parts = parts.select("file", "_record", F.array_join(F.transform("parts", lambda x: x["value"]), "\n").alias("text"))
    every = lines.where("_whole").select("file", "_record", F.col("value").alias("text")).unionByName(parts)
    return every.withColumn("text", F.regexp_replace("text", "\r$", ""))


def read_rows(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "utf-8") -> DataFrame:
    """All columns of CSV files as strings, and _row: a record's place from 1, over all files in order of name.

    The delimiter is sniffed from the first lines. Fields may be quoted, hold the delimiter, doubled
    quotes and line breaks. Each file has the first one's header; records with fewer fields end in
    nulls, fields beyond the header are left out.
    """
    if sep is None:
        sep = sniff_delimiter("\n".join(_head(spark, path, encoding))[:65_536])
    found = cut(records(spark, path, sep, encoding))
    header = found.where("_record = 0").orderBy("file").limit(1).collect()
    if not header:
        return spark.createDataFrame([], "_row long")
    names = _unique(next(csv.reader([header[0].text.removeprefix("\ufeff")], delimiter=sep)))
    files = found.groupBy("file").agg((F.max("_record")).alias("n"))
    files = files.select(F.col("file").alias("f"), (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("_before"))  # a row for each file
    kind = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))])
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1", "multiLine": "true", "lineSep": "\n"}
    parsed = F.from_csv("text", kind.simpleString()[7:-1].replace(":", " "), options)
    rows = found.where("_record > 0").join(F.broadcast(files), F.col("file") == F.col("f")).select(parsed.alias("r"), (F.col("_before") + F.col("_record")).alias("_row"))
    return rows.select(*(F.col(f"r._{i}").alias(n) for i, n in enumerate(names)), "_row")


def _unique(names: list[str]) -> list[str]:
    """Names that Spark can tell apart: empty and repeated ones get their place."""
    seen: set[str] = set()
    out = []
    for i, n in enumerate(names):
        n = n if n and n.lower() not in seen else f"{n or '_c'}{i}"
        seen.add(n.lower())
        out.append(n)
    return out


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "utf-8") -> DataFrame:
    """`read_rows` without their numbers."""
    return read_rows(spark, path, sep, encoding).drop("_row")


def numbered(rows: DataFrame) -> DataFrame:
    """rows with _row, their place in the input from 1, over all files in order of name; rows that have it stay as they are.

    Parts are counted first (a row each), so no sort and no shuffle; rows must come
    straight from files, whose parts are the same each time they are read.
    """
    if "_row" in rows.columns:
        return rows
    r = rows.withColumns({"_at": F.monotonically_increasing_id()})
    counts = r.groupBy(F.shiftright("_at", 33).alias("_p")).agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    r = r.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), F.col("_part") == F.col("_p"))
    return r.withColumn("_row", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).select(*rows.columns, "_row")


def profile(df: DataFrame, samples: int = 5) -> DataFrame:
    """column, type, null_ratio, distinct_ratio of string columns, samples (the least values).

    A value and its column are one key, so distinct values are counted by partial sums over
    all columns at once, and the table is read once whatever its width.
    """
    text = lambda c: F.trim(F.col(f"`{c}`").cast("string"))
    n = df.count()
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.when(text(c) != "", text(c)).alias("v")) for i, c in enumerate(df.columns)])).alias("c")).select("c.*").where("v IS NOT NULL")
    values = cells.groupBy("i", "v").agg(F.count("*").alias("n"))
    v = F.col("v")
    found = values.groupBy("i").agg(
        F.sum("n").alias("count"), F.count("*").alias("distinct"), F.bool_and(F.lower(v).isin("true", "false", "yes", "no")).alias("is_bool"), F.bool_and(v.rlike(r"^[+-]?\d+$")).alias("is_int"), F.bool_and(v.try_cast("double").isNotNull()).alias("is_float"),
    )
    first = values.withColumn("_k", F.row_number().over(Window.partitionBy("i").orderBy("v"))).where(F.col("_k") <= samples).groupBy("i").agg(F.sort_array(F.collect_list("v")).alias("samples"))
    names = df.sparkSession.createDataFrame(list(enumerate(df.columns)), "i int, column string")
    kind = F.when(F.col("is_bool"), "bool").when(F.col("is_int"), "int").when(F.col("is_float"), "float").otherwise("string")
    count = F.coalesce("count", F.lit(0))
    out = names.join(found, "i", "left").join(first, "i", "left").select(
        "column", kind.alias("type"), F.round(1 - count / F.lit(max(1, n)), 4).alias("null_ratio"), F.round(F.coalesce("distinct", F.lit(0)) / F.greatest(count, F.lit(1)), 4).alias("distinct_ratio"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), "i"
    )
    return out.orderBy("i").drop("i")


def inspect_csv(spark: SparkSession, path: str, sample: int | None = 500, encoding: str = "utf-8") -> DataFrame:
    """The profile of a file's first `sample` rows, or of all."""
    rows = read_rows(spark, path, encoding=encoding)
    return profile((rows if sample is None else rows.where(F.col("_row") <= sample)).drop("_row"))
