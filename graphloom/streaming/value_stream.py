"""Evidence and the value index kept up with a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.evidence import EMAIL


def new_evidence(incoming: DataFrame, late: str = "1 hour") -> DataFrame:
    """incoming(source, text, at) without texts seen before within `late`; state older than the watermark is dropped."""
    t = incoming.where(F.length(F.trim("text")) > 0).withColumn("sha256", F.sha2(F.trim("text").cast("binary"), 256))
    return t.withWatermark("at", late).dropDuplicatesWithinWatermark(["sha256"])


def email_counts(incoming: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """start, email, n: mentions in event-time windows; late rows count until the watermark passes."""
    found = incoming.withWatermark("at", late).select("at", F.explode(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))).alias("email"))
    n = found.groupBy(F.window("at", window).alias("w"), F.lower("email").alias("email")).agg(F.count("*").alias("n"))
    return n.select(F.col("w.start").alias("start"), "email", "n")


def write(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, then stop. Files and offsets commit together, so a lost driver goes on where it was."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
