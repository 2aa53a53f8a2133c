"""Helpers that the training-data operators share."""

from __future__ import annotations

from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.lineage import discard, materialize, scratch, shared_dir  # noqa: F401  (for the operators here)
from graphloom.sources.tables import read_table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The six ASCII white-space characters; bytes.split() splits at the same six.
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def kept_columns(keep: tuple[str, ...], outputs: tuple[str, ...]) -> Column:
    """The columns to hand through, as one struct `kept`, without those named like an output, which prevails."""
    kept = [F.col(f"`{c}`") for c in keep if c not in outputs]
    return (F.struct(*kept) if kept else F.struct(F.lit(0).alias("_none"))).alias("kept")


def unpacked(keep: tuple[str, ...], outputs: tuple[str, ...]) -> list[Column]:
    return [F.col(f"kept.`{c}`") for c in keep if c not in outputs]


_kept = []


def kept_in_worker(f):
    """Cache f's last result in a Python worker between tasks, until release_kept() is called there."""
    cached = lru_cache(maxsize=1)(f)
    _kept.append(cached)
    return cached


def release_kept() -> None:
    """Drop what earlier stages left in this Python worker: workers are used again by other stages."""
    for cached in _kept:
        cached.cache_clear()


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """What runs inside hands Python at most so many rows at once, so that a worker holds few texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def ascii_lower(text):
    """A-Z to a-z, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def words_of(text):
    """Column: the words between ASCII white space; null text has none."""
    return F.expr(f"filter(split(coalesce({text}, ''), '[ \\\\t-\\\\r]+'), w -> w != '')")
