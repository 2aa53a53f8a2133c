"""As-of joins: what was the case for a key at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.lineage import materialize


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, columns: list[str], allow_equal: bool = True, tolerance: str | None = None) -> DataFrame:
    """Each row of left with `columns` of the right row of its keys whose time is the latest that isn't after the left one.

    on: columns of both; columns: of right, named otherwise than left's. Of right rows with one
    key and time the greatest by columns counts. allow_equal=False takes earlier times only,
    tolerance (an interval such as "3 days") none that are further back. Left rows without such
    a row, and those with a null key or time, get nulls; right rows with a null key or time
    count for nothing. All left rows stay, equal ones too.

    Both sides lie in one order of keys, times and hashes, dealt to tasks by ranges of it, so a hot
    key (or a hot time) is several ranges. A window gives each row the latest row of its own
    range; what a range takes over from those before it comes from a row for each key and range.
    """
    if clash := set(columns) & set(left.columns):
        raise ValueError(f"both sides have {sorted(clash)}")
    keys = [f"_k{i}" for i in range(len(on))]
    both_known = lambda t, time: F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in [*on, time]))
    held = F.struct(F.col(right_time).alias("_at"), *[F.col(f"`{c}`") for c in columns])
    rows = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    events = right.where(both_known(right, right_time)).select(*[F.col(f"`{c}`").alias(k) for c, k in zip(on, keys, strict=True)], F.col(right_time).alias("_t"), held.alias("_r"))
    asked = left.where(both_known(left, left_time)).select(*[F.col(f"`{c}`").alias(k) for c, k in zip(on, keys, strict=True)], F.col(left_time).alias("_t"), rows.alias("_l"))
    both = events.withColumn("_side", F.lit(0 if allow_equal else 1)).unionByName(asked.withColumn("_side", F.lit(1 if allow_equal else 0)), allowMissingColumns=True)
    # the hash parts rows of one key and time
    ordered = both.withColumn("_h", F.xxhash64("_r", "_l"))
    ranged = materialize(ordered.repartitionByRange(*keys, "_t", "_side", "_h").withColumn("_range", F.spark_partition_id()), "asof")
    last = ranged.where("_r IS NOT NULL").groupBy(*keys, "_range").agg(F.max("_r").alias("_last"))
    here = ranged.select(*keys, "_range").distinct().join(last, [*keys, "_range"], "left")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    taken = here.select(*keys, "_range", F.max("_last").over(before).alias("_before"))
    within = Window.partitionBy(*keys, "_range").orderBy("_t", "_side", "_h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = ranged.withColumn("_here", F.max("_r").over(within)).where("_l IS NOT NULL").join(taken, [*keys, "_range"], "left")
    found = found.withColumn("_found", F.greatest("_here", "_before"))
    if tolerance:
        found = found.withColumn("_found", F.when(F.expr(f"_found._at >= _t - INTERVAL {tolerance}"), F.col("_found")))
    found = found.select("_l.*", *[F.col(f"_found.`{c}`").alias(c) for c in columns])
    unknown = left.where(~both_known(left, left_time)).select(*[F.col(f"`{c}`") for c in left.columns], *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns])
    return found.unionByName(unknown)
