"""Tables of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Below this, a table isn't worth dealing.
SMALL_BYTES = 1 << 20


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table; one so small that a single task would read it all is dealt to all cores, whatever its row groups.

    Larger tables are split by Spark, and never shuffled here. Sizes are the planner's, so no file is opened.
    """
    df = spark.read.parquet(path)
    n_bytes = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if SMALL_BYTES < n_bytes <= spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes():
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df
