"""Contiguous balanced shards by global byte-size prefix sums.

The rows (without texts) are ordered by doc_id over range partitions; each
partition adds up its bytes, the totals' prefix sums are the partitions' offsets,
and each row's offset follows inside its partition. Cutting the offsets at equal
targets gives shards that are contiguous in doc_id and balanced in bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize

SHARDS = 16


def shard_by_bytes(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs(doc_id, text).

    A row's size is its UTF-8 bytes plus 1. The shard is set by the middle of the row's
    bytes on the line of all bytes, so shard sizes differ by a row's size at most. Null
    texts have size 1 and the checksum of the empty text, null doc_ids come first,
    rows that share a doc_id are ordered by checksum, size and place in the input.
    An empty table gives no rows. Texts are read once and never shuffled.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.expr("coalesce(text, '')")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    # written once: the sums and the rows below must see the same partitions, whatever is lost
    rows = materialize(rows.repartitionByRange(parts, "doc_id", "text_crc32", "size", "_tie").withColumn("_part", F.spark_partition_id()), "shards")
    totals = rows.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(  # one row for each partition
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_all"),
    )
    inside = Window.partitionBy("_part").orderBy("doc_id", "text_crc32", "size", "_tie")
    placed = rows.join(F.broadcast(offsets), "_part").select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("_row0") + F.row_number().over(inside) - 1).alias("_row"),
        F.expr(f"cast((2 * (_byte0 + sum(size) OVER (PARTITION BY _part ORDER BY doc_id, text_crc32, size, _tie ROWS UNBOUNDED PRECEDING)) - size) * {n_shards} div (2 * _all) as int)").alias("shard"),
    )
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_row") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def crc32_sql(text: str) -> str:
    """DuckDB expression: the CRC-32 of a text's UTF-8 bytes, by a table made from its polynomial."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    step = f"xor(c >> 8, {table}[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {step}), 4294967295)"


ORACLE = f"""
WITH d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, size, CAST({crc32_sql("t")} AS BIGINT) AS text_crc32 FROM d),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) AS e, sum(size) OVER () AS a FROM c),
s AS (SELECT *, CAST((2 * e - size) * {SHARDS} // (2 * a) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
