"""Contiguous shards of near-equal bytes from a global prefix sum, in DataFrame operations alone.

Rows are put in one global order (digest of the text, size, id), so that equal texts are neighbours. The order is dealt
over range partitions, which also splits a text that many rows share. Each partition's totals are summed, the totals'
prefix sums are broadcast (one row for each partition), and a row's place in the whole is its partition's start plus
its running sum inside. Cutting at equal byte targets gives the shards; the row index gives the slots.

The law is that of bytes alone, always in the same way: a row belongs to the shard in whose equal share of all bytes its
middle lies. Equal texts lie together in the order, so each of the shards - 1 cuts splits one group of them at most.

Defined cases: a null text has no bytes and the checksum of the empty text; null ids come first in their group;
repeated rows each have a slot; an empty table gives no rows; with fewer rows than shards some shards are empty; other
columns, whatever their names, are not read; texts of any length count whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Bytes that each row counts beside its text.
ROW_BYTES = 16


def byte_shards(docs: DataFrame, shards: int = 40, parts: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``; the texts themselves aren't shuffled."""
    spark = docs.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.conv(F.left(F.md5(text), F.lit(15)), 16, 10).cast("long").alias("digest"),
    )
    order = ["digest", "size", "text_crc32", "doc_id"]
    dealt = checkpointed(rows.repartitionByRange(parts, *order).select("*", F.spark_partition_id().alias("part")))

    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # One row for each of the range partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        dealt.withColumn("bytes_to", F.sum("size").over(inside))
        .withColumn("index_in", F.count("*").over(inside))
        .join(F.broadcast(starts), "part")
        .select("doc_id", "size", "text_crc32", (F.col("bytes_before") + F.col("bytes_to") - F.col("size")).alias("start"), (F.col("rows_before") + F.col("index_in") - 1).alias("index"), "all_bytes")
        .withColumn("shard", _cut(F.col("start"), F.col("size"), F.col("all_bytes"), shards))
    )
    firsts = placed.groupBy("shard").agg(F.min("index").alias("first_index"))  # a row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("index") - F.col("first_index")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _cut(start, size, total, shards: int):
    """The shard in whose range the middle of a row lies; decimals, since shards x bytes may pass a long."""
    middle = (start * 2 + size).cast("decimal(30,0)") * shards
    return F.least(F.lit(shards - 1), F.floor(middle / (total.cast("decimal(30,0)") * 2))).cast("int")
