"""Sharding: contiguous shards of nearly equal bytes by global prefix sums.

Rows are range-partitioned by doc_id; the totals of the partitions, one row each, give every partition its offset, and
a running sum inside the partition gives every row its place among all bytes. Shards are cut at equal targets, so a
shard's size differs from the mean by less than the largest document. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARDS = 40
#: Bytes that a document takes besides its text.
OVERHEAD = 16


def shard(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of docs.

    Documents lie in the order of doc_id (null first), then checksum and size; rows equal in all three are
    interchangeable. A document belongs to the shard in which its first byte falls; slot counts from 0 within the
    shard. A null text has no bytes and the checksum of nothing. Fewer documents than shards leave shards empty; an
    empty table gives an empty result. grown_shard is null under this law.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    rows = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sized")
    # One row per partition of the range shuffle, so the window without a key stays small.
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("part").orderBy(*order)
    rows = rows.withColumn("running", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(inside))
    rows = rows.join(bases, "part")
    start = F.col("bytes_before") + F.col("running") - F.col("size")
    rows = rows.withColumn("shard", F.floor(start.cast("decimal(38,0)") * shards / F.col("total")).cast("int")).withColumn("place", F.col("rows_before") + F.col("nth") - 1)
    placed = stored(rows.select("doc_id", "size", "text_crc32", "shard", "place"), "sharded")
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    placed = placed.join(F.broadcast(firsts), "shard")  # one row per shard
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
