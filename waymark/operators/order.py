"""Global places of rows in an order, and the order in which values occur in their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.sources.scratch import stored


def numbered(rows: DataFrame, *order: str | Column, name: str = "nth") -> DataFrame:
    """rows with their place from 0 in the order, which should tell them apart.

    One range shuffle; places are counted in its partitions and moved by what earlier ones hold, one row per partition.
    """
    kept = [c for c in rows.columns]
    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = stored(cut.withColumn("_slice", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    sizes = cut.groupBy("_slice").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_slice", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_move"))
    return cut.join(F.broadcast(bases), "_slice").select(*kept, (F.col("_at") + F.col("_move")).alias(name))


def read_in_order(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files with source_order: the file's place in the order of their names, then the row's place in its file."""
    rows = spark.read.parquet(*paths)
    return rows.withColumn("source_order", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


def first_occurrence(rows: DataFrame, *columns: str) -> DataFrame:
    """The distinct values of the columns with nth, their place from 0 by first occurrence in the source.

    rows need source_order, as read_in_order adds it; nulls are values like others.
    """
    firsts = rows.groupBy(*columns).agg(F.min("source_order").alias("source_order"))
    return numbered(firsts, "source_order").drop("source_order")


def keep_first(rows: DataFrame, *keys: str) -> DataFrame:
    """Of the rows of each key the one that comes first in the source, with all its columns; a partial aggregate and no
    sort."""
    others = [c for c in rows.columns if c not in keys]
    kept = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), "source_order").alias("_row"))
    return kept.select(*keys, "_row.*").drop("source_order")
