"""Helpers shared by the operators: tables, the shared scratch folder and stored intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, for Java's regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
#: bytes.translate table that lower-cases A-Z only.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all machines share. Where none is configured, a session on one machine gets one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = tempfile.mkdtemp(prefix="waymark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder once and read it back.

    Cuts the lineage, so that a lost executor costs a re-read and not a recomputation, and makes values that depend
    on the partitioning (spark_partition_id, task counters) the same for every later reader.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/waymark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def wide_hash(*columns: Column | str) -> Column:
    """128 bits as a struct of two longs: two hashes of the columns that start from different seeds."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def whole(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that no column an operator adds can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


#: Keys with more than this share of all rows count as hot: at most a thousand. They have so many rows at least, and
#: are spread over so many tasks.
HOT_SHARE, HOT_ROWS, SALTS = 1000, 1000, 32


def hot_keys(sizes: DataFrame, key: str, size: str) -> DataFrame:
    """The keys of a stored table of keys and their sizes that hold too many rows for one task; 1000 at most."""
    total = sizes.agg(F.sum(size)).first()[0] or 0
    return sizes.where(F.col(size) > max(total // HOT_SHARE, HOT_ROWS)).select(key)


def salted_join(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, hint: str | None = None) -> DataFrame:
    """Inner join on one key. Rows of hot keys are spread over SALTS tasks, to which the table's rows of these keys are
    copied; only the hot keys themselves are broadcast. A hint fixes the kind of join whatever the table's size."""
    marked = F.broadcast(hot.select(F.col(hot.columns[0]).alias(key)).distinct().withColumn("is_hot", F.lit(True)))
    place = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    left = rows.join(marked, key, "left").withColumn("salt", F.when(F.col("is_hot"), place).otherwise(0)).drop("is_hot")
    each = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = table.join(marked, key, "left").withColumn("salt", F.explode(each)).drop("is_hot")
    return left.join(right.hint(hint) if hint else right, [key, "salt"]).drop("salt")
