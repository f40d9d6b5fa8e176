"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Tables that are written at a time, where they are small and many.
TABLES = 6


def _folder(spark: SparkSession, name: str) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = tempfile.mkdtemp(prefix="waymark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/waymark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once below spark.checkpoint.dir and read it back, for plans that use it several times.

    Cuts the lineage: a lost executor costs a re-read. Only a session on one machine may leave the folder unset.
    """
    path = _folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_all(tables: list[DataFrame], name: str) -> DataFrame:
    """Tables of one schema as one, stored. Each is written by a plan of its own, as their union would be one plan of all."""
    spark = tables[0].sparkSession
    path = _folder(spark, name)
    paths = [f"{path}/{k}" for k in range(len(tables))]
    with ThreadPool(TABLES) as pool:
        pool.starmap(inheritable_thread_target(spark)(lambda df, to: df.write.parquet(to)), zip(tables, paths), chunksize=1)
    return spark.read.schema(tables[0].schema).parquet(*paths)


def parts(rows: DataFrame, each: int) -> int | None:
    """So many tasks that each has about `each` of the rows, which are counted: by their files if they are read as they
    are. None if the session's tasks are as many, so that Spark chooses."""
    n = -(-rows.count() // each)
    return n if n > rows.sparkSession.sparkContext.defaultParallelism else None
