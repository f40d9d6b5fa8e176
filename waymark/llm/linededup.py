"""Line dedup: lines that many sites share are boilerplate.

How many sites a line appears on is first estimated: one HyperLogLog sketch of the sites per line hash, built on each
partition and merged by the aggregation. Only lines whose estimate lies near the threshold get an exact distinct
count. Of each boilerplate line the first occurrence stays and all others are removed. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, salted_join, stored, whole, wide_hash

#: A line on this many sites is boilerplate.
MIN_SITES = 10
#: Base-2 logarithm of the sketch's buckets, and the relative error beyond which the estimate decides alone: over
#: three standard errors (1.04 / sqrt(2 ** LG_K)) of a sketch of that size.
LG_K, MARGIN = 12, 0.06
#: Matches a line with a character other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]"


def lines_of(docs: DataFrame, site: str = "source") -> DataFrame:
    """doc_id, row_key, line (from 0), line_key, site of every line with a word; the keys are 128-bit hashes."""
    split = docs.select("doc_id", wide_hash("doc_id", "text").alias("row_key"), F.col(site).alias("site"), F.posexplode(F.split("text", "\n")).alias("line", "words"))
    return split.where(F.col("words").rlike(WORD)).select("doc_id", "row_key", "line", wide_hash("words").alias("line_key"), "site")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """line_key, rows (its occurrences) and first (doc_id, row_key, line) of the lines on at least min_sites sites."""
    spread = lines.groupBy("line_key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("about"), F.count("site").alias("rows"), F.min(F.struct("doc_id", "row_key", "line")).alias("first")
    )
    # No line is on more sites than it has occurrences.
    likely = stored(spread.where((F.col("rows") >= min_sites) & (F.col("about") * (1 + MARGIN) >= min_sites)), "line-spread")
    sure = F.col("about") * (1 - MARGIN) >= min_sites
    near = likely.where(~sure).select("line_key")
    exact = (
        lines.join(near, "line_key", "left_semi").groupBy("line_key", "site").agg(F.count("*").alias("n"))
        .groupBy("line_key").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    )
    return likely.where(sure).unionByName(likely.where(~sure).join(exact.select("line_key"), "line_key", "left_semi")).select("line_key", "rows", "first")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """docs with its text less repeated boilerplate lines, and n_lines and n_removed.

    Lines are what "\\n" separates; those without a word are never counted or removed. The first occurrence of a line
    is that of the smallest doc_id (null before all). Rows equal in doc_id and text are one document and lose the same
    lines. A null text stays null with no lines; a null site is no site. An empty table gives an empty result.
    Columns of docs named n_lines or n_removed are replaced; all others stay as they are.
    """
    docs = docs.drop("n_lines", "n_removed")
    lines = stored(lines_of(docs, site), "lines")
    common = stored(boilerplate(lines, min_sites), "boilerplate")
    again = salted_join(lines.drop("site"), common.drop("rows"), "line_key", hot_keys(common, "line_key", "rows")).where(F.struct("doc_id", "row_key", "line") != F.col("first"))
    gone = again.groupBy("row_key").agg(F.collect_set("line").alias("gone"))
    rows = docs.select(whole(docs).alias("doc"), wide_hash("doc_id", "text").alias("row_key")).join(gone, "row_key", "left")
    text, own = F.col("doc.text"), F.split("doc.text", "\n")
    left = F.array_join(F.filter(own, lambda _, i: ~F.array_contains(F.col("gone"), i)), "\n")
    count = lambda x: F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0)).cast("long")
    columns = [F.when(F.col("gone").isNotNull(), left).otherwise(text).alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns]
    return rows.select(*columns, count(F.filter(own, lambda x: x.rlike(WORD))).alias("n_lines"), count(F.col("gone")).alias("n_removed"))
