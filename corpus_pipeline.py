"""The corpus pipeline: quality rules, line dedup, near-dedup, pseudonyms and packing, one after the other.

Stages read and return the columns of documents; further columns are left behind. Each stage treats repeated rows as
its operator does: rows equal in id and text are judged, shortened, kept and replaced alike, and of rows with one doc_id
near-dedup judges each by its own text. A null doc_id is a document of its own; null texts leave in the first stage. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import linededup, neardup, packing, pii, quality
from waymark.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew where a stage changed the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject, those without words (null texts) among them; the rest as
    they were."""
    return quality.keep_documents(docs).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without repeated boilerplate lines."""
    return _documents(linededup.dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.drop_near_duplicates(docs).select(*COLUMNS)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced."""
    return _documents(pii.pseudonymise_documents(docs, pii.session_key(spark)))


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_rules), ("lines", line_dedup), ("near-dedup", near_dedup), ("pii", pseudonyms), ("packing", packing_plan)]
#: MinHash, keyed pseudonyms and tokenization can't be expressed in SQL; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
