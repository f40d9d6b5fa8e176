"""Readers with fixed schemas for the learning-analytics tables, and sinks.

CSV is read with a schema, never by inference; a dataset is an argument, not an environment variable.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "code_module string, code_presentation string, id_student long"
#: Schemas of the raw files, in the files' column order.
SCHEMAS = {
    "studentInfo": "code_module string, code_presentation string, id_student long, gender string, region string, highest_education string, imd_band string, age_band string, num_of_prev_attempts int, studied_credits int, disability string, final_result string",
    "studentRegistration": f"{_KEY}, date_registration double, date_unregistration double",
    "studentVle": f"{_KEY}, id_site long, date int, sum_click long",
    "vle": "id_site long, code_module string, code_presentation string, activity_type string, week_from double, week_to double",
    "assessments": "code_module string, code_presentation string, id_assessment long, assessment_type string, date double, weight double",
    "studentAssessment": "id_assessment long, id_student long, date_submitted double, is_banked int, score double",
    "enrollment": "enrollment_id long, username string, course_id string",
    "truth": "enrollment_id long, dropout int",
    "log": "enrollment_id long, time timestamp, source string, event string, object string",
    "date": "course_id string, from date, to date",
}
HEADERLESS = {"truth"}


def read_table(spark: SparkSession, name: str, *paths: str) -> DataFrame:
    """One raw table from one or more CSV or Parquet files; several files are a bag union."""
    if not paths:
        raise ValueError("no path given")
    if all(p.rstrip("/").endswith(".parquet") for p in paths):
        return spark.read.parquet(*paths)
    return spark.read.schema(SCHEMAS[name]).csv(list(paths), header=name not in HEADERLESS, mode="PERMISSIVE", nullValue="?")


def read_vle_events(spark: SparkSession, *paths: str) -> DataFrame:
    """Interaction rows from the start of the course on; the filter reaches the scan."""
    return read_table(spark, "studentVle", *paths).where("date >= 0")


def read_kdd(spark: SparkSession, root: str, name: str) -> DataFrame:
    """enrollment, truth or log from the train and test folders of root; date from root itself."""
    if name == "date":
        return read_table(spark, name, f"{root}/date.csv")
    return read_table(spark, name, *[f"{root}/{part}/{name}_{part}.csv" for part in ("train", "test")])


def read_predictions(spark: SparkSession, path: str, weeks: list[int] | None = None, models: list[str] | None = None) -> DataFrame:
    """Scored panels partitioned by week and model; only the partitions asked for are read."""
    df = spark.read.parquet(path)
    if weeks is not None:
        df = df.where(F.col("week").isin(weeks))
    return df if models is None else df.where(F.col("model").isin(models))


def write_predictions(df: DataFrame, path: str) -> None:
    """Replace only the (week, model) partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week", "model").parquet(path)


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Replace a table as a whole; CSV carries a header."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.format(form).save(path)


def write_json(value: object, path: str) -> None:
    """Replace a local manifest at once: a reader sees the old file or the new one."""
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "w") as f:
        json.dump(value, f, indent=2, sort_keys=True)
    os.replace(own, path)


def read_json(path: str) -> object:
    with open(path) as f:
        return json.load(f)
