"""Validation by a second derivation, and manifests of what went into a run."""

from __future__ import annotations

import hashlib
import json
import os
import platform

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.columns import KEY, PRESENTATION


def compare_grouped(expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Rows of keys that only one side holds, or whose values differ by more than the tolerance (absolute and relative).

    Two nulls, and two NaN, are equal. No rows: the tables agree.
    """
    left = expected.select(*keys, *[F.col(v).alias(f"expected_{v}") for v in values], F.lit(True).alias("in_expected"))
    right = actual.select(*keys, *[F.col(v).alias(f"actual_{v}") for v in values], F.lit(True).alias("in_actual"))
    both = left.join(right, keys, "full")
    wrong = F.col("in_expected").isNull() | F.col("in_actual").isNull()
    for v in values:
        a, b = F.col(f"expected_{v}"), F.col(f"actual_{v}")
        near = F.abs(a - b) <= tolerance + tolerance * F.abs(b)
        wrong = wrong | ~F.coalesce(near, a.eqNullSafe(b))
    return both.where(wrong)


def set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one table holds, and which."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def without_match(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the other table lacks, or holds more than once: what a complete many-to-one join has none of.
    matches is how many there are."""
    found = other.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"))
    return rows.join(found, keys, "left").withColumn("matches", F.coalesce("matches", F.lit(0))).where("matches != 1")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows hold."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unmatched(rows: DataFrame, message: str) -> None:
    """Fail if there are any rows."""
    if not rows.isEmpty():
        raise ValueError(message)


def cutoff_violations(submissions: DataFrame, week: int) -> DataFrame:
    """Submissions that a landmark's evidence must not hold."""
    return submissions.where((F.col("date_submitted") >= 7 * week) | (F.col("date_submitted") < 0))


def _second_evidence(events: DataFrame, submissions: DataFrame, assessments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Admissible submissions with their presentation, and both weekly tables, from the raw days: by days first and
    integer division, not by the builders' expressions."""
    sent = submissions.withColumn("date_submitted", F.col("date_submitted").try_cast("double")).where("date_submitted >= 0 AND NOT isnan(date_submitted) AND date_submitted < double('infinity') AND is_banked = 0")
    sent = sent.select("id_assessment", "id_student", "score", F.expr("cast(date_submitted as long)").alias("day")).join(F.broadcast(assessments.select("id_assessment", *PRESENTATION)), "id_assessment")
    score = F.expr("try_cast(score as double)") / 100
    assess = sent.withColumn("week_index", F.expr("day div 7 + 1").cast("int")).groupBy(*KEY, "week_index").agg(F.count(F.lit(1)).alias("assess_attempts"), F.avg(score).alias("assess_score_mean"), F.max(score).alias("assess_score_max"))
    days = events.where("date >= 0").withColumn("day", F.expr("cast(date as long)")).groupBy(*KEY, "day").agg(F.sum("sum_click").alias("clicks"))
    vle = days.groupBy(*KEY, F.expr("day div 7 + 1").cast("int").alias("week_index")).agg(F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks_total"), F.count(F.lit(1)).alias("active_days"))
    return sent, assess, vle


def landmark_audit(events: DataFrame, submissions: DataFrame, assessments: DataFrame, roster: DataFrame, weeks: list[int]) -> DataFrame:
    """Per landmark, from the raw days alone: week, cutoff_day, admissible_submissions, activity_enrolments (of the roster,
    with any admissible event before the cutoff) and vle_clicks."""
    # Days after the last cutoff say nothing of any landmark; left out here, they do not leave the scans.
    last = 7 * max(weeks)
    sent = _second_evidence(events, submissions, assessments)[0].where(F.col("day") < last)
    events = events.where((F.col("date") >= 0) & (F.col("date") < last))
    each = F.explode(F.array(*map(F.lit, weeks))).alias("week")
    first = sent.select(*KEY, "day").unionByName(events.select(*KEY, F.expr("cast(date as long)").alias("day"))).groupBy(*KEY).agg(F.min("day").alias("day"))
    active = first.join(roster.select(*KEY).distinct(), KEY)
    by_day = [
        sent.groupBy("day").agg(F.count(F.lit(1)).alias("sent")).select("day", "sent", F.lit(0).alias("active"), F.lit(0).alias("clicks")),
        active.groupBy("day").agg(F.count(F.lit(1)).alias("active")).select("day", F.lit(0).alias("sent"), "active", F.lit(0).alias("clicks")),
        events.groupBy(F.expr("cast(date as long)").alias("day")).agg(F.sum("sum_click").alias("clicks")).select("day", F.lit(0).alias("sent"), F.lit(0).alias("active"), "clicks"),
    ]
    rows = by_day[0].unionByName(by_day[1]).unionByName(by_day[2])
    inside = rows.select("*", each).where(F.col("day") < 7 * F.col("week"))
    totals = inside.groupBy("week").agg(F.sum("sent").alias("admissible_submissions"), F.sum("active").alias("activity_enrolments"), F.sum("clicks").alias("vle_clicks"))
    return totals.select("week", (7 * F.col("week")).alias("cutoff_day"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("admissible_submissions", "activity_enrolments", "vle_clicks")])


def validate_evidence(staged: dict[str, DataFrame], events: DataFrame, submissions: DataFrame, assessments: DataFrame, roster: DataFrame, weeks: list[int]) -> dict[str, object]:
    """Derive the staged tables assess_weekly, vle_weekly and behavioural again from raw days, and fail with the name of the
    first that differs; else the audit of the landmarks.

    Checked are: one assessment for every admissible submission; one row per learner and week; keys and values of both
    weekly tables; that the learners active before each cutoff are the same; and that the behavioural table has one row
    per enrolment of the roster and landmark, with the submissions before its cutoff.
    """
    sent, assess, vle = _second_evidence(events, submissions, assessments)
    week_key = [*KEY, "week_index"]
    admissible = submissions.where("date_submitted >= 0 AND is_banked = 0")
    require_unmatched(without_match(admissible.select("id_assessment"), assessments, ["id_assessment"]), "submissions without exactly one assessment")
    for name, table, expected, values in (
        ("assess_weekly", staged["assess_weekly"], assess, ["assess_attempts", "assess_score_mean", "assess_score_max"]), ("vle_weekly", staged["vle_weekly"], vle, ["clicks_total", "active_days"]),
    ):
        require_unmatched(repeated(table, week_key), f"{name} repeats a learner's week")
        doubles = lambda df: df.select(*week_key, *[F.col(v).cast("double").alias(v) for v in values])  # noqa: B023, E731
        require_unmatched(compare_grouped(doubles(expected), doubles(table), week_key, values), f"{name} differs from the raw days")
    horizons = roster.select(*KEY).distinct().select(*KEY, F.explode(F.array(*map(F.lit, weeks))).alias("snapshot_week"))
    behavioural, on = staged["behavioural"], [*KEY, "snapshot_week"]
    require_unmatched(repeated(behavioural, on), "behavioural repeats an enrolment")
    require_unmatched(set_difference(horizons, behavioural, on).where("side = 'left'"), "behavioural lacks enrolments of the roster")
    counts = sent.select(*KEY, "day", F.explode(F.array(*map(F.lit, weeks))).alias("snapshot_week")).where("day < 7 * snapshot_week").groupBy(*on).agg(F.count(F.lit(1)).cast("double").alias("time_submissions"))
    wanted = horizons.join(counts, on, "left").select(*on, F.coalesce("time_submissions", F.lit(0.0)).alias("time_submissions"))
    given = behavioural.join(horizons, on, "left_semi").select(*on, F.coalesce(F.col("time_submissions").cast("double"), F.lit(0.0)).alias("time_submissions"))
    require_unmatched(compare_grouped(wanted, given, on, ["time_submissions"]), "behavioural counts other submissions")
    audit = landmark_audit(events, submissions, assessments, roster, weeks).orderBy("week")
    return {"landmarks": [r.asDict() for r in audit.collect()]}  # one row per landmark


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def table_digest(df: DataFrame) -> dict[str, object]:
    """Rows and an order-free sum of row hashes; the same for equal bags of rows."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return {"rows": row["n"], "hash": str(row["h"])}


def inside(root: str, path: str) -> str:
    """path's real place; an error if that is not below root."""
    real = os.path.realpath(os.path.join(root, path))
    if os.path.commonpath([os.path.realpath(root), real]) != os.path.realpath(root):
        raise ValueError(f"{path} leads out of {root}")
    return real


def provenance(spark: SparkSession, tables: dict[str, DataFrame], files: list[str], settings: dict[str, object]) -> dict[str, object]:
    """What a run read and ran under; absent files are recorded as null."""
    return {
        "settings": settings, "spark": spark.version, "python": platform.python_version(), "tables": {k: table_digest(df) for k, df in sorted(tables.items())},
        "files": {f: file_digest(f) if os.path.exists(f) else None for f in sorted(files)},
    }


def signature(manifest: dict[str, object]) -> str:
    """A digest of a manifest; a stored part of a run may be used again only under an equal one."""
    return hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()
