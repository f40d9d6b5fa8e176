"""Labels, course weeks and weekly evidence from interactions and assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.columns import KEY, PRESENTATION, day_to_week, finite

#: Labels by result.
BINARY = {"Pass": 1, "Distinction": 1, "Fail": 0, "Withdrawn": 0}
MULTICLASS = {"Withdrawn": 0, "Fail": 1, "Pass": 2, "Distinction": 3}
ASSESS = ["assess_attempts", "assess_score_mean", "assess_score_max", "assess_score_weighted"]


def make_labels(info: DataFrame, mode: str = "binary") -> DataFrame:
    """KEY, label_name, label; rows of unknown results are dropped."""
    if mode not in ("binary", "multiclass4"):
        raise ValueError("mode must be 'binary' or 'multiclass4'")
    label: Column = F.lit(None).cast("int")
    for name, value in (BINARY if mode == "binary" else MULTICLASS).items():
        label = F.when(F.col("final_result") == name, value).otherwise(label)
    return info.select(*KEY, F.col("final_result").alias("label_name"), label.alias("label")).where("label IS NOT NULL")


def kdd_labels(enrolments: DataFrame, truth: DataFrame) -> DataFrame:
    """KEY and label: one less dropout; an unknown outcome counts as dropout. The presentation is the module."""
    joined = enrolments.join(truth, "enrollment_id", "left")
    return joined.select(F.col("enrollment_id").alias("id_student"), F.col("course_id").alias("code_module"), F.col("course_id").alias("code_presentation"), (1 - F.coalesce("dropout", F.lit(1))).cast("int").alias("label"))


def admissible_submissions(submissions: DataFrame) -> DataFrame:
    """Submissions on a known day from 0 on that are not carried over from an earlier presentation."""
    day = finite(F.col("date_submitted"))
    return submissions.withColumn("date_submitted", day).where((F.col("date_submitted") >= 0) & (F.col("is_banked") == 0))


def vle_weekly(events: DataFrame, sites: DataFrame, activity_types: list[str] | None = None, competencies: DataFrame | None = None) -> DataFrame:
    """KEY, week_index, clicks_total, active_days and clicks_<type> per activity type.

    Sites have one row per id_site. Interactions with unknown sites or types count in the total alone. Without a list
    of types those of `sites` are looked up first, so that the columns are known before the plan is made.
    """
    if activity_types is None:
        activity_types = sorted(r[0] for r in sites.select("activity_type").where("activity_type IS NOT NULL").distinct().collect())
    rows = events.withColumn("date", finite(F.col("date"))).where("date >= 0").withColumn("week_index", day_to_week(F.col("date")))
    rows = rows.join(sites.select("id_site", "activity_type"), "id_site", "left")
    by_type = [F.coalesce(F.sum(F.when(F.col("activity_type") == t, F.col("sum_click"))), F.lit(0)).alias(f"clicks_{t}") for t in activity_types]
    out = rows.groupBy(*KEY, "week_index").agg(F.coalesce(F.sum("sum_click"), F.lit(0)).alias("clicks_total"), F.countDistinct("date").alias("active_days"), *by_type)
    return _with_competencies(out, competencies)


def assess_weekly(submissions: DataFrame, assessments: DataFrame, competencies: DataFrame | None = None) -> DataFrame:
    """KEY, week_index, attempts and mean, greatest and weighted score (0 to 1).

    A null score adds its weight to the denominator of the weighted score and nothing above it. Submissions without
    an assessment are an error that names their number. The assessments, a few for each presentation, are broadcast: dealt
    by their ids, all submissions would lie in a few hundred groups.
    """
    rows = admissible_submissions(submissions)
    meta = assessments.select("id_assessment", *PRESENTATION, F.col("weight").cast("double").alias("weight"), F.lit(True).alias("known"))
    rows = rows.join(F.broadcast(meta), "id_assessment", "left")
    checked = F.when(F.col("known").isNull(), F.raise_error(F.lit("submission without an assessment")).cast("long")).otherwise(F.col("id_assessment"))
    rows = rows.withColumn("id_assessment", checked).withColumn("week_index", day_to_week(F.col("date_submitted")))
    rows = rows.withColumn("score_01", finite(F.col("score")) / 100).withColumn("weight_01", F.col("weight") / 100)
    weights, weighted = F.sum("weight_01"), F.coalesce(F.sum(F.col("score_01") * F.col("weight_01")), F.lit(0.0))
    out = rows.groupBy(*KEY, "week_index").agg(
        F.count("id_assessment").alias("assess_attempts"), F.avg("score_01").alias("assess_score_mean"), F.max("score_01").alias("assess_score_max"),
        F.when(weights > 0, F.try_divide(weighted, weights)).alias("assess_score_weighted"),
    )
    return _with_competencies(out, competencies)


def _with_competencies(rows: DataFrame, competencies: DataFrame | None) -> DataFrame:
    if competencies is None:
        return rows
    names = competencies.select(*PRESENTATION, "week_index", "competency_id")
    return rows.join(names, [*PRESENTATION, "week_index"], "left")


def weekly_panel(vle: DataFrame, assess: DataFrame, week: int | None = None) -> DataFrame:
    """Full outer join of both kinds of evidence by KEY and week, up to a landmark's week."""
    both = vle.join(assess, [*KEY, "week_index"], "full")
    return both if week is None else both.where(F.col("week_index").between(1, week))


def kdd_weekly(logs: DataFrame, enrolments: DataFrame, dates: DataFrame, sources: list[str]) -> DataFrame:
    """KEY, week_index, clicks_total, active_days and clicks_src_<source>; events before the start are dropped."""
    rows = logs.join(enrolments, "enrollment_id", "left").join(dates.select("course_id", F.col("from").alias("start")), "course_id", "left")
    since = F.floor((F.unix_timestamp("time") - F.unix_timestamp(F.col("start").cast("timestamp"))) / 86400)
    rows = rows.withColumn("week_index", (F.floor(since / 7) + 1).cast("int")).where("week_index >= 1")
    counts = [F.count(F.when(F.col("source") == s, F.col("event"))).alias(f"clicks_src_{s}") for s in sources]
    out = rows.groupBy("enrollment_id", "course_id", "week_index").agg(F.count("event").alias("clicks_total"), F.countDistinct(F.to_date("time")).alias("active_days"), *counts)
    return out.withColumnRenamed("enrollment_id", "id_student").withColumnRenamed("course_id", "code_module").withColumn("code_presentation", F.col("code_module"))


def kdd_assess_weekly(vle: DataFrame) -> DataFrame:
    """Empty assessment evidence for each week with activity."""
    zero = [F.lit(0).alias(ASSESS[0]), *[F.lit(0.0).alias(c) for c in ASSESS[1:]]]
    return vle.select(*KEY, "week_index").distinct().select(*KEY, "week_index", *zero)


def _as_weeks(spans: DataFrame, identity: Column, name: Column) -> DataFrame:
    weeks = spans.withColumn("week_index", F.explode(F.sequence("low", "high")))
    return weeks.select(identity.alias("competency_id"), *PRESENTATION, "week_index", name.alias("name"))


def course_weeks(site_weeks: DataFrame, events: DataFrame) -> DataFrame:
    """A row per presentation and week of its span, from the sites' planned weeks and from interactions."""
    planned = site_weeks.select(*PRESENTATION, finite(F.col("week_from")).alias("a"), finite(F.col("week_to")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND (a > 0 OR b > 0)")
    day = finite(F.col("date"))
    seen = events.select(*PRESENTATION, day_to_week(day).cast("double").alias("a")).where("a IS NOT NULL").withColumn("b", F.col("a"))
    spans = planned.unionByName(seen).groupBy(*PRESENTATION).agg(F.greatest(F.min("a").cast("int"), F.lit(1)).alias("low"), F.max("b").cast("int").alias("high"))
    spans = spans.withColumn("high", F.greatest("low", "high"))
    return _as_weeks(spans, F.format_string("%s_%s_W%02d", *PRESENTATION, "week_index"), F.format_string("%s-%s week %d", *PRESENTATION, "week_index"))


def kdd_course_weeks(dates: DataFrame) -> DataFrame:
    """A row per course and week between its dates; courses without dates have none."""
    known = dates.where("`from` IS NOT NULL AND `to` IS NOT NULL")
    high = F.greatest(F.lit(1), (F.floor(F.datediff("to", "from") / 7) + 1).cast("int"))
    spans = known.select(F.col("course_id").alias("code_module"), F.col("course_id").alias("code_presentation"), F.lit(1).alias("low"), high.alias("high"))
    return _as_weeks(spans, F.format_string("%s_week%d", "code_module", "week_index"), F.format_string("%s Week %d", "code_module", "week_index"))


def prerequisite_edges(competencies: DataFrame, by: list[str] = PRESENTATION) -> DataFrame:
    """From each week to the next one present; by module alone for the second dataset."""
    after = F.lead("competency_id").over(Window.partitionBy(*by).orderBy("week_index"))
    edges = competencies.select(F.col("competency_id").alias("source_competency_id"), F.lit("prerequisiteOf").alias("relation"), after.alias("target_competency_id"), *PRESENTATION)
    return edges.where("target_competency_id IS NOT NULL")
