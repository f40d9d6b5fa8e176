"""Behavioural features at landmarks: gaps, timing of submissions, standing in the cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.columns import KEY, PRESENTATION, finite, is_true, share_rank, z_score
from waymark.operators.cohort import at_landmarks
from waymark.operators.evidence import admissible_submissions


def gap_features(events: DataFrame, weeks: list[int]) -> DataFrame:
    """Inactivity of every active learner: KEY, snapshot_week and eleven gap_ columns.

    Clicks are summed by day before landmarks multiply the rows.
    """
    daily = events.where((F.col("date") >= 0) & (F.col("date") < 7 * max(weeks))).groupBy(*KEY, "date").agg(F.sum("sum_click").alias("clicks"))
    # The gap before a day does not depend on the landmark, so one window serves all.
    daily = daily.withColumn("gap", F.col("date") - F.lag("date").over(Window.partitionBy(*KEY).orderBy("date")))
    rows = at_landmarks(daily, weeks, "date").withColumn("left", 7 * F.col("snapshot_week") - F.col("date"))
    sums = lambda c: F.coalesce(F.sum(F.when(c, F.col("clicks"))), F.lit(0))
    out = rows.groupBy(*KEY, "snapshot_week").agg(
        F.count("date").alias("gap_active_days"), F.min("date").alias("gap_first_day"), F.max("date").alias("gap_last_day"), F.min("left").alias("gap_days_since_last"),
        F.max("gap").alias("m"), F.avg("gap").alias("a"), F.stddev_samp("gap").alias("s"), sums(F.col("left") <= 14).alias("recent"), sums((F.col("left") > 14) & (F.col("left") <= 28)).alias("earlier"),
    )
    span = F.col("gap_last_day") - F.col("gap_first_day")
    since = F.col("gap_days_since_last").cast("double")
    return out.select(
        *KEY, "snapshot_week", "gap_active_days", "gap_first_day", "gap_last_day", F.coalesce("m", since).alias("gap_max"), F.coalesce("a", since).alias("gap_mean"), F.coalesce("s", F.lit(0.0)).alias("gap_std"),
        "gap_days_since_last", span.alias("gap_span"), (F.col("gap_active_days") / F.greatest(span, F.lit(1))).alias("gap_density"),
        ((F.col("recent") + 1.0) / (F.col("earlier") + 1.0)).alias("gap_momentum"), F.log1p("recent").alias("gap_recent_clicks"),
    )


def timing_features(roster: DataFrame, submissions: DataFrame, assessments: DataFrame, weeks: list[int]) -> DataFrame:
    """Lateness and missed assessments of every enrolment of the roster, submitters or not."""
    schedule = assessments.select("id_assessment", *PRESENTATION, finite(F.col("date")).alias("due_day"), F.col("weight").cast("double").alias("weight"))
    rows = at_landmarks(admissible_submissions(submissions).join(F.broadcast(schedule), "id_assessment", "left"), weeks, "date_submitted")
    late = F.col("date_submitted") - F.col("due_day")
    rows = rows.withColumn("late", late).withColumn("was_due", is_true(F.col("due_day") < 7 * F.col("snapshot_week")))
    place = F.struct("date_submitted", "id_assessment")
    made = rows.groupBy(*KEY, "snapshot_week").agg(
        F.count("id_assessment").alias("time_submissions"), F.avg("late").alias("mean"), F.max("late").alias("max"), F.max_by(F.col("late"), F.when(F.col("late").isNotNull(), place)).alias("last"),
        F.avg(is_true(F.col("late") > 0).cast("double")).alias("rate"), F.sum("weight").alias("done"), F.count_if("was_due").alias("due_done"),
    )
    due = at_landmarks(schedule.where("due_day IS NOT NULL").withColumn("day", F.greatest("due_day", F.lit(0.0))), weeks, "day").groupBy(*PRESENTATION, "snapshot_week").agg(F.count("id_assessment").alias("due"), F.sum("weight").alias("due_weight"))
    out = at_landmarks(roster.select(*KEY).distinct(), weeks).join(made, [*KEY, "snapshot_week"], "left").join(due, [*PRESENTATION, "snapshot_week"], "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    missed = F.greatest(zero("due") - zero("due_done"), F.lit(0.0))
    return out.select(
        *KEY, "snapshot_week", zero("time_submissions").alias("time_submissions"), zero("mean").alias("time_lateness_mean"), zero("max").alias("time_lateness_max"), zero("last").alias("time_lateness_last"),
        zero("rate").alias("time_late_rate"), (-zero("mean")).alias("time_earliness_mean"), missed.alias("time_missed"), (missed / F.greatest(zero("due"), F.lit(1.0))).alias("time_missed_rate"),
        (zero("done") / F.greatest(zero("due_weight"), F.lit(1.0))).alias("time_weight_completed"),
    )


def cohort_features(events: DataFrame, weeks: list[int]) -> DataFrame:
    """Share rank and z-score of clicks, days and sites among the active learners of the presentation."""
    # Clicks are summed by day and site before landmarks multiply the rows.
    daily = events.where((F.col("date") >= 0) & (F.col("date") < 7 * max(weeks))).groupBy(*KEY, "id_site", "date").agg(F.sum("sum_click").alias("sum_click"))
    base = at_landmarks(daily, weeks, "date").groupBy(*KEY, "snapshot_week").agg(F.sum("sum_click").alias("clicks"), F.countDistinct("date").alias("days"), F.countDistinct("id_site").alias("sites"))
    by = [*PRESENTATION, "snapshot_week"]
    columns = []
    for name in ("clicks", "days", "sites"):
        columns += [share_rank(by, name).alias(f"cohort_{name}_pct"), z_score(F.col(name), Window.partitionBy(*by)).alias(f"cohort_{name}_z")]
    return base.select(*KEY, "snapshot_week", *columns)


def behavioural_features(events: DataFrame, roster: DataFrame, submissions: DataFrame, assessments: DataFrame, weeks: list[int]) -> DataFrame:
    """The three blocks in full outer joins: enrolments of the roster and active learners."""
    on = [*KEY, "snapshot_week"]
    return gap_features(events, weeks).join(timing_features(roster, submissions, assessments, weeks), on, "full").join(cohort_features(events, weeks), on, "full")
