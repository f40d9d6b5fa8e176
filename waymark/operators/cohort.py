"""Enrolments at a landmark: membership classes and cohort composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.columns import KEY, is_true


def load_roster(labels: DataFrame, registration: DataFrame | None = None, many: bool = False) -> DataFrame:
    """KEY, label, registration days and risk, one row per KEY: of several labels the first in the source, where the rows
    have a source_order (see order.read_in_order), or else the least. Of many enrolments none are broadcast."""
    chosen = F.min_by("label", "source_order") if "source_order" in labels.columns else F.min("label")
    roster = labels.groupBy(*KEY).agg(chosen.cast("int").alias("label"))
    if registration is None:
        roster = roster.withColumn("date_registration", F.lit(None).cast("double")).withColumn("date_unregistration", F.lit(None).cast("double"))
    else:
        days = registration.groupBy(*KEY).agg(F.min("date_registration").alias("date_registration"), F.min("date_unregistration").alias("date_unregistration"))
        roster = roster.join(days.hint("merge") if many else days, KEY, "left")
    return roster.withColumn("risk", 1 - F.col("label"))


def at_landmarks(rows: DataFrame, weeks: list[int], day: str | None = None) -> DataFrame:
    """Each row once per landmark, as snapshot_week; with a day column only where it lies in [0, 7 * week).

    One scan serves all landmarks, and rows after the last one never leave it.
    """
    landmarks = F.array(*map(F.lit, weeks))
    if day is None:
        return rows.withColumn("snapshot_week", F.explode(landmarks))
    rows = rows.where((F.col(day) >= 0) & (F.col(day) < 7 * max(weeks)))
    return rows.withColumn("snapshot_week", F.explode(F.filter(landmarks, lambda w: F.col(day) < 7 * w)))


def membership(roster: DataFrame, evidence: DataFrame, weeks: list[int], dataset: str = "oulab", parts: int | None = None) -> DataFrame:
    """Every labelled enrolment at every landmark with its flags and class.

    evidence has KEY and week_index; an enrolment is active at a landmark from its first week of evidence on. Enrolments
    are dealt to so many tasks (parts) before landmarks, and what callers add, multiply them; None leaves that to Spark,
    which sees only how small they are before.
    """
    # Weeks after the last landmark make none active, and need not leave the scan.
    first = evidence.where(F.col("week_index").between(1, max(weeks))).groupBy(*KEY).agg(F.min("week_index").alias("first_week"))
    rows = roster.join(first.hint("merge") if parts else first, KEY, "left")
    rows = at_landmarks(rows.repartition(parts, *KEY) if parts else rows, weeks).withColumnRenamed("snapshot_week", "week")
    rows = rows.withColumn("has_activity", is_true(F.col("first_week") <= F.col("week"))).drop("first_week")
    rows = rows.withColumn("no_activity", (~F.col("has_activity")).cast("int")).withColumn("cutoff_day", 7 * F.col("week"))
    if dataset == "oulab":
        day, leave = F.col("date_registration"), F.col("date_unregistration")
        rows = rows.withColumn("registered_by_cutoff", day.isNull() | is_true(day < F.col("cutoff_day"))).withColumn("outcome_realized", is_true(leave < F.col("cutoff_day")))
        rows = rows.withColumn("cutoff_valid", F.col("registered_by_cutoff") & ~F.col("outcome_realized"))
    else:
        rows = rows.withColumn("registered_by_cutoff", F.lit(True)).withColumn("outcome_realized", F.lit(False)).withColumn("cutoff_valid", F.lit(True))
    active = F.when(F.col("has_activity"), "active").otherwise("silent")
    kind = F.when(~F.col("registered_by_cutoff"), "not_yet_registered").when(F.col("outcome_realized"), F.concat(F.lit("outcome_realized_"), active)).otherwise(F.concat(F.lit("eligible_"), active))
    return rows.withColumn("membership_class", kind).withColumn("activity_conditioned", F.col("has_activity")).withColumn("static_full", F.lit(True)).withColumn("dataset", F.lit(dataset))


def composition_flow(members: DataFrame) -> DataFrame:
    """Number and risk rate by dataset, week and class."""
    return members.groupBy("dataset", "week", "membership_class").agg(F.count("label").alias("n"), F.avg("risk").alias("risk_rate"))


def composition_totals(members: DataFrame) -> DataFrame:
    """Sizes of the populations by dataset and week."""
    size = lambda c: F.count_if(F.col(c)).alias(f"n_{c}")
    named = members.withColumnRenamed("activity_conditioned", "activity").withColumnRenamed("static_full", "static")
    return named.groupBy("dataset", "week").agg(F.count("label").alias("n_labelled"), *map(size, ("activity", "static", "cutoff_valid", "outcome_realized")))


def composition_indices(members: DataFrame) -> DataFrame:
    """Counts and validity indices by dataset and week; a ratio without a denominator is null."""
    active, valid, realized = F.col("activity_conditioned"), F.col("cutoff_valid"), F.col("outcome_realized")
    n = lambda c: F.count_if(c)
    risk = lambda c: F.avg(F.when(c, F.col("risk")))
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    silent, present = valid & ~F.col("has_activity"), valid & F.col("has_activity")
    columns: dict[str, Column] = {
        "n_activity": n(active), "n_cutoff_valid": n(valid), "known_outcomes_in_activity": n(active & realized), "eligible_silent_excluded": n(silent), "eligible_active": n(present),
        "activity_contamination_rate": ratio(n(active & realized), n(active)), "silent_exclusion_rate": ratio(n(silent), n(valid)),
        "cohort_jaccard": ratio(n(active & valid), n(active | valid)), "silent_risk_rate": risk(silent), "eligible_active_risk_rate": risk(present),
        "risk_concentration_ratio": ratio(risk(silent), risk(present)),
    }
    return members.groupBy("dataset", "week").agg(*[c.alias(k) for k, c in columns.items()])
