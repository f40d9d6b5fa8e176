"""Discrete-time hazard of leaving in the days after a landmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.columns import KEY, finite, group_id, number
from waymark.operators.models import Config, fit_and_score


def hazard_frame(members: DataFrame, days: int = 7, cluster: str = "presentation") -> DataFrame:
    """A row per valid enrolment and landmark with hazard_event: leaving in [cutoff, cutoff + days)."""
    leave = finite(F.col("date_unregistration"))
    event = F.coalesce((leave >= F.col("cutoff_day")) & (leave < F.col("cutoff_day") + days), F.lit(False)).cast("int")
    rows = members.where("cutoff_valid").withColumn("hazard_event", event).withColumn("landmark_week", F.col("week"))
    return rows.withColumn("split_group", group_id("presentation")).withColumn("cluster_id", group_id(cluster)).withColumn("cluster_unit", F.lit(cluster))


def with_features(frame: DataFrame, features: dict[int, DataFrame]) -> tuple[DataFrame, list[str]]:
    """frame with each landmark's features; columns that a landmark lacks are zero, and landmark_week is one too."""
    every = sorted({c for df in features.values() for c in df.columns if c not in (*KEY, "snapshot_week", "no_activity")})
    union: DataFrame | None = None
    for week, df in features.items():
        rows = df.select(*KEY, F.lit(week).alias("landmark_week"), *[number(F.col(c) if c in df.columns else None).alias(c) for c in every])
        union = rows if union is None else union.unionByName(rows)
    if union is None:
        return frame, ["landmark_week"]
    joined = frame.join(union, [*KEY, "landmark_week"], "left")
    return joined.withColumns({c: number(F.col(c)) for c in every}), [*every, "landmark_week"]


def hazard_scores(frame: DataFrame, folds: DataFrame, name: str, features: list[str], config: Config, limits: dict[str, object] | None = None) -> DataFrame:
    """KEY, landmark_week, hazard_event, model, repeat, fold, p_event: pooled over landmarks, split by presentation."""
    by_group = folds.select("split_group", "repeat", "fold").distinct()
    rows = frame.withColumn("y", F.col("hazard_event")).join(by_group, "split_group")
    out: DataFrame | None = None
    for repeat in range(1, config.repeats + 1):
        for fold in range(1, config.folds + 1):
            mine = rows.where(F.col("repeat") == repeat)
            train, test = mine.where(F.col("fold") != fold), mine.where(F.col("fold") == fold)
            if min(rows_of.select("y").distinct().count() for rows_of in (train, test)) < 2:
                continue
            scored = fit_and_score(name, train, test, features, config.seed + 5000 + repeat * 100 + fold, limits)
            scored = scored.select(*KEY, "landmark_week", "hazard_event", "cluster_id", "cluster_unit", "dataset", F.lit(name).alias("model"), "repeat", "fold", F.col("p_success").alias("p_event"))
            out = scored if out is None else out.unionByName(scored)
    if out is None:
        raise ValueError("no fold has two classes to train on")
    return out


def average_hazard(scores: DataFrame) -> DataFrame:
    """Mean over repeats in the form of a scored panel: success is to stay, the risk is the event."""
    by = [*KEY, "landmark_week", "hazard_event", "cluster_id", "cluster_unit", "dataset", "model"]
    mean = scores.groupBy(*by).agg(F.avg("p_event").alias("risk_score"))
    return mean.select(*KEY, F.col("landmark_week").alias("week"), "cluster_id", "cluster_unit", "dataset", "model", F.lit("discrete_hazard").alias("protocol"), (1 - F.col("hazard_event")).alias("y"), F.col("hazard_event").alias("risk"), "risk_score", (1 - F.col("risk_score")).alias("p_success"))
