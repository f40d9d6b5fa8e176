"""Learner representations from the weekly panel, and their alignment with the roster."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.columns import KEY, number
from waymark.operators.evidence import ASSESS
from waymark.operators.state import chain_features, graph_features
from waymark.operators.traversal import ORDER_COLUMNS

NOT_NUMERIC = {*KEY, "week_index", "competency_id", "competency_id_assessment"}


def _up_to(panel: DataFrame, week: int) -> DataFrame:
    return panel.where(F.col("week_index").between(1, week))


def flat_features(panel: DataFrame, week: int) -> DataFrame:
    """Sum of every numeric evidence column up to the landmark."""
    columns = [c for c in panel.columns if c not in NOT_NUMERIC]
    return _up_to(panel, week).groupBy(*KEY).agg(*[F.sum(number(F.col(c))).alias(c) for c in columns]).withColumn("snapshot_week", F.lit(week))


def _weekly_means(panel: DataFrame, week: int, columns: list[str]) -> DataFrame:
    """<column>_week<k> for k from 1 to the landmark; zero for weeks without a row, clicks as log1p."""
    value = {c: F.greatest(number(F.col(c) if c in panel.columns else None), F.lit(0.0)) for c in columns}
    if "clicks_total" in value:
        value["clicks_total"] = F.log1p(value["clicks_total"])
    each = [F.coalesce(F.avg(F.when(F.col("week_index") == k, value[c])), F.lit(0.0)).alias(f"{c}_week{k}") for c in columns for k in range(1, week + 1)]
    return _up_to(panel, week).groupBy(*KEY).agg(*each)


def temporal_features(panel: DataFrame, week: int) -> DataFrame:
    return _weekly_means(panel, week, ["clicks_total", "active_days", *ASSESS]).withColumn("snapshot_week", F.lit(week))


def flat_at_landmarks(panel: DataFrame, weeks: list[int]) -> DataFrame:
    """flat_features of several landmarks by one plan, each with its snapshot_week."""
    columns = [c for c in panel.columns if c not in NOT_NUMERIC]
    after = F.explode(F.filter(F.array(*map(F.lit, weeks)), lambda w: (F.col("week_index") >= 1) & (F.col("week_index") <= w)))
    return panel.withColumn("snapshot_week", after).groupBy(*KEY, "snapshot_week").agg(*[F.sum(number(F.col(c))).alias(c) for c in columns])


def temporal_at_landmarks(panel: DataFrame, weeks: list[int]) -> DataFrame:
    """temporal_features of several landmarks by one plan: KEY, snapshot_week and their values in the order of the columns, of
    which each landmark has as many as weeks, as the array `values`."""
    columns = ["clicks_total", "active_days", *ASSESS]
    first = _up_to(panel, max(weeks)).groupBy(*KEY).agg(F.min("week_index").alias("first_week"))
    rows = _weekly_means(panel, max(weeks), columns).join(first.hint("merge"), KEY)
    rows = rows.withColumn("snapshot_week", F.explode(F.filter(F.array(*map(F.lit, weeks)), lambda w: F.col("first_week") <= w)))
    each = [F.slice(F.array(*[F.col(f"{c}_week{k}") for k in range(1, max(weeks) + 1)]), F.lit(1), F.col("snapshot_week")) for c in columns]
    return rows.select(*KEY, "snapshot_week", F.concat(*each).alias("values"))


def logistic_features(members: DataFrame, panel: DataFrame, static: DataFrame, weeks: list[int]) -> dict[str, DataFrame]:
    """members (a row per enrolment and landmark, as week) with x by logistic model: the features of the representation, aligned
    as by align_to_roster with the static features as supplement, and at the end no_activity.

    One plan serves all landmarks. Of a profile alone the supplement has all columns, so that the silent have theirs too.
    No table is broadcast: files show few of the bytes that an enrolment's features take in memory.
    """
    by = [*KEY, "week"]
    about = [c for c in static.columns if c.split("_")[0] == "stat"]
    flat = flat_at_landmarks(panel, weeks).withColumnRenamed("snapshot_week", "week")
    sums = [c for c in flat.columns if c not in by]
    flat = flat.select(*by, F.array(*[number(F.col(c)) for c in sums]).alias("values"))
    temporal = temporal_at_landmarks(panel, weeks).withColumnRenamed("snapshot_week", "week")
    active = _up_to(panel, max(weeks)).groupBy(*KEY).agg(F.min("week_index").alias("first_week"))
    rows = members.join(active.hint("merge"), KEY, "left").withColumn("_silent", F.when(F.col("first_week") <= F.col("week"), 0.0).otherwise(1.0)).drop("first_week")
    profile = static.select(*KEY, F.array(*[number(F.col(c)) for c in about]).alias("values"))
    none = {"base_lr_clickstream": F.lit(len(sums)), "base_lr_weekly": F.col("week") * (2 + len(ASSESS)), "base_lr_profile": F.lit(len(about))}
    blocks = {"base_lr_profile": (profile, KEY), "base_lr_clickstream": (flat, by), "base_lr_weekly": (temporal, by)}
    return {
        name: rows.join(block.hint("merge"), on, "left").withColumn("x", F.concat(F.coalesce("values", F.array_repeat(F.lit(0.0), none[name])), F.array("_silent"))).drop("values", "_silent")
        for name, (block, on) in blocks.items()
    }


def with_assessment_weeks(base: DataFrame, panel: DataFrame, week: int) -> DataFrame:
    return with_block(base, _weekly_means(panel, week, ASSESS))


def with_block(base: DataFrame, block: DataFrame, prefixes: tuple[str, ...] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Left join of a block's columns (all, those of the prefixes, or those named); missing and non-finite are zero.

    block has one row per KEY; base keeps its rows.
    """
    keep = [c for c in block.columns if c not in (*KEY, "snapshot_week")]
    keep = [c for c in keep if (prefixes is None or c.split("_")[0] in prefixes) and (columns is None or c in columns)]
    joined = base.join(block.select(*KEY, *keep), KEY, "left")
    return joined.withColumns({c: number(F.col(c)) for c in keep})


def align_to_roster(roster: DataFrame, features: DataFrame, supplements: list[DataFrame]) -> DataFrame:
    """features for every enrolment of the roster, and no_activity.

    A missing value comes from the first supplement (in their order) that has the column and a value, then is zero.
    """
    columns = [c for c in features.columns if c not in (*KEY, "snapshot_week")]
    out = roster.select(*KEY).join(features.select(*KEY, *columns, F.lit(1).alias("_active")), KEY, "left")
    values = {c: [F.col(c)] for c in columns}
    for k, source in enumerate(supplements):
        usable = [c for c in columns if c in source.columns]
        if usable:
            out = out.join(source.groupBy(*KEY).agg(*[F.first(c).alias(f"_{k}_{c}") for c in usable]), KEY, "left")
            for c in usable:
                values[c].append(F.col(f"_{k}_{c}"))
    no_activity = F.when(F.col("_active").isNull(), 1).otherwise(0).alias("no_activity")
    return out.select(*KEY, *[number(F.coalesce(*v)).alias(c) for c, v in values.items()], no_activity)


def representations(panel: DataFrame, week: int, static: DataFrame, behavioural: DataFrame, traversal: DataFrame, seed: int = 42) -> dict[str, Callable[[], DataFrame]]:
    """Builders by model; only those that are called are planned. The blocks are those of the landmark."""
    active = lambda: _up_to(panel, week).select(*KEY).distinct()
    union = lambda: with_block(temporal_features(panel, week), static, ("stat",))

    def stack() -> DataFrame:
        base = with_assessment_weeks(graph_features(panel, week, "residual", seed=seed), panel, week)
        base = with_block(with_block(base, static, ("stat",)), behavioural, ("gap", "time", "cohort"))
        return with_block(base, traversal, columns=ORDER_COLUMNS)

    flat, temporal = (lambda: flat_features(panel, week)), (lambda: temporal_features(panel, week))
    return {
        "flat_hgb": flat, "temporal_hgb": temporal, "pcg_ut": lambda: chain_features(panel, week), "base_lr_profile": lambda: with_block(active(), static, ("stat",)), "base_lr_clickstream": flat,
        "base_lr_weekly": temporal, "base_rf_gini": union, "base_rf_entropy": union, "base_svm": flat, "base_knn": flat, "base_dffnn": union, "stack_7_full": stack,
    }
