"""Order of a learner's path through the material against the cohort's canonical order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.columns import KEY, PRESENTATION, average_rank, correlation
from waymark.operators.cohort import at_landmarks

ORDER_COLUMNS = ["trav_reach", "trav_position_mean", "trav_position_std", "trav_backtrack_rate", "trav_below_frontier_rate", "trav_revisit_rate", "trav_step_absmean", "trav_forward_jump_mean", "trav_order_agreement"]
VOLUME_COLUMNS = ["trav_n_events", "trav_n_distinct", "trav_coverage"]


def canonical_order(events: DataFrame, by: list[str] = PRESENTATION) -> DataFrame:
    """Dense rank of a site by the exact median day of its events, and that rank as a share of the last."""
    median = events.groupBy(*by, "id_site").agg(F.median("date").alias("canonical_day"))
    ranked = median.withColumn("canonical_rank", F.dense_rank().over(Window.partitionBy(*by).orderBy("canonical_day")).cast("double"))
    return ranked.withColumn("canonical_norm", F.col("canonical_rank") / F.greatest(F.max("canonical_rank").over(Window.partitionBy(*by)), F.lit(1.0)))


def traversal_features(events: DataFrame, weeks: list[int]) -> DataFrame:
    """KEY, snapshot_week, and the order and volume columns; the order is that of the landmark's own events."""
    by = [*PRESENTATION, "snapshot_week"]
    own = [*KEY, "snapshot_week"]
    rows = at_landmarks(events.select(*KEY, "id_site", "date"), weeks, "date")
    rows = rows.join(canonical_order(rows, by).select(*by, "id_site", F.col("canonical_norm").alias("at")), [*by, "id_site"])
    path = Window.partitionBy(*own).orderBy("date", "at")
    step = F.col("at") - F.lag("at").over(path)
    reached = F.max("at").over(path.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("step", step).withColumn("below", F.col("at") < reached - 1e-9).withColumn("nth", F.row_number().over(path)).withColumn("rank", average_rank(own, "at"))
    moved = F.coalesce("step", F.lit(0.0))
    share = lambda c: F.avg(c.cast("double"))
    out = rows.groupBy(*own).agg(
        F.count(F.lit(1)).alias("trav_n_events"), F.countDistinct("id_site").alias("trav_n_distinct"), F.max("at").alias("trav_reach"), F.avg("at").alias("trav_position_mean"),
        F.coalesce(F.stddev_samp("at"), F.lit(0.0)).alias("trav_position_std"), share(moved < 0).alias("trav_backtrack_rate"), share(F.col("below")).alias("trav_below_frontier_rate"),
        (1 - F.countDistinct("id_site") / F.count(F.lit(1))).alias("trav_revisit_rate"), F.avg(F.abs(moved)).alias("trav_step_absmean"), F.avg(F.greatest(moved, F.lit(0.0))).alias("trav_forward_jump_mean"),
        F.coalesce(F.when((F.count(F.lit(1)) >= 3) & (F.stddev_pop("at") >= 1e-12), correlation(F.col("nth"), F.col("rank"))), F.lit(0.0)).alias("trav_order_agreement"),
    )
    sites = rows.groupBy(*by).agg(F.countDistinct("id_site").alias("available"))
    return out.join(sites, by).withColumn("trav_coverage", F.col("trav_n_distinct") / F.greatest("available", F.lit(1))).drop("available")
