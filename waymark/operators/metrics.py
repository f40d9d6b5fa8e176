"""Exact, tie-aware metrics of scored enrolments, for any number of cells in one plan.

A cell's scores are first counted by distinct value, so everything after works on thresholds and not on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.sources.scratch import stored

METRICS = ["auc", "pr_auc_risk", "brier", "ece"]
#: The inner edges of ten equal bins as doubles; 0.3, 0.6 and 0.7 are the products of 0.1 as computed.
EDGES = [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]
#: The columns of a scored panel.
PANEL = ["dataset", "week", "protocol", "train_protocol", "eval_protocol", "model", "id_student", "code_module", "code_presentation", "y", "risk", "has_activity", "no_activity", "outcome_realized", "cutoff_valid", "membership_class", "cluster_id", "cluster_unit"]
#: Cells whose training and evaluation populations differ.
CROSS = {"activity_to_cutoff_valid": ("activity_conditioned", "cutoff_valid"), "cutoff_valid_to_activity": ("cutoff_valid", "activity_conditioned")}


def with_arms(predictions: DataFrame) -> DataFrame:
    """Fill in train_protocol and eval_protocol where a table lacks them."""
    for k, name in enumerate(("train_protocol", "eval_protocol")):
        if name not in predictions.columns:
            arm: Column = F.col("protocol")
            for cell, arms in CROSS.items():
                arm = F.when(F.col("protocol") == cell, arms[k]).otherwise(arm)
            predictions = predictions.withColumn(name, arm)
    return predictions


def average_repeats(predictions: DataFrame) -> DataFrame:
    """One row per scored enrolment and cell: mean scores, sample deviation and number of repeats."""
    return with_arms(predictions).groupBy(*PANEL).agg(
        F.avg("p_success").alias("p_success"), F.avg("risk_score").alias("risk_score"), F.stddev_samp("p_success").alias("prediction_sd"), F.countDistinct("repeat").alias("n_repeats")
    )


def threshold_counts(scored: DataFrame, keys: list[str], cluster: str | None = None) -> DataFrame:
    """keys (and the cluster), p, and the successes s and failures f that score p."""
    by = [*keys, *([cluster] if cluster else [])]
    return scored.groupBy(*by, F.col("p_success").alias("p")).agg(F.sum(F.col("y").cast("long")).alias("s"), F.sum((1 - F.col("y")).cast("long")).alias("f"))


def sliced(counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts, stored, with r = 1 - p and a slice of their cell's risk, from the riskiest on. Slices are the partitions of
    a range shuffle, cut at quantiles of all rows, so they are of one size whatever the scores; peers in r share one."""
    order = [*keys, F.desc("r")]
    return stored(counts.withColumn("r", 1 - F.col("p")).repartitionByRange(*order).withColumn("slice", F.spark_partition_id()), "slices")


def metrics_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """n and the four metrics per cell from counts of distinct thresholds; null where a cell holds one class only."""
    rows = sliced(counts.withColumn("n", F.col("s") + F.col("f")).where("n > 0"), keys)
    # A cell's slices are each sorted by a task of its own; what lies in riskier slices is added from their totals.
    riskier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(riskier), F.lit(0))
    totals = rows.groupBy(*keys, "slice").agg(F.sum("f").alias("f"), F.sum("n").alias("n")).select(*keys, "slice", before("f").alias("f_before"), before("n").alias("n_before"))
    rows = rows.join(totals, [*keys, "slice"])
    inside = Window.partitionBy(*keys, "slice")
    rising = inside.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Peers in r share a threshold of the risk ranking: the default frame takes them together.
    falling = inside.orderBy(F.desc("r"))
    rows = rows.withColumn("below", F.col("f_before") + F.sum("f").over(rising) - F.col("f")).withColumn("caught", F.col("f_before") + F.sum("f").over(falling)).withColumn("flagged", F.col("n_before") + F.sum("n").over(falling))
    successes, failures, n = F.sum("s"), F.sum("f"), F.sum("n")
    off = F.col("s") - F.col("n") * F.col("p")
    place = F.size(F.filter(F.array(*map(F.lit, EDGES)), lambda e: e <= F.col("p")))
    ece: Column = F.lit(0.0)
    for k in range(len(EDGES) + 1):
        ece = ece + F.coalesce(F.abs(F.sum(F.when(place == k, off))), F.lit(0.0))
    both = (successes > 0) & (failures > 0)
    columns = {
        "auc": F.sum(F.col("s") * (F.col("below") + F.col("f") / 2)) / (successes.cast("double") * failures),
        "pr_auc_risk": F.sum(F.when(F.col("f") > 0, F.col("f") * F.col("caught") / F.col("flagged")).otherwise(0.0)) / failures,
        "brier": F.sum(F.col("s") * (1 - F.col("p")) * (1 - F.col("p")) + F.col("f") * F.col("p") * F.col("p")) / n,
        "ece": ece / n,
    }
    return rows.groupBy(*keys).agg(n.alias("n"), *[F.when(both, c).alias(k) for k, c in columns.items()])


def cell_metrics(scored: DataFrame, keys: list[str]) -> DataFrame:
    """n, auc, pr_auc_risk, brier and ece of y and p_success per cell."""
    return metrics_of_counts(threshold_counts(scored, keys), keys)


def stratum_summary(predictions: DataFrame) -> DataFrame:
    """Metrics of the valid active and the valid silent, for both training arms."""
    strata = predictions.where(F.col("protocol").isin("activity_to_cutoff_valid", "cutoff_valid") & F.col("membership_class").isin("eligible_active", "eligible_silent"))
    keys = ["dataset", "week", "model", "protocol", "membership_class"]
    about = with_arms(strata).groupBy(*keys).agg(
        F.first("train_protocol").alias("train_protocol"), F.first("eval_protocol").alias("eval_protocol"), F.countDistinct("cluster_id").alias("n_clusters"), F.avg("risk").alias("risk_rate"), F.avg("risk_score").alias("mean_predicted_risk")
    )
    return about.join(cell_metrics(strata, keys), keys)
