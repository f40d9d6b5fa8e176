"""Cluster bootstrap of the metrics and of contrasts between training and evaluation populations.

A draw takes as many clusters as there are, each slot by a hash of the seed, the draw and the slot, so draws are made where
they are used and come out alike on every engine and cluster. One table of draws over the sorted clusters serves all
cells, so contrasts between cells are paired. Counts by threshold and cluster are cut into slices of the risk, and each
task weighs a slice by all draws; what riskier slices hold is carried in from their totals. The points are one more draw,
which takes every cluster once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.operators.checks import require_unmatched, without_match
from waymark.operators.metrics import EDGES, METRICS, sliced, threshold_counts
from waymark.operators.order import numbered
from waymark.sources.scratch import stored

AA, VV, AV, VA = "activity_conditioned", "cutoff_valid", "activity_to_cutoff_valid", "cutoff_valid_to_activity"
#: Contrasts as weights of the cells AA, AV, VA, VV.
CONTRASTS = {
    "joint_population_difference": (1.0, 0.0, 0.0, -1.0),
    "evaluation_population_component": (1.0, -1.0, 0.0, 0.0),
    "training_population_component": (0.0, 1.0, 0.0, -1.0),
    "training_population_component_at_activity": (1.0, 0.0, -1.0, 0.0),
    "evaluation_population_component_at_valid": (0.0, 0.0, 1.0, -1.0),
    "evaluation_population_shapley": (0.5, -0.5, 0.5, -0.5),
    "training_population_shapley": (0.5, 0.5, -0.5, -0.5),
}
CELLS = (AA, AV, VA, VV)
#: The draw that takes every row once: the point values.
POINT = -1
#: Products of a count and a weight that are held at once, at most about so many.
PRODUCTS = 2_000_000
#: A product of matrices takes so many cells in the time that a row takes when its weights are looked up.
DENSE = 40
#: Rows of draws that are broadcast at most; more are joined by a sort.
HELD = 500_000
#: Hexadecimal digits of a slot's hash that choose its cluster.
DIGITS = 13
_SUMS = ["successes", "failures", "auc_sum", "ap_sum", "brier_sum", *[f"off{k}" for k in range(len(EDGES) + 1)]]


def clusters_of(predictions: DataFrame) -> DataFrame:
    """The distinct clusters as strings, and where rows have a source_order its first in each; null is no cluster."""
    names = predictions.withColumn("cluster_id", F.col("cluster_id").cast("string")).where("cluster_id IS NOT NULL")
    if "source_order" in predictions.columns:
        return names.groupBy("cluster_id").agg(F.min("source_order").alias("source_order"))
    return names.select("cluster_id").distinct()


def draw_table(clusters: DataFrame, n_boot: int, seed: int = 42) -> DataFrame:
    """draw, cluster_id, w: how often each draw takes a cluster; rows with w = 0 are left out.

    The weights of a draw add up to the number of clusters. Slot k of draw d takes the cluster whose place is the leading
    DIGITS of md5("seed:d:k") modulo their number; places are by first occurrence where clusters have a source_order, or
    else by name.
    """
    place = "source_order" if "source_order" in clusters.columns else "cluster_id"
    names = stored(numbered(clusters, place).select("cluster_id", "nth"), "clusters")
    n = names.count()
    slots = names.sparkSession.range(n_boot * n).select(F.floor(F.col("id") / max(n, 1)).cast("int").alias("draw"), (F.col("id") % max(n, 1)).alias("slot"))
    picked = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "draw", "slot").cast("binary")), 1, DIGITS), 16, 10).cast("long") % max(n, 1)
    counts = slots.groupBy("draw", picked.alias("nth")).agg(F.count(F.lit(1)).cast("int").alias("w"))
    return counts.join(names, "nth").select("draw", "cluster_id", "w")


def _weighted(threshold: np.ndarray, cluster: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Draws x thresholds: the counts of each threshold's clusters (rows, sorted by threshold) weighed by the draws
    (draws x clusters)."""
    t, c = int(threshold[-1]) + 1, weights.shape[1]
    if t * c <= DENSE * len(counts):
        dense = np.zeros((t, c))
        np.add.at(dense, (threshold, cluster), counts)
        return weights @ dense.T
    starts = np.flatnonzero(np.r_[True, threshold[1:] != threshold[:-1]])
    return np.add.reduceat(weights[:, cluster] * counts, starts, axis=1)


class Slice:
    """The rows of a cell's slice by rising p, and the weights of their clusters by draw."""

    def __init__(self, rows: pa.Table, drawn: pa.Table):
        order = np.argsort(rows.column("p").to_numpy(), kind="stable")
        self.p = rows.column("p").to_numpy()[order]
        self.s, self.f = (rows.column(c).to_numpy()[order].astype(float) for c in "sf")
        names = rows.column("cluster_id").combine_chunks().dictionary_encode()
        # Rows without a cluster count for the points only.
        code = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False)[order]
        place = {c: k for k, c in enumerate(names.dictionary.to_pylist())}
        self.draws = np.unique(np.concatenate([[POINT], *[d.values.to_numpy() for d in drawn.column("draws")]]))
        self.weights = np.zeros((len(self.draws), len(place) + 1))
        self.weights[0] = 1
        for cluster, draws, weights in zip(*[drawn.column(c) for c in ("cluster_id", "draws", "weights")]):
            self.weights[np.searchsorted(self.draws, draws.values.to_numpy()), place[cluster.as_py()]] = weights.values.to_numpy()
        self.cluster = code

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(draws, p, s, f) for so many draws at once that their products fit."""
        p, threshold = np.unique(self.p, return_inverse=True)
        step = max(1, PRODUCTS // len(self.p))
        for k in range(0, len(self.draws), step):
            w = self.weights[k : k + step]
            yield self.draws[k : k + step], p, _weighted(threshold, self.cluster, self.s, w), _weighted(threshold, self.cluster, self.f, w)


def _totals(rows: pa.Table, drawn: pa.Table) -> dict[str, np.ndarray]:
    own = Slice(rows, drawn)
    f, s = (own.weights @ np.bincount(own.cluster, x, own.weights.shape[1]) for x in (own.f, own.s))
    return {"draw": own.draws, "f": f, "n": f + s}


def _sums(rows: pa.Table, drawn: pa.Table) -> dict[str, np.ndarray]:
    """A slice's part of the metrics' sums for every draw, given the failures and rows of riskier slices."""
    own, before = Slice(rows, drawn.filter(pa.compute.is_valid(drawn.column("cluster_id")))), drawn.filter(pa.compute.is_null(drawn.column("cluster_id")))
    f_before, n_before = (dict(zip(before.column("draws")[0].as_py(), before.column(c)[0].as_py())) for c in ("failures", "rows"))
    out = []
    for draws, p, s, f in own.blocks():
        last = np.searchsorted(-(1 - p), -(1 - p), side="right") - 1  # of the thresholds that tie as risks
        carried = lambda held: np.array([held[d] for d in draws.tolist()])[:, None]
        n = s + f
        below, flagged = carried(f_before) + np.cumsum(f, 1), (carried(n_before) + np.cumsum(n, 1))[:, last]
        bins = np.searchsorted(EDGES, p, side="right")
        off = s - n * p
        with np.errstate(divide="ignore", invalid="ignore"):
            ap = np.where(f > 0, f * below[:, last] / flagged, 0.0).sum(1)
        each = [s.sum(1), f.sum(1), (s * (below - f / 2)).sum(1), ap, (s * (1 - p) ** 2 + f * p**2).sum(1), *[off[:, bins == k].sum(1) for k in range(len(EDGES) + 1)]]
        out.append([draws, *each])
    return dict(zip(["draw", *_SUMS], (np.concatenate(x) for x in zip(*out))))


def metric_draws(predictions: DataFrame, draws: DataFrame, keys: list[str], points: bool = False) -> DataFrame:
    """n and the four metrics per cell and draw, as metrics_of_counts has them, and with points those of draw POINT; cells
    that a draw leaves empty have no row.

    A task holds the counts by threshold and cluster of one slice of a cell, and the weights of the clusters in it.
    """
    counts = threshold_counts(predictions, keys, "cluster_id").withColumn("cluster_id", F.col("cluster_id").cast("string"))
    rows = sliced(counts.where("s + f > 0"), keys)
    by = [*keys, "slice"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    head = ", ".join(f"`{k}` {kinds[k]}" for k in by)
    weights = draws.groupBy(F.col("cluster_id").alias("_cluster")).agg(F.collect_list("draw").alias("draws"), F.collect_list(F.col("w").cast("double")).alias("weights"))
    needed = rows.where("cluster_id IS NOT NULL").select(*by, "cluster_id").distinct().join(weights, F.col("cluster_id") == F.col("_cluster")).drop("_cluster")
    left = rows.select(*by, "p", "s", "f", "cluster_id")

    def each(make, right: DataFrame, shape: str) -> DataFrame:
        def run(key: tuple, own: pa.Table, drawn: pa.Table) -> pa.Table:
            if not len(own):
                return schema.empty_table()
            made = make(own, drawn)
            values = {k: pa.array(v) for k, v in made.items()}
            head = {k: pa.repeat(v, len(made["draw"])) for k, v in zip(by, key)}
            return pa.table(head | values).cast(schema)

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        schema = to_arrow_schema(StructType.fromDDL(f"{head}, {shape}"))
        # A side's columns are its own, though both come from one table.
        return left.toDF(*left.columns).groupBy(*by).cogroup(right.toDF(*right.columns).groupBy(*by)).applyInArrow(run, f"{head}, {shape}")

    totals = each(_totals, needed, "draw int, f double, n double")
    riskier = Window.partitionBy(*keys, "draw").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, "draw", *[F.coalesce(F.sum(c).over(riskier), F.lit(0.0)).alias(c) for c in ("f", "n")])
    before = before.groupBy(*by).agg(F.collect_list("draw").alias("draws"), F.collect_list("f").alias("failures"), F.collect_list("n").alias("rows"))
    held = needed.unionByName(before, allowMissingColumns=True)
    sums = each(_sums, held, "draw int, " + ", ".join(f"{c} double" for c in _SUMS))
    total = sums.groupBy(*keys, "draw").agg(*[F.sum(c).alias(c) for c in _SUMS])
    s, f = F.col("successes"), F.col("failures")
    n = s + f
    off = sum((F.abs(f"off{k}") for k in range(len(EDGES) + 1)), F.lit(0.0))
    values = [F.col("auc_sum") / (s * f), F.col("ap_sum") / f, F.col("brier_sum") / n, off / n]
    found = total.where(n > 0).select(*keys, "draw", n.cast("long").alias("n"), *[F.when((s > 0) & (f > 0), v).alias(m) for m, v in zip(METRICS, values)])
    return found if points else found.where(F.col("draw") != POINT)


def _points_and_draws(predictions: DataFrame, draws: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The points by metric, and the draws by metric, from one pass."""
    rows = stored(metric_draws(predictions, draws, keys, points=True), "metric-draws")
    return long_metrics(rows.where(F.col("draw") == POINT), keys), long_metrics(rows.where(F.col("draw") != POINT), [*keys, "draw"])


def long_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per metric."""
    return rows.unpivot(keys, METRICS, "metric", "value")


def interval(value: str = "value") -> list[Column]:
    """The exact 2.5 and 97.5 per cent quantiles of the draws that are defined."""
    return [F.percentile(value, q).alias(name) for q, name in ((0.025, "ci_low"), (0.975, "ci_high"))]


def summary(predictions: DataFrame, draws: DataFrame) -> DataFrame:
    """Point estimate and interval per dataset, week, protocol, model and metric."""
    keys = ["dataset", "week", "protocol", "model"]
    points, spread = _points_and_draws(predictions, draws, keys)
    points = points.withColumnRenamed("value", "point")
    about = predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cluster_id").alias("n_clusters"), F.first("cluster_unit").alias("cluster_unit"))
    return points.join(about, keys).join(spread.groupBy(*keys, "metric").agg(*interval()), [*keys, "metric"], "left")


def distortion(predictions: DataFrame, draws: DataFrame, reference: str = VV) -> DataFrame:
    """Difference of every protocol from the reference, paired on the draw."""
    keys = ["dataset", "week", "model"]

    def against(rows: DataFrame, on: list[str]) -> DataFrame:
        base = rows.where(F.col("protocol") == reference).select(*on, F.col("value").alias("base"))
        return rows.where(F.col("protocol") != reference).join(base, on).withColumn("value", F.col("value") - F.col("base")).drop("base")

    points, spread = _points_and_draws(predictions, draws, [*keys, "protocol"])
    points, spread = against(points, [*keys, "metric"]), against(spread, [*keys, "draw", "metric"])
    by = [*keys, "protocol", "metric"]
    return points.withColumnRenamed("value", "delta").join(spread.groupBy(*by).agg(*interval()), by, "left").withColumn("reference_protocol", F.lit(reference))


def contrast_values(rows: DataFrame, keys: list[str]) -> DataFrame:
    """contrast and value per cell from protocol, metric and value; cells without all four protocols are left out."""
    of = lambda cell, value: F.max(F.when(F.col("protocol") == cell, value))
    wide = rows.where(F.col("protocol").isin(*CELLS)).groupBy(*keys, "metric").agg(*[of(c, F.col("value")).alias(c) for c in CELLS], *[of(c, F.lit(True)).alias(f"has_{c}") for c in CELLS])
    wide = wide.where(" AND ".join(f"has_{c}" for c in CELLS))
    each = []
    for name, weights in CONTRASTS.items():
        value: Column = F.lit(0.0)
        for cell, weight in zip(CELLS, weights):
            value = value + weight * F.col(cell) if weight else value
        each.append(F.struct(F.lit(name).alias("contrast"), value.alias("value")))
    return wide.withColumn("c", F.explode(F.array(*each))).select(*keys, "metric", "c.contrast", "c.value")


def decomposition(predictions: DataFrame, draws: DataFrame) -> DataFrame:
    """The seven contrasts per week, model and metric with paired intervals and the residual of the identity.

    Under one set of folds the symmetric components add up to the joint difference, so identity_residual is about 0.
    """
    keys = ["dataset", "week", "model"]
    points, spread = _points_and_draws(predictions, draws, [*keys, "protocol"])
    points, spread = contrast_values(points, keys), contrast_values(spread, [*keys, "draw"])
    by = [*keys, "metric"]
    term = lambda name: F.max(F.when(F.col("contrast") == name, F.col("value")))
    residual = points.groupBy(*by).agg((term("joint_population_difference") - term("evaluation_population_shapley") - term("training_population_shapley")).alias("identity_residual"))
    side = {}
    for k, sign in (("left_protocol", 1), ("right_protocol", -1)):
        name: Column = F.lit("combination")
        for contrast, weights in CONTRASTS.items():
            own = [c for c, w in zip(CELLS, weights) if w * sign > 0]
            if len(own) == 1:
                name = F.when(F.col("contrast") == contrast, own[0]).otherwise(name)
        side[k] = name
    out = points.withColumnRenamed("value", "delta").join(residual, by).join(spread.groupBy(*by, "contrast").agg(*interval()), [*by, "contrast"], "left")
    return out.withColumns(side)


def aggregate(predictions: DataFrame, draws: DataFrame) -> DataFrame:
    """Mean of each contrast over all weeks and models, draw by draw, and the difference of the components' sizes.

    A draw in which some cell is undefined is undefined and takes no part in the interval.
    """
    keys = ["dataset", "week", "model"]
    points, spread = _points_and_draws(predictions, draws, [*keys, "protocol"])
    points, spread = contrast_values(points, keys), contrast_values(spread, [*keys, "draw"])
    cells = points.select(*keys).distinct().count()

    def sizes(rows: DataFrame, by: list[str]) -> DataFrame:
        term = lambda name: F.max(F.when(F.col("contrast") == name, F.abs("value")))
        extra = rows.groupBy(*by).agg((term("evaluation_population_shapley") - term("training_population_shapley")).alias("value"))
        return rows.unionByName(extra.withColumn("contrast", F.lit("absolute_evaluation_minus_absolute_training")))

    mean = sizes(points.groupBy("metric", "contrast").agg(F.avg("value").alias("value")), ["metric"]).withColumnRenamed("value", "point_mean")
    per_draw = spread.groupBy("draw", "metric", "contrast").agg(F.when(F.count("value") == cells, F.avg("value")).alias("value"))
    per_draw = sizes(per_draw, ["draw", "metric"])
    by = ["metric", "contrast"]
    return mean.join(per_draw.groupBy(*by).agg(F.avg("value").alias("bootstrap_mean"), *interval(), F.count("value").alias("finite_draws")), by).withColumn("cells", F.lit(cells))


def paired_difference(first: DataFrame, second: DataFrame, draws: DataFrame) -> DataFrame:
    """Difference of two analyses' contrasts over the (week, model) cells that both hold, paired on the draw."""
    keys = ["dataset", "week", "model"]
    shared = first.select(*keys).distinct().intersect(second.select(*keys).distinct())
    arms = []
    for arm in (first, second):
        rows = metric_draws(arm.join(shared, keys, "left_semi"), draws, [*keys, "protocol"])
        values = contrast_values(long_metrics(rows, [*keys, "protocol", "draw"]), [*keys, "draw"])
        arms.append(values.groupBy("draw", "metric", "contrast").agg(F.avg("value").alias(f"value{len(arms)}")))
    joined = arms[0].join(arms[1], ["draw", "metric", "contrast"]).withColumn("value", F.col("value0") - F.col("value1"))
    return joined.groupBy("metric", "contrast").agg(F.avg("value").alias("bootstrap_mean"), *interval(), F.count("value").alias("finite_draws"))


def tie_partition_audit(predictions: DataFrame) -> DataFrame:
    """Per cell, how many neighbouring distinct p fall on one value of 1 - p (and so tie as risks only)."""
    keys = ["dataset", "week", "protocol", "model"]
    distinct = predictions.groupBy(*keys).agg(F.countDistinct("p_success").alias("n_p"), F.countDistinct(1 - F.col("p_success")).alias("n_risk"))
    return distinct.withColumn("merged_thresholds", F.col("n_p") - F.col("n_risk"))


def exclusion_counts(intervals: DataFrame) -> DataFrame:
    """Per metric and contrast: cells, those whose interval lies above or below zero, median and mean difference."""
    return intervals.groupBy("metric", "contrast").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).alias("excluding_zero"), F.median("delta").alias("median_delta"), F.avg("delta").alias("mean_delta")
    )


def row_weighted_precision(predictions: DataFrame, draws: DataFrame, keys: list[str]) -> DataFrame:
    """keys, draw, pr_auc_risk by a second way: every row weighed by its cluster's draw, rows of one risk taken together,
    and precision read off along the falling risk. For few draws, as rows are multiplied by them."""
    # Said which side is broadcast: the files of a stored panel are small for its rows, so Spark would take the panel.
    drawn = draws.select("cluster_id", "draw", "w")
    drawn = F.broadcast(drawn) if drawn.count() <= HELD else drawn.hint("merge")
    rows = predictions.withColumn("cluster_id", F.col("cluster_id").cast("string")).join(drawn, "cluster_id")
    failures = F.col("w") * (1 - F.col("y"))
    tied = rows.groupBy(*keys, "draw", (1 - F.col("p_success")).alias("risk")).agg(F.sum(failures).alias("f"), F.sum("w").alias("n"))
    falling = Window.partitionBy(*keys, "draw").orderBy(F.desc("risk"))
    along = tied.select(*keys, "draw", "f", "n", F.sum("f").over(falling).alias("caught"), F.sum("n").over(falling).alias("flagged"))
    one_class = (F.sum("f") == 0) | (F.sum("f") == F.sum("n"))
    return along.groupBy(*keys, "draw").agg(F.when(~one_class, F.sum(F.col("f") * (F.col("caught") / F.col("flagged"))) / F.sum("f")).alias("pr_auc_risk"))


def cross_check(predictions: DataFrame, draws: DataFrame, keys: list[str], chosen: list[int], tolerance: float = 5e-14) -> DataFrame:
    """keys, draw, both values and their difference for the chosen draws where the two ways differ by more than the
    tolerance, or only one is defined: no rows if they agree."""
    own = draws.where(F.col("draw").isin(chosen))
    first = metric_draws(predictions, own, keys).select(*keys, "draw", F.col("pr_auc_risk").alias("first"))
    second = row_weighted_precision(predictions, own, keys).withColumnRenamed("pr_auc_risk", "second")
    both = first.join(second, [*keys, "draw"], "full").withColumn("difference", F.abs(F.col("first") - F.col("second")))
    return both.where((F.col("difference") > tolerance) | (F.col("first").isNull() != F.col("second").isNull()))


def renew_precision(table: DataFrame, predictions: DataFrame, draws: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A stored summary with the precision of the cells whose thresholds tie as risks only computed anew, and the changes.

    Only rows of pr_auc_risk in cells that tie_partition_audit finds are replaced; all others are kept as they are. The
    changes are rows of cell, column, previous and current. A cell to be renewed that the table lacks, or holds more than
    once, is an error.
    """
    keys = ["dataset", "week", "protocol", "model"]
    cells = stored(tie_partition_audit(predictions).where("merged_thresholds > 0").select(*keys), "tied-cells")
    target = table.where("metric = 'pr_auc_risk'")
    require_unmatched(without_match(cells, target, keys), "a cell to be renewed is not one row of the table")
    values = ["point", "ci_low", "ci_high"]
    fresh = summary(predictions.join(cells, keys, "left_semi"), draws).where("metric = 'pr_auc_risk'")
    fresh = stored(fresh.select(*keys, "metric", *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("renewed")), "renewed")
    joined = table.join(fresh, [*keys, "metric"], "left")
    renewed = joined.select(*[F.when(F.col("renewed"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("column"), F.col(v).alias("previous"), F.col(f"new_{v}").alias("current")) for v in values]))
    changes = joined.where("renewed").select(*keys, each.alias("c")).select(*keys, "c.*").where(~F.col("previous").eqNullSafe(F.col("current")))
    return renewed, changes
