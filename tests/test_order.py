"""Places in an order, first occurrences in files, and the renewal of precision where thresholds tie as risks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions.columns import KEY
from waymark.operators import baselines, bootstrap, cohort, models, order

PANEL = "dataset string, week int, protocol string, model string, cluster_id string, cluster_unit string, y int, p_success double"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Two files whose names are not in the order of their values, each of several row groups."""
    folder = tmp_path_factory.mktemp("order")
    values = [[f"v{(k * 7 + f * 3) % 11}" if k % 5 else None for k in range(400)] for f in range(2)]
    rows = []
    for f, name in enumerate(("b", "a")):
        part = [(v, f * 1000 + k) for k, v in enumerate(values[f])]
        spark.createDataFrame(part, "v string, k long").coalesce(1).write.option("parquet.block.size", 1024).parquet(f"{folder}/{name}")
        rows.append(part)
    return f"{folder}/b", f"{folder}/a", [*rows[1], *rows[0]]  # a before b


def test_numbered_counts_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"))
    got = order.numbered(df, F.desc("x")).collect()
    assert {r["x"]: r["nth"] for r in got} == {x: 999 - x for x in range(1000)}
    assert order.numbered(df.where("false"), "x").count() == 0


def test_first_occurrence_and_keep_first(spark, files):
    b, a, rows = files
    df = order.read_in_order(spark, b, a)
    first = {}
    for v, k in rows:
        first.setdefault(v, k)
    assert [r["v"] for r in order.first_occurrence(df, "v").orderBy("nth").collect()] == list(first)
    assert {r["v"]: r["k"] for r in order.keep_first(df, "v").collect()} == first
    clusters = bootstrap.clusters_of(df.withColumnRenamed("v", "cluster_id"))
    drawn = bootstrap.draw_table(clusters, 3, 1)
    assert drawn.groupBy("draw").agg(F.sum("w")).collect()[0][1] == len(first) - 1


def test_rosters_keep_the_first_label(spark, files):
    b, a, rows = files
    df = order.read_in_order(spark, b, a).select((F.col("k") % 50).alias("id_student"), F.lit("M").alias("code_module"), F.lit("P").alias("code_presentation"), (F.col("k") > 999).cast("int").alias("label"), "source_order")
    assert {r["label"] for r in cohort.load_roster(df).collect()} == {1} and {r["label"] for r in cohort.load_roster(df.drop("source_order")).collect()} == {0}
    assert cohort.load_roster(df).select(*KEY).distinct().count() == 50


@pytest.fixture(scope="module")
def panel(spark):
    """Cell t has scores that differ and tie as risks; cell u has none."""
    rng = np.random.default_rng(4)
    rows = []
    for model in "tu":
        for k in range(120):
            p = float(rng.choice([1e-17, 2e-17, 3e-17, 0.25, 0.5, 0.75])) if model == "t" else float(rng.choice([0.1, 0.25, 0.5]))
            rows.append(("d", 1, "cutoff_valid", model, f"c{k % 6}", "presentation", int(rng.integers(0, 2)), p))
    return spark.createDataFrame(rows, PANEL)


def test_two_ways_to_the_precision_agree(spark, panel):
    keys = ["dataset", "week", "protocol", "model"]
    drawn = bootstrap.draw_table(bootstrap.clusters_of(panel), 30, 2)
    assert bootstrap.cross_check(panel, drawn, keys, [0, 15, 29]).isEmpty()
    assert bootstrap.row_weighted_precision(panel, drawn, keys).count() == 60
    assert bootstrap.cross_check(panel, drawn, keys, [0, 15, 29], -1.0).count() == 6  # what it would report


def test_only_tied_cells_are_renewed(spark, panel):
    drawn = bootstrap.draw_table(bootstrap.clusters_of(panel), 30, 2)
    right = bootstrap.summary(panel, drawn)
    old = right.withColumns({c: F.col(c) + 0.125 for c in ("point", "ci_low", "ci_high")})
    renewed, changes = bootstrap.renew_precision(old, panel, drawn)
    values = lambda df: {(r["model"], r["metric"]): (r["point"], r["ci_low"], r["ci_high"]) for r in df.collect()}
    got, new, before = values(renewed), values(right), values(old)
    for key in before:
        assert np.allclose(got[key], new[key] if key == ("t", "pr_auc_risk") else before[key], atol=1e-14)
    assert renewed.columns == old.columns
    found = changes.collect()
    assert len(found) == 3 and all(r["model"] == "t" and abs(r["previous"] - r["current"] - 0.125) < 1e-12 for r in found)
    same, none = bootstrap.renew_precision(right, panel.where("model = 'u'"), drawn)
    assert none.isEmpty() and values(same) == values(right)
    with pytest.raises(ValueError, match="not one row"):
        bootstrap.renew_precision(old.where("model = 'u'"), panel, drawn)


def test_baselines_of_a_panel(spark, tmp_path):
    spark.createDataFrame([("flat_hgb",), ("base_svm",), ("base_knn",), ("base_svm",)], "model string").coalesce(1).write.parquet(f"{tmp_path}/panel")
    panel = order.read_in_order(spark, f"{tmp_path}/panel")
    got = {r["model"]: r for r in baselines.baseline_manifest(panel).collect()}
    assert [m for m, r in sorted(got.items(), key=lambda x: x[1]["nth"])] == ["base_svm", "base_knn"] and got["base_knn"]["family"] == "k_nearest_neighbours"
    assert baselines.baseline_manifest(panel.drop("source_order")).columns == baselines.COLUMNS
    assert {b[0] for b in baselines.BASELINES} == {*models.LOGISTIC, *models.CLASSIC}
