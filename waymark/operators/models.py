"""Folds and estimators: fit on one population, score the union of the evaluation populations once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions.columns import KEY, group_id
from waymark.operators.boosting import Boosting, fit_boosting
from waymark.operators.checks import signature, table_digest
from waymark.operators.network import Training, fit_network
from waymark.operators.order import numbered
from waymark.sources.scratch import stored
from waymark.sources.publish import Store
from waymark.sources.tables import write_table

#: Models by name; others are gradient boosting.
LOGISTIC = ("base_lr_profile", "base_lr_clickstream", "base_lr_weekly")
CLASSIC = ("base_rf_gini", "base_rf_entropy", "base_svm", "base_knn", "base_dffnn")
#: Logistic fits at a time, and training rows that one task of theirs sums, at least: an iteration is a job, and on few
#: rows its tasks' start is nearly all it takes.
FITS, INSTANCES = 6, 50_000
#: Training population: the protocols it is scored under and their evaluation populations.
SPECS = {
    "activity_conditioned": [("activity_conditioned", "activity_conditioned"), ("activity_to_cutoff_valid", "cutoff_valid")],
    "static_full": [("static_full", "static_full")],
    "cutoff_valid": [("cutoff_valid", "cutoff_valid"), ("cutoff_valid_to_activity", "activity_conditioned")],
}


@dataclass(frozen=True)
class Config:
    folds: int = 5
    repeats: int = 5
    seed: int = 42
    split_unit: str = "presentation"


def spare_folds(shapes: list[tuple[int, int, int]], n_splits: int, seed: int) -> dict[tuple[int, int], list[int]]:
    """Folds of the groups that are left when each shape (failures, successes, groups) is dealt to all folds evenly.

    The most uneven shapes come first (ties by a hash of seed and shape); each of their groups goes to the fold whose
    class shares are then the evenest, ties to the fold with fewest rows and the least number. Folds count from 1.
    """
    if sum(m for *_, m in shapes) < n_splits:
        raise ValueError(f"{n_splits} folds need as many groups; there are {sum(m for *_, m in shapes)}")
    total = np.maximum([sum(b * m for b, _, m in shapes), sum(g * m for _, g, m in shapes)], 1)
    held, out = np.zeros((n_splits, 2)), {}
    tie = lambda s: hashlib.md5(f"{seed}:{s[0]}:{s[1]}".encode()).hexdigest()
    for bad, good, m in sorted(shapes, key=lambda s: (-abs(s[0] - s[1]), tie(s))):
        out[bad, good] = []
        for _ in range(m % n_splits):
            trial = held[None] + np.eye(n_splits)[:, :, None] * np.array([bad, good])
            spread = (trial / total).std(axis=1).mean(axis=1)
            fold = min(range(n_splits), key=lambda f: (round(float(spread[f]), 12), held[f].sum(), f))
            held[fold] += bad, good
            out[bad, good].append(fold + 1)
    return out


def fold_table(roster: DataFrame, config: Config) -> DataFrame:
    """KEY, label, split_unit, split_group, repeat, fold.

    Groups of one shape (failures and successes) are ranked by a hash of seed, repeat and group: the first few, what is
    left of the shape's number when it is divided by the folds, go where spare_folds says, the others to the folds in
    turn. The driver sees a row per shape; ranks are places of one range shuffle, so no task holds a shape's groups.
    """
    spark = roster.sparkSession
    rows = roster.withColumn("split_group", group_id(config.split_unit))
    groups = stored(rows.groupBy("split_group").agg(F.count_if(F.col("label") == 0).alias("bad"), F.count_if(F.col("label") == 1).alias("good")), "fold-groups")
    shapes = [(r["bad"], r["good"], r["m"]) for r in groups.groupBy("bad", "good").agg(F.count(F.lit(1)).alias("m")).collect()]
    spare = [(repeat + 1, *shape, i, fold) for repeat in range(config.repeats) for shape, folds in spare_folds(shapes, config.folds, config.seed + repeat).items() for i, fold in enumerate(folds)]
    sizes = [(*shape, m, m % config.folds) for *shape, m in shapes]
    draw = F.md5(F.concat_ws(":", F.col("repeat") - 1 + config.seed, "split_group").cast("binary"))
    each = groups.withColumn("repeat", F.explode(F.array(*[F.lit(k + 1) for k in range(config.repeats)]))).withColumn("draw", draw)
    placed = numbered(each, "repeat", "bad", "good", "draw", "split_group")
    starts = placed.groupBy("repeat", "bad", "good").agg(F.min("nth").alias("start"))
    # A row per shape, and at most as many as folds for each.
    placed = placed.join(F.broadcast(starts), ["repeat", "bad", "good"]).join(F.broadcast(spark.createDataFrame(sizes, "bad long, good long, m long, spare long")), ["bad", "good"])
    placed = placed.withColumn("i", F.col("nth") - F.col("start"))
    chosen = F.broadcast(spark.createDataFrame(spare, "repeat int, bad long, good long, i long, chosen int"))
    turn = ((F.col("i") - F.col("spare")) % config.folds + 1).cast("int")
    maps = placed.join(chosen, ["repeat", "bad", "good", "i"], "left").select("split_group", "repeat", F.coalesce("chosen", turn).alias("fold"))
    return rows.join(maps, "split_group").select(*KEY, "label", F.lit(config.split_unit).alias("split_unit"), "split_group", "repeat", "fold")


def _balanced(train: DataFrame) -> DataFrame:
    sizes = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    weight = F.lit(1.0)
    for y, n in sizes.items():
        weight = F.when(F.col("y") == y, total / (len(sizes) * n)).otherwise(weight)
    return train.withColumn("weight", weight)


def _probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("p_success", vector_to_array("probability")[1])


def _svm(train: DataFrame, test: DataFrame, features: str, seed: int, inner: int = 3) -> DataFrame:
    """A linear support vector machine; its margins become probabilities by logistic regression on held-out margins."""
    svm = LinearSVC(featuresCol=features, labelCol="y", regParam=10.0 / max(train.count(), 1), maxIter=100)
    parts = train.withColumn("part", F.pmod(F.xxhash64(*KEY, F.lit(seed)), F.lit(inner)))
    margin = vector_to_array("rawPrediction")[1]
    held = None
    for k in range(inner):
        scored = svm.fit(parts.where(F.col("part") != k)).transform(parts.where(F.col("part") == k)).select("y", margin.alias("margin"))
        held = scored if held is None else held.unionByName(scored)
    platt = Pipeline(stages=[VectorAssembler(inputCols=["margin"], outputCol="margins"), LogisticRegression(featuresCol="margins", labelCol="y")]).fit(held)
    return _probability(platt, svm.fit(train).transform(test).withColumn("margin", margin).drop("rawPrediction", "probability", "prediction"))


def _knn(train: DataFrame, test: DataFrame, features: str, neighbours: int = 50, block: int = 4096) -> DataFrame:
    """Share of successes among the nearest training rows, exactly: test rows meet training blocks of bounded size."""
    flat = lambda df, *more: df.select(*KEY, vector_to_array(features).alias("x"), *more)
    blocks = max(1, -(-train.count() // block))
    left = flat(train, "y").withColumn("block", F.pmod(F.xxhash64(*KEY), F.lit(blocks)))
    parts = max(1, -(-test.count() // block))
    right = flat(test).withColumn("part", F.pmod(F.xxhash64(*KEY), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[*KEY, "distance", "y"])
        x, z = np.stack(a["x"]), np.stack(b["x"])
        far = (z**2).sum(1)[:, None] - 2 * z @ x.T + (x**2).sum(1)[None]
        k = min(neighbours, len(a))
        nearest = np.argpartition(far, k - 1, axis=1)[:, :k]
        out = b[KEY].loc[b.index.repeat(k)].reset_index(drop=True)
        return out.assign(distance=np.take_along_axis(far, nearest, 1).ravel(), y=a["y"].to_numpy()[nearest].ravel())

    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(near, "id_student long, code_module string, code_presentation string, distance double, y int")
    ranked = found.withColumn("nth", F.row_number().over(Window.partitionBy(*KEY).orderBy("distance", "y"))).where(F.col("nth") <= neighbours)
    return test.join(ranked.groupBy(*KEY).agg(F.avg("y").alias("p_success")), KEY)


def fit_and_score(name: str, train: DataFrame, test: DataFrame, features: list[str], seed: int, limits: dict[str, object] | None = None) -> DataFrame:
    """test with p_success by the model of that name, fitted on train (features and y).

    limits override the estimator's parameters, for trials on a few rows.
    """
    limits = limits or {}
    if name not in (*LOGISTIC, *CLASSIC):
        return fit_boosting(train, features, Boosting(**limits), seed).score(test, features)
    assemble = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="error")
    scaled = name in (*LOGISTIC, "base_svm", "base_knn", "base_dffnn")
    stages = [assemble, *([StandardScaler(inputCol="raw", outputCol="x", withMean=True)] if scaled else [])]
    ready = Pipeline(stages=stages).fit(train)
    train, test, column = ready.transform(train), ready.transform(test), "x" if scaled else "raw"
    if name == "base_svm":
        return _svm(train, test, column, seed)
    if name == "base_knn":
        return _knn(train, test, column)
    if name == "base_dffnn":
        return fit_network(train, vector_to_array(column), Training(**limits), seed).score(test, vector_to_array(column))
    if name in LOGISTIC:
        n = max(train.count(), 1)
        model, train = LogisticRegression(featuresCol=column, labelCol="y", regParam=1.0 / n, maxIter=200), train.coalesce(-(-n // INSTANCES))
    else:
        train = _balanced(train)
        model = RandomForestClassifier(featuresCol=column, labelCol="y", numTrees=300, impurity=name.removeprefix("base_rf_"), minInstancesPerNode=5, maxDepth=30, weightCol="weight", seed=seed)
    return _probability(Pipeline(stages=[model.setParams(**limits)]).fit(train), test)


def benchmark(spark: SparkSession, base: DataFrame, folds: DataFrame, name: str, features: list[str], week: int, config: Config, specs: dict[str, list[tuple[str, str]]] = SPECS, limits: dict[str, object] | None = None) -> DataFrame:
    """Scored panel of one model at one landmark.

    base has KEY, label, the membership columns and features. Each training population is fitted once per fold and
    scores the union of its evaluation populations once. Folds whose training rows hold one class are left out, and so
    are evaluations whose test rows do. The rows are stored, as every fit reads them.
    """
    rows = stored(base.withColumn("y", F.col("label").cast("int")).join(folds.select(*KEY, "repeat", "fold"), KEY), "benchmark")

    def cell(repeat: int, population: str, fold: int) -> DataFrame | None:
        cells, mine = specs[population], rows.where(F.col("repeat") == repeat)
        train = mine.where((F.col("fold") != fold) & F.col(population))
        classes = lambda e: F.countDistinct(F.when((F.col("fold") == fold) & F.col(e), F.col("y")))
        sizes = mine.agg(F.countDistinct(F.when((F.col("fold") != fold) & F.col(population), F.col("y"))), *[classes(e) for _, e in cells]).first()
        told = [cell for cell, n in zip(cells, sizes[1:]) if n > 1]
        if sizes[0] < 2 or not told:
            return None
        test = mine.where((F.col("fold") == fold) & F.array_contains(F.array(*[F.col(e) for _, e in told]), True))
        scored = fit_and_score(name, train, test, features, config.seed + repeat * 100 + fold, limits)
        each = F.explode(F.array(*[F.struct(F.lit(p).alias("protocol"), F.lit(population).alias("train_protocol"), F.lit(e).alias("eval_protocol"), F.col(e).alias("use")) for p, e in told]))
        kept = scored.withColumn("cell", each).where("cell.use")
        return kept.select(
            "dataset", F.lit(week).alias("week"), "cell.protocol", "cell.train_protocol", "cell.eval_protocol", F.lit(name).alias("model"), *KEY, "y", "risk", "has_activity", "no_activity", "outcome_realized", "cutoff_valid", "membership_class",
            group_id("presentation").alias("cluster_id"), F.lit("presentation").alias("cluster_unit"), "repeat", "fold", "p_success", (1 - F.col("p_success")).alias("risk_score"),
        )

    # Fits do not depend on each other, and an iteration of one is a job too small to keep all cores busy.
    cells = [(repeat, population, fold) for repeat in range(1, config.repeats + 1) for population in specs for fold in range(1, config.folds + 1)]
    with ThreadPool(FITS if name in LOGISTIC else 1) as pool:
        panels = [df for df in pool.map(inheritable_thread_target(spark)(lambda c: cell(*c)), cells, chunksize=1) if df is not None]
    out = reduce(DataFrame.unionByName, panels) if panels else None
    if out is None:
        raise ValueError("no fold has two classes to train on")
    return out


def run_cells(spark: SparkSession, folder: str, cells: dict[tuple[int, str], Callable[[], DataFrame]], settings: dict[str, object]) -> list[tuple[int, str]]:
    """Store the panel of every (week, model) below folder and return those that were computed now.

    A cell's manifest is written last, so a cell without one is computed anew, and one whose manifest is of other
    settings is an error: a finished run is taken up where it stopped, and never mixed with another. Manifests lie beside
    the panel, on the file system that Spark writes to.
    """
    fresh, store = [], Store(spark, folder)
    for (week, name), build in cells.items():
        manifest: dict[str, object] = {"week": week, "model": name, "settings": settings}
        note = f"week={week}-model={name}.json"
        if store.exists(note):
            if store.read(note).get("signature") != signature(manifest):
                raise ValueError(f"{note} belongs to another run; choose another folder")
            continue
        write_table(build(), f"{folder}/panel/week={week}/model={name}")
        store.write(note, manifest | {"signature": signature(manifest)})
        fresh.append((week, name))
    return fresh


def protocol(settings: dict[str, object], tables: dict[str, DataFrame], specs: dict[str, list[tuple[str, str]]] = SPECS) -> dict[str, object]:
    """What a run was asked for and what it made: its settings, its cells, and the digest of each finished table.

    A panel is only added to under the protocol that was written with it.
    """
    cells = [{"protocol": p, "train_protocol": population, "eval_protocol": e} for population, each in specs.items() for p, e in each]
    return {"settings": settings, "cells": cells, "tables": {name: table_digest(df) for name, df in sorted(tables.items())}}


def incomplete(panel: DataFrame, specs: dict[str, list[tuple[str, str]]] = SPECS) -> dict[str, list[tuple[str, str]]]:
    """The training populations for which the panel lacks a protocol, each with all its protocols: the cells of one
    population must come from one fitted model. Only the names of protocols reach the driver, one for each cell."""
    wanted = [p for cells in specs.values() for p, _ in cells]
    held = {r["protocol"] for r in panel.where(F.col("protocol").isin(wanted)).select("protocol").distinct().collect()}
    return {population: cells for population, cells in specs.items() if not held.issuperset(p for p, _ in cells)}


def augment(panel: DataFrame, written: dict[str, object], settings: dict[str, object], refit: Callable[[dict[str, list[tuple[str, str]]]], DataFrame], specs: dict[str, list[tuple[str, str]]] = SPECS) -> DataFrame:
    """The panel with the cells that it lacks: the populations that refit fits anew replace all their rows.

    written is the protocol that was stored with the panel. Other settings, a panel that is not the one it describes,
    and a panel that lacks nothing are errors. Rows of protocols outside specs stay, with null populations; a panel
    without the columns of its populations gets them.
    """
    if written["settings"] != settings:
        raise ValueError("the panel was made under other settings")
    if written["tables"].get("panel") != table_digest(panel):
        raise ValueError("the panel is not the one of its protocol")
    lacking = incomplete(panel, specs)
    if not lacking:
        raise ValueError("the panel holds every cell; nothing to add")
    spark = panel.sparkSession
    renewed = spark.createDataFrame([(p,) for cells in lacking.values() for p, _ in cells], "protocol string")
    places = spark.createDataFrame([(p, population, e) for population, cells in specs.items() for p, e in cells], "protocol string, train_protocol string, eval_protocol string")
    # Both are as many rows as there are cells in specs.
    kept = panel.drop("train_protocol", "eval_protocol").join(F.broadcast(renewed), "protocol", "left_anti")
    return kept.join(F.broadcast(places), "protocol", "left").unionByName(refit(lacking), allowMissingColumns=True)
