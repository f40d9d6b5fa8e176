"""Hand-sized cases against calculations written out here."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions.columns import KEY, average_rank, correlation, day_to_week, finite
from waymark.operators import behaviour, bootstrap, checks, cohort, decide, evidence, hazard, metrics, models, represent, state, static, traversal
from waymark.operators.boosting import Boosting
from waymark.operators.network import Training

ME = (1, "M", "P")


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def enrol(spark, ids=(1, 2, 3)):
    return table(spark, [(i, "M", "P", i % 2) for i in ids], "id_student long, code_module string, code_presentation string, label int")


def test_finite_and_weeks(spark):
    df = table(spark, [("1",), ("x",), ("NaN",), ("Infinity",), (None,)], "v string")
    assert [r[0] for r in df.select(finite(F.col("v"))).collect()] == [1.0, None, None, None, None]
    days = table(spark, [(d,) for d in (-1, 0, 6, 7, None)], "d int")
    assert [r[0] for r in days.select(day_to_week(F.col("d"))).collect()] == [None, 1, 1, 2, None]


def test_average_rank_and_correlation(spark):
    df = table(spark, [("a", v) for v in (3.0, 1.0, 3.0, 2.0)], "g string, v double")
    assert sorted(r[0] for r in df.select(average_rank(["g"], "v")).collect()) == [1.0, 2.0, 3.5, 3.5]
    assert df.groupBy("g").agg(correlation(F.col("v"), F.lit(1.0))).first()[1] is None


def test_membership_edges(spark):
    roster = table(spark, [(1, "M", "P", 1, None, None), (2, "M", "P", 0, 14.0, None), (3, "M", "P", 0, -5.0, 13.0), (4, "M", "P", 0, 0.0, 14.0)], "id_student long, code_module string, code_presentation string, label int, date_registration double, date_unregistration double")
    weeks = table(spark, [(1, "M", "P", 2), (3, "M", "P", 3)], "id_student long, code_module string, code_presentation string, week_index int")
    got = {r["id_student"]: r["membership_class"] for r in cohort.membership(cohort.load_roster(roster, roster), weeks, [2]).collect()}
    assert got == {1: "eligible_active", 2: "not_yet_registered", 3: "outcome_realized_silent", 4: "eligible_silent"}
    assert cohort.composition_indices(cohort.membership(cohort.load_roster(roster, roster), weeks, [2]).where("cutoff_day < 0")).count() == 0


def test_roster_keeps_one_row_per_enrolment(spark):
    labels = enrol(spark, (1, 1, 2))
    assert cohort.load_roster(labels).count() == 2


def test_gap_of_a_single_day(spark):
    events = table(spark, [(*ME, 5, 13, 4), (*ME, 5, 14, 9), (*ME, 5, -1, 9)], "id_student long, code_module string, code_presentation string, id_site long, date int, sum_click long")
    row = behaviour.gap_features(events, [2]).first()
    assert (row["gap_active_days"], row["gap_max"], row["gap_mean"], row["gap_std"], row["gap_days_since_last"]) == (1, 1.0, 1.0, 0.0, 1)
    assert row["gap_momentum"] == 5.0


def test_weighted_score_counts_the_weight_of_a_null_score(spark):
    sub = table(spark, [(10, 1, 3.0, 0, 50.0), (11, 1, 4.0, 0, None), (10, 1, 5.0, 1, 90.0), (10, 1, 5.0, None, 90.0), (10, 1, -1.0, 0, 90.0)], "id_assessment long, id_student long, date_submitted double, is_banked int, score double")
    meta = table(spark, [(10, "M", "P", 10.0, 5.0), (11, "M", "P", 30.0, None)], "id_assessment long, code_module string, code_presentation string, weight double, date double")
    row = evidence.assess_weekly(sub, meta).first()
    assert row["assess_attempts"] == 2 and row["assess_score_mean"] == 0.5
    assert math.isclose(row["assess_score_weighted"], 0.5 * 0.1 / 0.4)
    with pytest.raises(Exception, match="submission without an assessment"):
        evidence.assess_weekly(sub, meta.where("id_assessment = 10")).collect()


def test_traversal_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(int(s), "M", "P", int(rng.integers(0, 12)), int(rng.integers(0, 30))) for s in range(6) for _ in range(25)]
    schema = "id_student long, code_module string, code_presentation string, id_site long, date int"
    got = {r["id_student"]: r for r in traversal.traversal_features(table(spark, rows, schema), [3]).collect()}
    seen = [r for r in rows if r[4] < 21]
    median = {s: np.median([r[4] for r in seen if r[3] == s]) for s in {r[3] for r in seen}}
    levels = sorted(set(median.values()))
    pos = {s: (levels.index(m) + 1) / len(levels) for s, m in median.items()}
    for student in range(6):
        path = [pos[r[3]] for r in sorted((r for r in seen if r[0] == student), key=lambda r: (r[4], pos[r[3]]))]
        step = np.diff(path, prepend=path[0])
        assert math.isclose(got[student]["trav_backtrack_rate"], (step < 0).mean())
        assert math.isclose(got[student]["trav_step_absmean"], np.abs(step).mean())
        assert math.isclose(got[student]["trav_below_frontier_rate"], (np.array(path) < np.maximum.accumulate(path) - 1e-9).mean())


def auc(y, p):
    return np.mean([(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]])


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    df = table(spark, [("c", int(a), float(b)) for a, b in zip(y, p)] + [("one", 1, 0.5)], "cell string, y int, p_success double")
    got = {r["cell"]: r for r in metrics.cell_metrics(df, ["cell"]).collect()}
    assert math.isclose(got["c"]["auc"], auc(y, p)) and math.isclose(got["c"]["brier"], np.mean((y - p) ** 2))
    bins = np.digitize(p, metrics.EDGES)
    assert math.isclose(got["c"]["ece"], sum(abs((y - p)[bins == k].sum()) for k in range(10)) / 300)
    risk = 1 - p
    caught = np.array([(1 - y)[risk >= r].sum() / (risk >= r).sum() for r in risk[y == 0]])
    assert math.isclose(got["c"]["pr_auc_risk"], caught.mean())
    assert got["one"]["auc"] is None and got["one"]["ece"] is None
    flipped = metrics.cell_metrics(df.withColumn("y", 1 - F.col("y")), ["cell"]).where("cell = 'c'").first()
    assert math.isclose(flipped["auc"], 1 - got["c"]["auc"])


def test_edges_are_those_of_the_bins():
    assert metrics.EDGES == np.linspace(0, 1, 11)[1:-1].tolist()


def test_cluster_weights_equal_repeated_rows(spark):
    rng = np.random.default_rng(2)
    rows = [("d", 1, "p", "m", f"c{k % 3}", int(rng.integers(0, 2)), float(np.round(rng.random(), 1))) for k in range(60)]
    df = table(spark, rows, "dataset string, week int, protocol string, model string, cluster_id string, y int, p_success double")
    keys = ["dataset", "week", "protocol", "model"]
    drawn = table(spark, [(0, "c0", 2), (0, "c2", 1)], "draw int, cluster_id string, w int")
    got = bootstrap.metric_draws(df, drawn, keys).first()
    again = df.where("cluster_id = 'c0'").unionByName(df.where("cluster_id = 'c0'")).unionByName(df.where("cluster_id = 'c2'"))
    expected = metrics.cell_metrics(again, keys).first()
    for name in metrics.METRICS:
        assert math.isclose(got[name], expected[name])


def test_draw_metrics_equal_those_of_weighted_counts(spark):
    rng = np.random.default_rng(3)
    rows = [("d", w, "p", "m", f"c{k % 4}", int(rng.integers(0, 2)) if w == 1 else 1, float(np.round(rng.random(), 1))) for w in (1, 2) for k in range(80)]
    df = table(spark, [*rows, ("d", 3, "p", "m", "c9", 1, 0.5)], "dataset string, week int, protocol string, model string, cluster_id string, y int, p_success double")
    keys = ["dataset", "week", "protocol", "model"]
    drawn = bootstrap.draw_table(table(spark, [(f"c{k}",) for k in range(4)], "cluster_id string"), 120, 5)
    got = {(r["week"], r["draw"]): r for r in bootstrap.metric_draws(df, drawn, keys).collect()}
    counts = metrics.threshold_counts(df, keys, "cluster_id").join(drawn, "cluster_id").groupBy(*keys, "draw", "p").agg(F.sum(F.col("s") * F.col("w")).alias("s"), F.sum(F.col("f") * F.col("w")).alias("f"))
    expected = {(r["week"], r["draw"]): r for r in metrics.metrics_of_counts(counts, [*keys, "draw"]).collect()}
    assert got.keys() == expected.keys() and len(got) == 240
    for key, r in expected.items():
        assert got[key]["n"] == r["n"]
        for name in metrics.METRICS:
            assert (got[key][name] is None) == (r[name] is None) and (r[name] is None or math.isclose(got[key][name], r[name], abs_tol=1e-12))


def test_boosting_has_the_reference_settings():
    own = Boosting()
    assert (own.rounds, own.rate, own.leaves, own.l2) == (250, 0.06, 15, 1.0)
    net = Training()
    assert (net.hidden, net.decay, net.batch, net.rate, net.epochs, net.held, net.patience) == ((128, 64, 32), 1e-4, 256, 1e-3, 300, 0.1, 15)


def test_draws_are_hashes_of_slots(spark):
    names = ["b", "a", "c"]
    clusters = bootstrap.clusters_of(table(spark, [(n,) for n in [*names, *names, None]], "cluster_id string"))
    got = {(r["draw"], r["cluster_id"]): r["w"] for r in bootstrap.draw_table(clusters, 50, 7).collect()}
    expected = Counter((d, sorted(names)[int(hashlib.md5(f"7:{d}:{k}".encode()).hexdigest()[:13], 16) % 3]) for d in range(50) for k in range(3))
    assert got == dict(expected)
    assert bootstrap.draw_table(clusters.where("false"), 5).count() == 0


def test_slices_change_no_metric(spark):
    """A panel of continuous and rare risks over many slices equals the same in one."""
    rng = np.random.default_rng(8)
    p = np.concatenate([1 - rng.random(1500) ** 8 / 50, np.round(rng.random(300), 2)])
    rows = [("m", f"c{k % 30}" if k % 50 else None, int(rng.random() < v), float(v)) for k, v in enumerate(p)]
    df = table(spark, rows, "model string, cluster_id string, y int, p_success double")
    drawn = bootstrap.draw_table(bootstrap.clusters_of(df), 40, 1)

    def run(partitions, size):
        for k, v in (("spark.sql.shuffle.partitions", partitions), ("spark.sql.adaptive.coalescePartitions.enabled", size)):
            spark.conf.set(k, v)
        slices = metrics.sliced(metrics.threshold_counts(df, ["model"]), ["model"]).groupBy("slice").count().collect()
        cell = metrics.cell_metrics(df, ["model"]).first()
        return [r["count"] for r in slices], cell, {r["draw"]: r for r in bootstrap.metric_draws(df, drawn, ["model"], points=True).collect()}

    one, cell, whole = run("1", "true")
    many, cut_cell, cut = run("16", "false")
    for k, v in (("spark.sql.shuffle.partitions", "4"), ("spark.sql.adaptive.coalescePartitions.enabled", "true")):
        spark.conf.set(k, v)
    assert len(one) == 1 and len(many) == 16 and max(many) <= 2 * sum(many) / len(many)
    assert whole.keys() == cut.keys() == {-1, *range(40)}
    for name in ("n", *metrics.METRICS):
        assert math.isclose(cell[name], cut_cell[name], rel_tol=1e-12) and math.isclose(whole[-1][name], cell[name], rel_tol=1e-12)
        assert all(math.isclose(whole[d][name], cut[d][name], rel_tol=1e-12) for d in whole)


def test_contrasts_add_up():
    for a, b in (("evaluation_population_component", "training_population_component"), ("training_population_component_at_activity", "evaluation_population_component_at_valid"), ("evaluation_population_shapley", "training_population_shapley")):
        assert [x + y for x, y in zip(bootstrap.CONTRASTS[a], bootstrap.CONTRASTS[b])] == list(bootstrap.CONTRASTS["joint_population_difference"])


def test_capacity_rounds_half_to_even_and_ties_keep_key_order(spark):
    rows = [("d", 1, "m", "cutoff_valid", "c", i, "M", "P", 0.5 if i < 4 else 0.9, 1) for i in range(50)]
    df = table(spark, rows, "dataset string, week int, model string, protocol string, cluster_id string, id_student long, code_module string, code_presentation string, risk_score double, risk int")
    capacity = decide.capacities(df, [0.05, 0.001])
    assert {r["budget"]: r["capacity"] for r in capacity.collect()} == {0.05: 2, 0.001: 1}
    chosen = decide.select_at_budget(df, capacity.where("budget = 0.05"))
    assert sorted(r["id_student"] for r in chosen.collect()) == [4, 5]


def chain(events, week, passes=2):
    """One learner's chain in NumPy."""
    m, c = np.full(week, 0.5), np.zeros(week)
    for w, clicks, days, attempts, score in events:
        e, ec, ac = 1 - np.exp(-(np.log1p(clicks) + 0.35 * days) / 3), 0.55 * (1 - np.exp(-(clicks / 12 + days / 3))), 1 - np.exp(-attempts)
        c[w - 1] = min(1, ec + ac)
        m[w - 1] = (ec * e + ac * score) / c[w - 1] if c[w - 1] > 0 else 0.5
    for _ in range(passes):
        pm, pc = m[:-1].copy(), c[:-1].copy()
        m[1:] = (1 - 0.25 * pc) * m[1:] + 0.25 * pc * pm
        c[1:] = np.maximum(c[1:], 0.7 * pc)
    return m, c


def test_chain_states(spark):
    events = [(1, 10, 2, 1, 0.8), (3, 40, 5, 0, 0.0), (4, 0, 0, 2, 0.4)]
    df = table(spark, [(*ME, *e) for e in events], "id_student long, code_module string, code_presentation string, week_index int, clicks_total int, active_days int, assess_attempts int, assess_score_mean double")
    row = state.chain_features(df, 5).first()
    m, c = chain(events, 5)
    assert math.isclose(row["pcgut_mastery_mean"], m.mean()) and math.isclose(row["pcgut_mastery_std"], m.std()) and math.isclose(row["pcgut_recent_confidence"], c[-1])
    assert math.isclose(row["pcgut_prerequisite_gap"], (np.maximum(0, np.diff(m)) * c[1:]).mean())
    for mode in ("none", "shuffled"):
        assert state.chain_features(df, 5, mode).count() == 1
    assert state.chain_features(df, 1).first()["pcgut_smoothness"] == 0.0


@pytest.mark.parametrize("mode", state.GRAPH_MODES)
def test_graph_states(spark, mode):
    rng = np.random.default_rng(4)
    t, lanes = 4, 3
    clicks, attempts, score = rng.integers(0, 20, (t, lanes)).astype(float), rng.integers(0, 2, t).astype(float), np.round(rng.random(t), 2)
    names = [f"clicks_{k}" for k in "abc"]
    rows = [(*ME, w + 1, *clicks[w].tolist(), attempts[w].item(), score[w].item()) for w in range(t) if w != 2]
    df = table(spark, rows, "id_student long, code_module string, code_presentation string, week_index int, " + ", ".join(f"{n} double" for n in names) + ", assess_attempts double, assess_score_mean double")
    clicks[2], attempts[2], score[2] = 0, 0, 0.5
    m, c = 1 - np.exp(-np.log1p(clicks) / 3), 0.55 * (1 - np.exp(-clicks / 12))
    wm, wc = score.copy(), 1 - np.exp(-attempts)
    first = wc.copy()
    order = state.permutation(lanes, 42 + t) if "shuffled" in mode else list(range(lanes))
    for _ in range(0 if mode in ("none", "local_only", "residual", "residual_shuffled") else 2):
        if mode in ("full", "temporal_only", "shuffled"):
            pm, pc = m[:-1, order].copy(), c[:-1, order].copy()
            m[1:] = (1 - 0.25 * pc) * m[1:] + 0.25 * pc * pm
            c[1:] = np.maximum(c[1:], 0.7 * pc)
        if mode in ("full", "hierarchy_only", "shuffled"):
            pooled = np.where(c.sum(1) > 1e-9, (m * c).sum(1) / np.maximum(c.sum(1), 1e-300), 0.5)
            top = c.max(1)
            wm = np.where(wc + top > 1e-9, (wc * wm + top * pooled) / np.maximum(wc + top, 1e-9), wm)
            wc = np.maximum(wc, 0.7 * top)
            m = (1 - 0.15 * wc[:, None]) * m + 0.15 * wc[:, None] * wm[:, None]
    row = state.graph_features(df, t, mode).first()
    expected = {"pcgg_mastery_mean": m.mean(), "pcgg_mastery_std": m.std(), "pcgg_confidence_mean": c.mean(), "pcgg_week_mastery_mean": wm.mean(), "pcgg_mastered_ratio": ((wm >= 0.55) & (first > 0.05)).mean(), "pcgg_smoothness": np.abs(np.diff(wm)).mean(), "pcgg_prerequisite_gap": (np.maximum(0, np.diff(wm)) * first[1:]).mean()}
    if mode != "local_only":
        share = clicks.sum(0) / clicks.sum()
        expected |= {"pcgg_modality_std": m.std(1).mean(), "pcgg_parent_child_gap": np.abs(wm[:, None] - m).mean(), "pcgg_breadth": (c > 0.05).any(0).mean(), "pcgg_modality_entropy": -(share * np.log(np.maximum(share, 1e-12))).sum() / np.log(3)}
    if "residual" in mode:
        pm, pc = m[:-1, order], c[:-1, order]
        off = m - np.where(c.sum(1) > 1e-9, (m * c).sum(1) / np.maximum(c.sum(1), 1e-300), 0.5)[:, None]
        expected |= {"pcgg_res_t_mean": ((m[1:] - pm) * pc).sum() / max(pc.sum(), 1e-9), "pcgg_res_h_std": off.std(), "pcgg_res_h_max": off.max()}
    for name, value in expected.items():
        assert math.isclose(row[name], value, rel_tol=1e-9, abs_tol=1e-12), name


def test_folds_cover_all_groups_evenly(spark):
    shapes = [(10 + k % 3, 20 - k % 5, 1 + k % 7) for k in range(15)]
    spare = models.spare_folds(shapes, 5, 42)
    assert {k: len(v) for k, v in spare.items()} == {(b, g): m % 5 for b, g, m in shapes}
    assert spare == models.spare_folds(shapes[::-1], 5, 42)
    with pytest.raises(ValueError):
        models.spare_folds([(1, 2, 3)], 5, 1)
    rows = table(spark, [(k, f"M{k % 3}", f"P{k % 8}", int(k % 7 < 3)) for k in range(1200)], "id_student long, code_module string, code_presentation string, label int")
    for unit, groups in (("presentation", 24), ("learner", 1200)):
        got = models.fold_table(rows, models.Config(split_unit=unit, repeats=2)).toPandas()
        assert len(got) == 2400 and got.groupby(["repeat", "split_group"]).fold.nunique().max() == 1 and got.split_group.nunique() == groups
        for _, own in got.groupby("repeat"):
            sizes, share = own.groupby("fold").size(), own.groupby("fold").label.mean()
            assert set(sizes.index) == {1, 2, 3, 4, 5} and (sizes.max() - sizes.min()) <= (50 if unit == "presentation" else 2) and share.max() - share.min() < 0.1
    if unit == "learner":
        one, two = (dict(zip(own.split_group, own.fold)) for _, own in got.groupby("repeat"))
        assert one != two


def test_static_modes(spark):
    info = table(spark, [(1, "M", "P", "F", "Wales", "HE Qualification", "10-20", "0-35", 1, 60, "Y", "Pass")], "id_student long, code_module string, code_presentation string, gender string, region string, highest_education string, imd_band string, age_band string, num_of_prev_attempts int, studied_credits int, disability string, final_result string")
    reg = table(spark, [(1, "M", "P", None, 3.0)], "id_student long, code_module string, code_presentation string, date_registration double, date_unregistration double")
    df = static.static_features(info, reg)
    row = df.first()
    assert row["stat_registration_lead"] is None and row["stat_registered_late"] == 0.0 and row["stat_imd"] == 1.0 and row["stat_region_Wales"] == 1.0
    assert "stat_education" in static.without_sensitive(df, "core_only_removed").columns and "stat_education" not in static.without_sensitive(df, "all").columns
    assert not {"final_result", "date_unregistration"} & set(df.columns)


def test_checks(spark, tmp_path):
    a = table(spark, [(1, 1.0), (2, None)], "k int, v double")
    assert checks.compare_grouped(a, a, ["k"], ["v"]).isEmpty()
    assert checks.compare_grouped(a, a.withColumn("v", F.coalesce("v", F.lit(0.0))), ["k"], ["v"]).count() == 1
    assert checks.compare_grouped(a, a.where("k = 1"), ["k"], ["v"]).count() == 1
    assert checks.table_digest(a) == checks.table_digest(a.orderBy(F.desc("k")))
    with pytest.raises(ValueError, match="leads out"):
        checks.inside(str(tmp_path), "../x")


def test_tables(spark, tmp_path):
    from waymark.sources import tables

    (tmp_path / "studentVle.csv").write_text("code_module,code_presentation,id_student,id_site,date,sum_click\nM,P,1,2,-3,4\nM,P,1,2,3,4\n")
    assert tables.read_vle_events(spark, str(tmp_path / "studentVle.csv")).count() == 1
    for part in ("train", "test"):
        (tmp_path / part).mkdir()
        (tmp_path / part / f"truth_{part}.csv").write_text("1,0\n2,1\n")
    assert tables.read_kdd(spark, str(tmp_path), "truth").columns == ["enrollment_id", "dropout"]
    assert tables.read_kdd(spark, str(tmp_path), "truth").count() == 4
    scored = table(spark, [(1, "a", 0.5), (2, "b", 0.1 + 0.2)], "week int, model string, p double")
    tables.write_predictions(scored, str(tmp_path / "p"))
    tables.write_predictions(scored.where("week = 1"), str(tmp_path / "p"))
    assert tables.read_predictions(spark, str(tmp_path / "p"), [2]).first()["p"] == 0.1 + 0.2
    tables.write_json({"a": 1}, str(tmp_path / "m.json"))
    assert tables.read_json(str(tmp_path / "m.json")) == {"a": 1}


def scored_rows(spark, n=240):
    rng = np.random.default_rng(6)
    x, z = rng.normal(size=n), rng.normal(size=n)
    rows = [(k, "M", f"P{k % 6}", int(x[k] + 0.3 * rng.normal() > 0), float(x[k]), float(z[k])) for k in range(n)]
    return table(spark, rows, "id_student long, code_module string, code_presentation string, y int, a double, b double")


#: Parameters that keep a fit short.
SHORT = {"flat_hgb": {"rounds": 5, "rate": 0.3}, "base_rf_gini": {"numTrees": 5}, "base_rf_entropy": {"numTrees": 5}, "base_dffnn": {"epochs": 25, "batch": 16}}


@pytest.mark.parametrize("name", ["flat_hgb", "base_lr_weekly", "base_rf_gini", "base_rf_entropy", "base_svm", "base_knn", "base_dffnn"])
def test_every_estimator_tells_the_classes_apart(spark, name):
    rows = scored_rows(spark)
    train, test = rows.where("id_student % 3 != 0"), rows.where("id_student % 3 = 0")
    got = models.fit_and_score(name, train, test, ["a", "b"], 1, SHORT.get(name)).select("y", "p_success").collect()
    y, p = np.array([r[0] for r in got]), np.array([r[1] for r in got])
    assert len(got) == 80 and ((p >= 0) & (p <= 1)).all() and auc(y, p) > 0.85


def test_nearest_neighbours_against_numpy(spark):
    rows = scored_rows(spark)
    train, test = rows.where("id_student % 3 != 0"), rows.where("id_student % 3 = 0")
    got = {r["id_student"]: r["p_success"] for r in models.fit_and_score("base_knn", train, test, ["a", "b"], 1).collect()}
    t = train.toPandas()
    mean, spread = t[["a", "b"]].mean(), t[["a", "b"]].std()
    x = ((t[["a", "b"]] - mean) / spread).to_numpy()
    for r in test.toPandas().itertuples():
        far = ((x - ((np.array([r.a, r.b]) - mean.to_numpy()) / spread.to_numpy())) ** 2).sum(1)
        assert math.isclose(got[r.id_student], t["y"].to_numpy()[np.argsort(far, kind="stable")[:50]].mean())


def benchmark_base(spark):
    rows = scored_rows(spark).withColumnRenamed("y", "label")
    flags = {"risk": 1 - F.col("label"), "has_activity": F.col("id_student") % 2 == 0, "no_activity": (F.col("id_student") % 2).cast("int"), "outcome_realized": F.lit(False), "membership_class": F.lit("eligible_active"), "dataset": F.lit("d"), "static_full": F.lit(True)}
    # In presentation P0 the valid are of one class, so that evaluation is left out.
    return rows.withColumns(flags).withColumn("activity_conditioned", F.col("has_activity")).withColumn("cutoff_valid", (F.col("code_presentation") != "P0") | (F.col("label") == 1))


def test_benchmark_leaves_out_tests_of_one_class(spark):
    base, config = benchmark_base(spark), models.Config(folds=6, repeats=1)
    folds = models.fold_table(base.select(*KEY, "label"), config)
    got = models.benchmark(spark, base, folds, "base_lr_weekly", ["a", "b"], 4, config).groupBy("protocol", "code_presentation").count().collect()
    seen = {(r["protocol"], r["code_presentation"]) for r in got}
    assert ("cutoff_valid", "P0") not in seen and ("static_full", "P0") in seen and ("cutoff_valid", "P1") in seen
    assert {r["count"] for r in got if r["protocol"] == "static_full"} == {40}


def test_cells_are_taken_up_and_not_mixed(spark, tmp_path):
    made = []

    def cell(week):
        return lambda: made.append(week) or table(spark, [(week,)], "p_success int")

    cells, folder = {(w, "m"): cell(w) for w in (2, 4)}, str(tmp_path / "run")
    assert models.run_cells(spark, folder, cells, {"seed": 1}) == [(2, "m"), (4, "m")]
    (tmp_path / "run" / "week=4-model=m.json").unlink()
    assert models.run_cells(spark, folder, cells, {"seed": 1}) == [(4, "m")] and made == [2, 4, 4]
    assert spark.read.parquet(folder + "/panel").count() == 2
    with pytest.raises(ValueError, match="another run"):
        models.run_cells(spark, folder, cells, {"seed": 2})


def test_augmentation_refits_whole_populations(spark):
    schema = "id_student long, protocol string, p_success double"
    old = table(spark, [(1, "static_full", 0.1), (1, "cutoff_valid", 0.2), (1, "activity_conditioned", 0.3), (1, "activity_to_cutoff_valid", 0.4), (1, "hazard", 0.5)], schema)
    asked = []

    def refit(specs):
        asked.append(specs)
        rows = [(1, p, t, e, 0.9) for t, cells in specs.items() for p, e in cells]
        return table(spark, rows, "id_student long, protocol string, train_protocol string, eval_protocol string, p_success double")

    written = models.protocol({"seed": 1}, {"panel": old})
    assert [c["protocol"] for c in written["cells"]] == [p for cells in models.SPECS.values() for p, _ in cells]
    got = {r["protocol"]: (r["train_protocol"], r["eval_protocol"], r["p_success"]) for r in models.augment(old, written, {"seed": 1}, refit).collect()}
    assert asked == [{"cutoff_valid": models.SPECS["cutoff_valid"]}]
    assert got == {
        "static_full": ("static_full", "static_full", 0.1), "activity_conditioned": ("activity_conditioned", "activity_conditioned", 0.3),
        "activity_to_cutoff_valid": ("activity_conditioned", "cutoff_valid", 0.4), "hazard": (None, None, 0.5),
        "cutoff_valid": ("cutoff_valid", "cutoff_valid", 0.9), "cutoff_valid_to_activity": ("cutoff_valid", "activity_conditioned", 0.9),
    }
    with pytest.raises(ValueError, match="other settings"):
        models.augment(old, written, {"seed": 2}, refit)
    with pytest.raises(ValueError, match="not the one"):
        models.augment(old.where("p_success < 0.5"), written, {"seed": 1}, refit)
    whole = table(spark, [(1, p, 0.5) for cells in models.SPECS.values() for p, _ in cells], schema)
    with pytest.raises(ValueError, match="nothing to add"):
        models.augment(whole, models.protocol({"seed": 1}, {"panel": whole}), {"seed": 1}, refit)


def test_hazard_from_frame_to_scores(spark):
    rows = benchmark_base(spark).drop("a", "b")
    members = rows.withColumn("week", F.explode(F.array(F.lit(2), F.lit(4)))).withColumn("cutoff_day", 7 * F.col("week")).withColumn("cutoff_valid", F.lit(True))
    members = members.withColumn("date_unregistration", F.when(F.col("label") == 0, F.col("cutoff_day") + F.col("id_student") % 9).cast("double"))
    frame = hazard.hazard_frame(members)
    assert frame.where("hazard_event = 1").count() == members.where("label = 0 AND id_student % 9 < 7").count()
    features = {w: scored_rows(spark).select(*KEY, "a", *(["b"] if w == 4 else [])) for w in (2, 4)}
    ready, names = hazard.with_features(frame, features)
    assert names == ["a", "b", "landmark_week"] and ready.where("landmark_week = 2 AND b != 0").isEmpty()
    config = models.Config(folds=3, repeats=2)
    folds = models.fold_table(rows.select(*KEY, "label"), config)
    scores = hazard.hazard_scores(ready, folds, "flat_hgb", names, config, {"rounds": 3, "rate": 0.3})
    assert scores.count() == 2 * 480
    panel = hazard.average_hazard(scores)
    assert panel.count() == 480 and metrics.cell_metrics(panel, ["model"]).first()["auc"] > 0.7


def test_every_representation_is_built(spark):
    rng = np.random.default_rng(1)
    rows = [(k, "M", "P", w, *rng.integers(0, 9, 3).tolist(), int(rng.integers(0, 2)), 0.5, 0.6, 0.5) for k in range(5) for w in range(1, 4)]
    panel = table(spark, rows, "id_student long, code_module string, code_presentation string, week_index int, clicks_total int, clicks_a int, clicks_b int, assess_attempts int, assess_score_mean double, assess_score_max double, assess_score_weighted double").withColumn("active_days", F.lit(1))
    one = panel.select(*KEY).distinct()
    blocks = [one.withColumns({c: F.col("id_student") * 1.0 for c in names}) for names in (["stat_x"], ["gap_x", "time_x", "cohort_x", "other_x"], [*traversal.ORDER_COLUMNS, *traversal.VOLUME_COLUMNS])]
    built = represent.representations(panel, 2, *blocks)
    assert len(built) == 12
    for name, build in built.items():
        df = build()
        assert df.select(*KEY).distinct().count() == df.count() == 5, name
        columns = set(df.columns)
        assert ("stat_x" in columns) == (name in ("base_lr_profile", "base_rf_gini", "base_rf_entropy", "base_dffnn", "stack_7_full")), name
        assert ("clicks_total_week2" in columns) == (name in ("temporal_hgb", "base_lr_weekly", "base_rf_gini", "base_rf_entropy", "base_dffnn")), name
        assert ("clicks_total" in columns) == (name in ("flat_hgb", "base_lr_clickstream", "base_svm", "base_knn")), name
        assert ({"gap_x", "time_x", "cohort_x", "trav_reach"} <= columns) == (name == "stack_7_full") and not {"other_x", "trav_coverage"} & columns
    flat = {r["id_student"]: r["clicks_total"] for r in built["flat_hgb"]().collect()}
    assert flat == {k: sum(r[4] for r in rows if r[0] == k and r[3] <= 2) for k in range(5)}


def test_permutations_move_every_place():
    for size in (1, 2, 5, 9):
        for seed in range(20):
            order = state.permutation(size, seed)
            assert sorted(order) == list(range(size)) and (size == 1 or all(k != v for k, v in enumerate(order)))
            assert sorted(state.permutation(size, seed, proper=False)) == list(range(size))


def test_sensitivity_is_in_the_columns_and_their_names(spark):
    df = table(spark, [(1.0,) * 6], "stat_imd double, stat_education double, stat_region_X double, stat_is_repeat double, gap_age double, stat_female double")
    assert static.without_sensitive(df, "core_only_removed").columns == ["stat_education", "stat_is_repeat", "gap_age"] and static.without_sensitive(df, "all").columns == ["stat_is_repeat", "gap_age"]
    marked = df.withMetadata("gap_age", {"sensitivity": "protected"})
    assert "gap_age" not in static.without_sensitive(marked, "all").columns and static.without_sensitive(marked).columns == df.columns
    with pytest.raises(ValueError, match="mode"):
        static.without_sensitive(df, "some")


def test_logistic_fits_run_beside_each_other(spark, monkeypatch):
    """Six fits wait for each other at a barrier: one after the other they would never pass it."""
    from threading import Barrier

    from waymark.operators import models

    rows = spark.range(24).selectExpr("id AS id_student", "'a' AS code_module", "'b' AS code_presentation", "cast(id % 2 AS int) AS label", "cast(1 - id % 2 AS int) AS risk", "'oulab' AS dataset", "true AS has_activity", "0 AS no_activity", "false AS outcome_realized", "true AS cutoff_valid", "'eligible_active' AS membership_class", "true AS activity_conditioned", "true AS static_full", "cast(id AS double) AS clicks")
    folds = spark.range(24).selectExpr("id AS id_student", "'a' AS code_module", "'b' AS code_presentation", "1 AS repeat", "cast(1 + (id div 2) % 2 AS int) AS fold")
    barrier, fit = Barrier(6, timeout=60), models.fit_and_score

    def waits(*args):
        barrier.wait()
        return fit(*args)

    monkeypatch.setattr(models, "fit_and_score", waits)
    found = models.benchmark(spark, rows, folds, "base_lr_weekly", ["clicks"], 16, models.Config(folds=2, repeats=1))
    assert found.count() == 5 * 24
    assert found.select("protocol").distinct().count() == 5


def test_all_fits_at_once_equal_fits_one_by_one(spark):
    from functools import reduce

    from pyspark.sql import DataFrame

    from waymark.operators import logistic

    base, config = benchmark_base(spark), models.Config(folds=6, repeats=2)
    folds = models.fold_table(base.select(*KEY, "label"), config)
    # At week 6 one feature is constant, and rows occur that are equal but for their keys.
    cells = {4: (base, ["a", "b"]), 6: (base.withColumns({"b": F.lit(3.0), "a": F.round("a")}), ["a", "b", "a"])}
    rows = reduce(DataFrame.unionByName, [df.withColumn("week", F.lit(w)).withColumn("x", F.array(*names)) for w, (df, names) in cells.items()])
    got = logistic.benchmark_all({"base_lr_weekly": rows}, folds, [4, 6], logistic.Layout(models.SPECS, 2, 6))
    one = models.benchmark(spark, base, folds, "base_lr_weekly", ["a", "b"], 4, config, limits={"tol": 1e-12})
    assert got.columns == one.columns
    assert got.select([c for c in got.columns if c not in ("p_success", "risk_score")]).where("week = 4").exceptAll(one.drop("p_success", "risk_score")).count() == 0
    values = {(r["id_student"], r["protocol"], r["repeat"]): r["p_success"] for r in got.where("week = 4").collect()}
    plain = {(r["id_student"], r["protocol"], r["repeat"]): r["p_success"] for r in one.collect()}
    assert values.keys() == plain.keys() and all(math.isclose(values[k], plain[k], abs_tol=1e-6) for k in plain)
    # Twice the same feature and a constant: the optimum by plain gradient steps.
    fitted = got.where("week = 6 AND protocol = 'static_full' AND repeat = 1 AND fold = 1").toPandas()
    held = rows.where("week = 6").join(folds.where("repeat = 1").drop("label"), KEY).select("id_student", "a", "label", "fold").toPandas()
    train = held[held["fold"] != 1]
    mean, spread = train["a"].mean(), train["a"].std()
    x, y, w = ((train["a"] - mean) / spread).to_numpy(), train["label"].to_numpy(), np.zeros(2)
    for _ in range(20_000):
        off = 1 / (1 + np.exp(-(w[0] + 2 * w[1] * x))) - y
        w -= 0.002 * np.array([off.sum(), (off * x).sum() + w[1]])
    a = fitted.merge(held[["id_student", "a"]], on="id_student")
    assert len(fitted) and np.allclose(a["p_success"], 1 / (1 + np.exp(-(w[0] + 2 * w[1] * (a["a"] - mean) / spread))), atol=1e-6)


def test_features_of_all_landmarks_equal_those_of_each(spark):
    from oracle import SMALL

    from waymark.operators import represent
    from waymark.plans import queries
    from waymark.sources.fixtures import Binding

    b, weeks = Binding(spark, SMALL), [2, 16]
    everyone, panel = queries.members(b, weeks), queries.panel(b)
    about = static.static_features(b.info(), b.registration())
    found = represent.logistic_features(everyone, panel, about, weeks)
    assert sorted(found) == sorted(models.LOGISTIC)
    for name, rows in found.items():
        for week in weeks:
            built = represent.representations(panel, week, about, about, about)[name]()
            plain = represent.align_to_roster(everyone.where(F.col("week") == week), built, [about])
            names = [c for c in plain.columns if c not in KEY]
            a = {r["id_student"]: r["x"] for r in rows.where(F.col("week") == week).collect()}
            e = {r[KEY[0]]: [float(r[c]) for c in names] for r in plain.collect()}
            assert a.keys() == e.keys() and all(np.allclose(a[k], e[k], rtol=1e-12) for k in e), (name, week)
