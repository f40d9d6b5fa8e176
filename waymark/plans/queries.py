"""The operators as queries over the bound tables, keyed by the identifiers of the operator inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.columns import KEY, day_to_week, group_id
from waymark.operators import behaviour, bootstrap, checks, cohort, decide, evidence, hazard, logistic, metrics, models, order, represent, state, static, traversal
from waymark.sources.fixtures import WEEKS, Binding, Until
from waymark.sources.scratch import stored

TYPES = [f"t{k}" for k in range(5)]
SOURCES = ["click", "error", "purchase", "scroll", "view"]
#: Draws of the bootstrap's queries, and of the same queries with their SQL over all draws.
DRAWS, FEW_DRAWS = 1000, 20
#: Enrolments in one task, about: landmarks, models, protocols and repeats make up to 300 rows of each.
ENROLMENTS = 2_500
#: The same where nothing multiplies them, but their features are many columns and array expressions.
LEARNERS = 20_000
#: Digits to which values that lie on the edge between two roundings by nature are rounded first.
STEADY = 12
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Callable[[Binding], DataFrame]], Query]:
    def register(f: Callable[[Binding], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Binding(spark, sf_dir))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        return run

    return register


def rounded(df: DataFrame, digits: int = 7, steady: bool = False) -> DataFrame:
    """Doubles rounded, so that engines that add in another order agree; minus zero is zero. Steady values are rounded to
    STEADY digits first: halves of the last digit, frequent among ratios of small numbers, lose the noise of the sums."""
    first = (lambda x: F.round(x, STEADY)) if steady else (lambda x: x)
    return df.withColumns({c: F.round(first(F.col(c)), digits) + F.lit(0.0) for c, kind in df.dtypes if kind == "double"})


def roster(b: Binding) -> DataFrame:
    return cohort.load_roster(b.labels(), b.registration(), b.many)


def members(b: Binding, weeks: list[int] = WEEKS) -> DataFrame:
    """Membership by interactions alone."""
    active = b.vle_events().where("date >= 0").withColumn("week_index", day_to_week(F.col("date")))
    return cohort.membership(roster(b), active, weeks, parts=b.parts("customer", ENROLMENTS))


def panel(b: Binding) -> DataFrame:
    """Weekly evidence up to the last landmark."""
    vle = evidence.vle_weekly(b.vle_events().where(F.col("date") < 7 * WEEKS[-1]), b.sites(), TYPES)
    assess = evidence.assess_weekly(b.submissions().where(F.col("date_submitted") < 7 * WEEKS[-1]), b.assessments())
    return evidence.weekly_panel(vle, assess, WEEKS[-1])


def dealt_panel(b: Binding) -> DataFrame:
    """The panel by enrolment, before features of many columns or array expressions make its few bytes much work: Spark
    would leave it to a task or two, and move sums of every column and week instead of rows."""
    n = b.parts("customer", LEARNERS)
    return panel(b).repartition(n, *KEY) if n else panel(b)


def held_members(b: Binding) -> DataFrame:
    """Membership, stored and dealt by enrolment, for queries that read it several times: else each time is one more copy of
    the plan, with broadcasts of its own, and the driver holds all of them at once."""
    n, rows = b.parts("customer", ENROLMENTS), stored(members(b), "members")
    return rows.repartition(n, *KEY) if n else rows


def predictions(b: Binding, factor: int = 7919, rows: DataFrame | None = None) -> DataFrame:
    """A deterministic scored panel: five protocols, three models, tied scores. Another factor gives other scores. rows are
    the members if they are at hand."""
    rows = (members(b) if rows is None else rows).withColumn("model", F.explode(F.array(*map(F.lit, ("m1", "m2", "m3")))))
    arms = [(p, t, e) for t, cells in models.SPECS.items() for p, e in cells]
    cell = F.explode(F.array(*[F.struct(F.lit(p).alias("protocol"), F.lit(t).alias("train_protocol"), F.lit(e).alias("eval_protocol"), F.col(e).alias("use"), F.lit(i % 3).alias("shift")) for i, (p, t, e) in enumerate(arms)]))
    arm = {"activity_conditioned": 0, "static_full": 1, "cutoff_valid": 2}
    shift: Column = F.lit(0)
    for name, k in arm.items():
        shift = F.when(F.col("cell.train_protocol") == name, k).otherwise(shift)
    p = (300 * F.col("label") + (F.col("id_student") * factor + F.col("week") * 31 + F.substring("model", 2, 1).cast("int") * 17 + shift * 13) % 700) / 1000.0
    rows = rows.withColumn("cell", cell).where("cell.use")
    return rows.select(
        "dataset", "week", "cell.protocol", "cell.train_protocol", "cell.eval_protocol", "model", *KEY, F.col("label").alias("y"), "risk", "has_activity", "no_activity", "outcome_realized", "cutoff_valid", "membership_class",
        group_id("presentation").alias("cluster_id"), F.lit("presentation").alias("cluster_unit"), p.cast("double").alias("p_success"), (1 - p.cast("double")).alias("risk_score"),
    )


def scored(b: Binding, factor: int = 7919) -> DataFrame:
    """What bootstraps read of the panel, stored: for the clusters, the point values and the draws."""
    return stored(predictions(b, factor).select("dataset", "week", "protocol", "model", "code_module", "cluster_id", "cluster_unit", "y", "p_success"), "panel")


def draws(b: Binding, rows: DataFrame, n: int = DRAWS) -> DataFrame:
    return bootstrap.draw_table(bootstrap.clusters_of(rows), n)


@query("P1_labels")
def _(b: Binding) -> DataFrame:
    return evidence.make_labels(b.info(), "multiclass4")


@query("P2_kdd_labels")
def _(b: Binding) -> DataFrame:
    return evidence.kdd_labels(b.kdd_enrolments(), b.kdd_truth())


@query("P3_admissible_submissions")
def _(b: Binding) -> DataFrame:
    return evidence.admissible_submissions(b.submissions()).groupBy("id_student").agg(F.count(F.lit(1)).alias("n"), F.sum("date_submitted").cast("long").alias("days"))


@query("P9_membership")
def _(b: Binding) -> DataFrame:
    return members(b).select(*KEY, "week", "has_activity", "no_activity", "registered_by_cutoff", "outcome_realized", "cutoff_valid", "membership_class")


@query("P11_roster")
def _(b: Binding) -> DataFrame:
    return roster(b)


@query("P13_static_features")
def _(b: Binding) -> DataFrame:
    return rounded(static.static_features(b.info(), b.registration()))


@query("A1_vle_weekly")
def _(b: Binding) -> DataFrame:
    return evidence.vle_weekly(b.vle_events(), b.sites(), TYPES)


@query("A3_assess_weekly")
def _(b: Binding) -> DataFrame:
    return rounded(evidence.assess_weekly(b.submissions(), b.assessments()))


@query("A5_kdd_weekly")
def _(b: Binding) -> DataFrame:
    return evidence.kdd_weekly(b.kdd_logs(), b.kdd_enrolments(), b.kdd_dates(), SOURCES)


@query("A6_kdd_assess_weekly")
def _(b: Binding) -> DataFrame:
    return evidence.kdd_assess_weekly(evidence.kdd_weekly(b.kdd_logs(), b.kdd_enrolments(), b.kdd_dates(), []))


@query("A7_course_weeks")
def _(b: Binding) -> DataFrame:
    return evidence.course_weeks(b.site_weeks(), b.vle_events())


@query("A8_kdd_course_weeks")
def _(b: Binding) -> DataFrame:
    return evidence.kdd_course_weeks(b.kdd_dates())


@query("W14_prerequisite_edges")
def _(b: Binding) -> DataFrame:
    return evidence.prerequisite_edges(evidence.course_weeks(b.site_weeks(), b.vle_events()))


@query("J8_weekly_panel")
def _(b: Binding) -> DataFrame:
    return rounded(panel(b))


@query("A9_gap_features")
def _(b: Binding) -> DataFrame:
    return rounded(behaviour.gap_features(b.vle_events(), WEEKS))


@query("A11_timing_features")
def _(b: Binding) -> DataFrame:
    return rounded(behaviour.timing_features(roster(b), b.submissions(), b.assessments(), WEEKS))


@query("A13_cohort_features")
def _(b: Binding) -> DataFrame:
    return rounded(behaviour.cohort_features(b.vle_events(), WEEKS))


@query("R3_behavioural_features")
def _(b: Binding) -> DataFrame:
    return rounded(behaviour.behavioural_features(b.vle_events(), roster(b), b.submissions(), b.assessments(), WEEKS))


@query("A14_canonical_order")
def _(b: Binding) -> DataFrame:
    return rounded(traversal.canonical_order(b.vle_events().where((F.col("date") >= 0) & (F.col("date") < 7 * WEEKS[-1]))))


@query("A15_traversal_features")
def _(b: Binding) -> DataFrame:
    return rounded(traversal.traversal_features(b.vle_events(), WEEKS))


@query("A16_flat_features")
def _(b: Binding) -> DataFrame:
    return rounded(represent.flat_features(dealt_panel(b), 16))


@query("A17_temporal_features")
def _(b: Binding) -> DataFrame:
    return rounded(represent.temporal_features(dealt_panel(b), 4))


@query("J7_align_to_roster")
def _(b: Binding) -> DataFrame:
    flat = represent.flat_features(dealt_panel(b), 8).select(*KEY, "clicks_total", "active_days", "assess_attempts")
    extra = static.static_features(b.info(), b.registration(), []).select(*KEY, F.col("stat_studied_credits").alias("clicks_total"))
    return rounded(represent.align_to_roster(roster(b), flat, [extra]))


@query("A20_flow")
def _(b: Binding) -> DataFrame:
    return rounded(cohort.composition_flow(members(b)))


@query("A20_totals")
def _(b: Binding) -> DataFrame:
    return cohort.composition_totals(members(b))


@query("A20_composition")
def _(b: Binding) -> DataFrame:
    """For each landmark: eligible learners that activity selection drops, leavers that it keeps, and the indices."""
    return rounded(cohort.composition_indices(members(b)))


@query("A21_average_repeats")
def _(b: Binding) -> DataFrame:
    rows = predictions(b).withColumn("repeat", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("p_success", F.col("p_success") + F.col("repeat") / 1000)
    rows = metrics.average_repeats(rows.withColumn("risk_score", 1 - F.col("p_success")))
    return rounded(rows.select("week", "protocol", "train_protocol", "eval_protocol", "model", "id_student", "p_success", "risk_score", "prediction_sd", "n_repeats"))


@query("M5_cell_metrics")
def _(b: Binding) -> DataFrame:
    return rounded(metrics.cell_metrics(predictions(b), ["dataset", "week", "protocol", "model"]))


@query("A22_stratum_summary")
def _(b: Binding) -> DataFrame:
    return rounded(metrics.stratum_summary(predictions(b)))


def bootstrap_queries(n: int, suffix: str) -> None:
    """The bootstrap's queries with n draws."""

    @query(f"B4_bootstrap_summary{suffix}")
    def _(b: Binding) -> DataFrame:
        rows = scored(b)
        return rounded(bootstrap.summary(rows, draws(b, rows, n)), steady=True)

    @query(f"B5_bootstrap_distortion{suffix}")
    def _(b: Binding) -> DataFrame:
        rows = scored(b)
        return rounded(bootstrap.distortion(rows, draws(b, rows, n)), steady=True)

    @query(f"B6_decomposition{suffix}")
    def _(b: Binding) -> DataFrame:
        rows = scored(b)
        return rounded(bootstrap.decomposition(rows, draws(b, rows, n)), steady=True)

    @query(f"B7_module_clusters{suffix}")
    def _(b: Binding) -> DataFrame:
        rows = scored(b).withColumn("cluster_id", group_id("module")).withColumn("cluster_unit", F.lit("module"))
        return rounded(bootstrap.decomposition(rows, draws(b, rows, n)), steady=True)

    @query(f"B8_aggregate{suffix}")
    def _(b: Binding) -> DataFrame:
        rows = scored(b)
        return rounded(bootstrap.aggregate(rows, draws(b, rows, n)), steady=True)

    @query(f"B9_paired_difference{suffix}")
    def _(b: Binding) -> DataFrame:
        """The same enrolments, scored twice."""
        rows = scored(b)
        return rounded(bootstrap.paired_difference(scored(b, 6421), rows, draws(b, rows, n)), steady=True)

    @query(f"A26_exclusion_counts{suffix}")
    def _(b: Binding) -> DataFrame:
        rows = scored(b)
        return rounded(bootstrap.exclusion_counts(stored(bootstrap.decomposition(rows, draws(b, rows, n)), "contrasts")), steady=True)


bootstrap_queries(DRAWS, "")
bootstrap_queries(FEW_DRAWS, f"_{FEW_DRAWS}_draws")


@query("B6_contrasts")
def _(b: Binding) -> DataFrame:
    """Point values of the contrasts."""
    keys = ["week", "model"]
    rows = bootstrap.long_metrics(metrics.cell_metrics(predictions(b), [*keys, "protocol"]), [*keys, "protocol"])
    return rounded(bootstrap.contrast_values(rows, keys))


@query("B10_tie_audit")
def _(b: Binding) -> DataFrame:
    return bootstrap.tie_partition_audit(predictions(b))


@query("B11_precision_by_rows")
def _(b: Binding) -> DataFrame:
    """The second way to the precision of the first, middle and last draw, of all cells."""
    rows = scored(b)
    chosen = draws(b, rows).where(F.col("draw").isin(0, DRAWS // 2, DRAWS - 1))
    return rounded(bootstrap.row_weighted_precision(rows, chosen, ["dataset", "week", "protocol", "model"]), steady=True)


@query("B11_cross_check")
def _(b: Binding) -> DataFrame:
    """Where the two ways differ: nowhere."""
    rows = scored(b)
    return bootstrap.cross_check(rows, stored(draws(b, rows), "draws"), ["dataset", "week", "protocol", "model"], [0, DRAWS // 2, DRAWS - 1])


@query("O4_first_occurrence")
def _(b: Binding) -> DataFrame:
    """Modules and account states of the enrolments in the order in which the file first has them."""
    rows = order.read_in_order(b.spark, f"{b.dir}/customer.parquet")
    return order.first_occurrence(rows.select(F.col("c_mktsegment").alias("code_module"), (F.col("c_acctbal") < 0).alias("in_debt"), "source_order"), "code_module", "in_debt")


@query("O7_first_labels")
def _(b: Binding) -> DataFrame:
    """A label for each learner from several: that of the first order in the file."""
    rows = order.read_in_order(b.spark, f"{b.dir}/orders.parquet")
    return order.keep_first(rows.select(F.col("o_custkey").alias("id_student"), "o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("label"), "source_order"), "id_student")


@query("V1_landmark_audit")
def _(b: Binding) -> DataFrame:
    """What the raw days alone say of each landmark."""
    return checks.landmark_audit(b.vle_events(), b.submissions(), b.assessments(), roster(b), WEEKS)


@query("J2_incomplete_joins")
def _(b: Binding) -> DataFrame:
    """Interactions by site where the sites' table lacks every 17th one: a many-to-one join that is not complete."""
    sites = b.sites().where("activity_type IS NOT NULL")
    return checks.without_match(b.vle_events().select("id_site").distinct(), sites, ["id_site"])


@query("O2_capacities")
def _(b: Binding) -> DataFrame:
    return decide.capacities(predictions(b).where("protocol = 'cutoff_valid'"), decide.BUDGETS)


@query("O1_selections")
def _(b: Binding) -> DataFrame:
    return rounded(decide.selections(predictions(b)).select("week", "model", "protocol", "budget", "cluster_id", "id_student", "risk", "risk_score"))


@query("D1_budget_table")
def _(b: Binding) -> DataFrame:
    return rounded(decide.budget_table(predictions(b))[0])


@query("D2_overlap_table")
def _(b: Binding) -> DataFrame:
    return rounded(decide.overlap_table(decide.selections(predictions(b))))


@query("D3_ranking_stability")
def _(b: Binding) -> DataFrame:
    return rounded(decide.ranking_stability(metrics.cell_metrics(predictions(b), ["dataset", "week", "protocol", "model"])))


@query("D4_metric_components")
def _(b: Binding) -> DataFrame:
    return rounded(decide.metric_components(predictions(b)))


@query("D4_component_budget")
def _(b: Binding) -> DataFrame:
    return rounded(decide.component_budget(predictions(b), 0.1)[0])


@query("D4_recall_gains")
def _(b: Binding) -> DataFrame:
    return rounded(decide.component_budget(predictions(b), 0.1)[1])


@query("A27_gain_summary")
def _(b: Binding) -> DataFrame:
    return rounded(decide.gain_summary(decide.component_budget(predictions(b), 0.1)[1]))


@query("A23_subgroup_coverage")
def _(b: Binding) -> DataFrame:
    return rounded(decide.subgroup_coverage(members(b), b.info()))


@query("A23_subgroup_allocation")
def _(b: Binding) -> DataFrame:
    rows = predictions(b).where("week = 16")
    return rounded(decide.subgroup_allocation(members(b, [16]), b.info(), rows, decide.selections(rows, [0.05, 0.2])))


@query("A23_subgroup_allocation_all")
def _(b: Binding) -> DataFrame:
    """All landmarks; the query above is defined at the last one."""
    everyone = held_members(b)
    rows = predictions(b, rows=everyone)
    return rounded(decide.subgroup_allocation(everyone, b.info(), rows, decide.selections(rows, [0.05, 0.2])))


@query("A24_excluded_categorical")
def _(b: Binding) -> DataFrame:
    return rounded(decide.excluded_categorical(members(b), b.info()))


@query("A24_excluded_numeric")
def _(b: Binding) -> DataFrame:
    return rounded(decide.excluded_numeric(members(b), b.info()))


@query("R1_chain_features")
def _(b: Binding) -> DataFrame:
    return rounded(state.chain_features(dealt_panel(b), 8))


@query("R1_chain_none")
def _(b: Binding) -> DataFrame:
    return rounded(state.chain_features(dealt_panel(b), 8, "none", uncertainty=False))


@query("R2_graph_features")
def _(b: Binding) -> DataFrame:
    return rounded(state.graph_features(dealt_panel(b), 8))


@query("R2_graph_residual")
def _(b: Binding) -> DataFrame:
    return rounded(state.graph_features(dealt_panel(b), 8, "residual"))


@query("R6_stack_7_full")
def _(b: Binding) -> DataFrame:
    week = 8
    b = Until(b, 7 * week)
    base = static.static_features(b.info(), b.registration())
    behavioural = behaviour.behavioural_features(b.vle_events(), roster(b), b.submissions(), b.assessments(), [week])
    built = represent.representations(dealt_panel(b), week, base, behavioural, traversal.traversal_features(b.vle_events(), [week]))
    return rounded(built["stack_7_full"]())


@query("L8_folds")
def _(b: Binding) -> DataFrame:
    return models.fold_table(roster(b), models.Config())


@query("L2_benchmark_logistic")
def _(b: Binding) -> DataFrame:
    """The logistic regressions at all landmarks, with all folds, repeats and training populations."""
    config = models.Config()
    b = Until(b, 7 * WEEKS[-1])
    everyone, about, n = held_members(b), stored(static.static_features(b.info(), b.registration()), "static"), b.parts("customer", LEARNERS)
    weekly = stored(panel(b), "weekly")
    built = represent.logistic_features(everyone, weekly.repartition(n, *KEY) if n else weekly, about, WEEKS)
    layout = logistic.Layout(models.SPECS, config.repeats, config.folds)
    return logistic.benchmark_all({name: built[name] for name in models.LOGISTIC}, models.fold_table(roster(b), config), WEEKS, layout)


@query("H1_hazard_frame")
def _(b: Binding) -> DataFrame:
    return hazard.hazard_frame(members(b)).select(*KEY, "landmark_week", "hazard_event", "split_group", "cluster_id")


@query("H3_hazard_summary")
def _(b: Binding) -> DataFrame:
    """Metrics of a deterministic event score."""
    frame = hazard.hazard_frame(members(b)).withColumn("model", F.lit("m1")).withColumn("p_event", ((F.col("id_student") * 7919 + F.col("landmark_week") * 31) % 700 + 300 * F.col("hazard_event")) / 1000.0)
    return rounded(metrics.cell_metrics(hazard.average_hazard(frame), ["week", "model"]))


def weekly_differences(b: Binding, days_later: int) -> DataFrame:
    vle = evidence.vle_weekly(b.vle_events(), b.sites(), TYPES).select(*KEY, "week_index", F.col("clicks_total").cast("double").alias("clicks"), F.col("active_days").cast("double").alias("days"))
    moved = b.vle_events().where("date >= 0").withColumn("date", F.col("date") + days_later)
    again = moved.groupBy(*KEY, F.expr("date div 7 + 1").cast("int").alias("week_index")).agg(F.sum("sum_click").cast("double").alias("clicks"), F.countDistinct("date").cast("double").alias("days"))
    return checks.compare_grouped(vle, again, [*KEY, "week_index"], ["clicks", "days"])


@query("V1_validate_weekly")
def _(b: Binding) -> DataFrame:
    """Differences between the weekly table and one derived again from days: none."""
    return weekly_differences(b, 0)


@query("V1_weeks_a_day_late")
def _(b: Binding) -> DataFrame:
    """Differences from a table whose weeks begin a day early: what the validation finds in a wrong table."""
    return weekly_differences(b, 1)


@query("U4_equal_sets")
def _(b: Binding) -> DataFrame:
    """Learners with interactions but no submission by the last landmark, and the other way round."""
    rows = panel(b)
    return checks.set_difference(rows.where("clicks_total IS NOT NULL"), rows.where("assess_attempts IS NOT NULL"), KEY)
