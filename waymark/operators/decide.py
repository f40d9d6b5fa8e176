"""Capacity-limited selection, overlap of selections, subgroups and recall components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.columns import KEY, average_rank, correlation, finite
from waymark.operators.bootstrap import AA, AV, HELD, VA, VV
from waymark.operators.metrics import METRICS, cell_metrics
from waymark.sources.scratch import parts, stored

CELL = ["dataset", "week", "model"]
BUDGETS = [0.01, 0.05, 0.10, 0.20]
#: Rows in one task, about, where stored rows are ranked or compared.
ROWS = 500_000


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def capacities(reference: DataFrame, budgets: list[float], by: list[str] = CELL) -> DataFrame:
    """by, budget, cluster_id, capacity: the budget's share of the cluster, half to even, one at least."""
    sizes = reference.groupBy(*by, "cluster_id").agg(F.count(F.lit(1)).alias("size")).withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    return sizes.select(*by, "budget", "cluster_id", F.greatest(F.lit(1), F.bround(F.col("budget") * F.col("size")).cast("int")).alias("capacity"))


def select_at_budget(scored: DataFrame, capacity: DataFrame, by: list[str] = CELL, arm: str = "protocol", n: int | None = None) -> DataFrame:
    """The riskiest of each cluster up to its capacity; equal risks in the order of KEY. Other clusters select none. Rows
    are ranked in n tasks, or as many as Spark chooses."""
    # The order does not depend on the budget: rows are ranked once, and then meet only the budgets that reach them.
    nth = F.row_number().over(Window.partitionBy(*by, arm, "cluster_id").orderBy(F.desc("risk_score"), *KEY))
    scored = scored.repartition(n, *by, arm, "cluster_id") if n else scored
    return scored.withColumn("nth", nth).join(capacity, [*by, "cluster_id"]).where("nth <= capacity").drop("nth", "capacity")


def _chosen(rows: DataFrame, budgets: list[float], reference: str) -> DataFrame:
    """The selected of stored rows, stored. Capacities are few where clusters are: then they are broadcast, as a join by
    sorting would move all ranked rows again."""
    capacity = stored(capacities(rows.where(F.col("protocol") == reference), budgets), "capacities")
    capacity = F.broadcast(capacity) if capacity.count() <= HELD else capacity.hint("merge")
    return stored(select_at_budget(rows, capacity, n=parts(rows, ROWS)), "selected")


def selections(predictions: DataFrame, budgets: list[float] = BUDGETS, reference: str = VV) -> DataFrame:
    """The selected rows of budget_table alone, without its marks."""
    own = ["cluster_id", "risk", "risk_score", *CELL, "protocol"]
    return _chosen(stored(predictions.select(*KEY, *own), "scored"), budgets, reference).select(*KEY, *own, "budget")


def budget_table(predictions: DataFrame, budgets: list[float] = BUDGETS, reference: str = VV) -> tuple[DataFrame, DataFrame]:
    """Performance per cell, protocol and budget, and the selected rows.

    Capacity comes from the reference population under every protocol; actionable_precision divides by all flagged.
    """
    # Whether an enrolment of a cell is in the reference population is one maximum over its rows.
    own = F.coalesce(F.max(F.col("protocol") == reference).over(Window.partitionBy(*CELL, *KEY)), F.lit(False))
    marked = stored(predictions.select(*CELL, "protocol", *KEY, "cluster_id", "risk", "risk_score").withColumn("in_reference", own), "marked")
    ref = marked.where(F.col("protocol") == reference)
    chosen = _chosen(marked, budgets, reference)
    everyone = marked.groupBy(*CELL, "protocol").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if("in_reference").alias("n_actionable_candidates"), F.sum("risk").alias("risks"))
    totals = ref.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_reference"), F.sum("risk").alias("reference_risks"))
    flagged = chosen.groupBy(*CELL, "protocol", "budget").agg(
        F.count(F.lit(1)).alias("n_flagged"), F.count_if("in_reference").alias("n_actionable_flagged"), F.sum("risk").alias("caught"), F.sum(F.when(F.col("in_reference"), F.col("risk")).otherwise(0)).alias("reached")
    )
    rows = everyone.join(totals, CELL).withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).join(flagged, [*CELL, "protocol", "budget"], "left")
    rows = rows.fillna(0, ["n_flagged", "n_actionable_flagged", "caught", "reached"])
    n, actionable = F.col("n_flagged"), F.col("n_actionable_flagged")
    some = lambda a, b: F.when(b > 0, ratio(a, F.nullif(b, F.lit(0))))
    table = rows.select(
        *CELL, "protocol", F.lit(reference).alias("reference_protocol"), "budget", "n_candidates", "n_reference", "n_flagged", "n_actionable_candidates", "n_actionable_flagged", (n - actionable).alias("n_invalid_flagged"),
        some(F.col("caught"), n).alias("precision"), some(F.col("reached"), n).alias("actionable_precision"), some(F.col("reached"), actionable).alias("precision_among_actionable"), some(n - actionable, n).alias("wasted_budget_rate"),
        some(F.col("caught"), F.col("risks")).alias("recall_protocol"), some(F.col("reached"), F.col("reference_risks")).alias("coverage_adjusted_recall"), ratio(F.col("n_actionable_candidates"), F.col("n_reference")).alias("candidate_coverage"),
    )
    return table, chosen.select(*KEY, "cluster_id", "risk", "risk_score", *CELL, "protocol", "budget")


def _overlap(flags: DataFrame, by: list[str], counts: Column | None = None) -> DataFrame:
    """jaccard, intersection and union from one row per member with left and right, of the comparisons that count."""
    both, either = F.count_if(F.col("left") & F.col("right")), F.count_if(F.col("left") | F.col("right"))
    rows = flags.groupBy(*by).agg(both.alias("intersection"), either.alias("union"), (F.lit(True) if counts is None else counts).alias("there"))
    return rows.where("there").drop("there").withColumn("jaccard", ratio(F.col("intersection"), F.nullif(F.col("union"), F.lit(0))))


def overlap_table(selections: DataFrame, reference: str = VV, dataset_with_cross: str = "oulab") -> DataFrame:
    """Jaccard agreement of selections: with the reference, across evaluation populations, and from landmark to landmark."""
    own = ["dataset", "week", "model", "budget"]
    selections = selections.select(*own, "protocol", *KEY)
    # Both comparisons below are by enrolment and more, so that one shuffle by enrolment serves both.
    n = parts(selections, ROWS)
    dealt = selections.repartition(n, *KEY) if n else selections.repartition(*KEY)
    arms = sorted(r[0] for r in selections.select("protocol").distinct().collect())  # a handful
    pairs = [("protocol", arm, reference) for arm in arms if arm != reference] + [("evaluation_population", AA, AV), ("evaluation_population", VV, VA)]
    # Each row goes only to the comparisons that its own arm takes part in.
    part = F.explode(
        F.array(
            *[
                F.struct(F.lit(kind).alias("comparison_type"), F.lit(a).alias("protocol"), F.lit(b).alias("reference_protocol"), (F.col("protocol") == a).alias("left"), (F.col("protocol") == b).alias("right"))
                for kind, a, b in pairs
            ]
        )
    )
    sides = dealt.select(*own, *KEY, part.alias("p")).select(*own, *KEY, "p.*").where((F.col("left") | F.col("right")) & ((F.col("comparison_type") == "protocol") | (F.col("dataset") == dataset_with_cross)))
    by = ["comparison_type", *own, "protocol", "reference_protocol"]
    flags = sides.groupBy(*by, *KEY).agg(F.bool_or("left").alias("left"), F.bool_or("right").alias("right"))
    here = _overlap(flags, by, F.bool_or("left") & ((F.col("comparison_type") == "protocol") | F.bool_or("right"))).withColumn("week_from", F.col("week")).withColumn("week_to", F.col("week")).drop("week")
    series = ["dataset", "protocol", "model", "budget"]
    weeks = selections.select(*series, "week").distinct()
    steps = weeks.withColumn("week_to", F.lead("week").over(Window.partitionBy(*series).orderBy("week"))).where("week_to IS NOT NULL").withColumnRenamed("week", "week_from")
    rows = dealt.select(*series, "week", *KEY).join(F.broadcast(steps), series).where("week = week_from OR week = week_to")
    flags = rows.groupBy(*series, "week_from", "week_to", *KEY).agg(F.bool_or(F.col("week") == F.col("week_from")).alias("left"), F.bool_or(F.col("week") == F.col("week_to")).alias("right"))
    time = _overlap(flags, [*series, "week_from", "week_to"]).withColumn("comparison_type", F.lit("time")).withColumn("reference_protocol", F.col("protocol"))
    return here.unionByName(time)


def ranking_stability(metrics: DataFrame, reference: str = VV) -> DataFrame:
    """Spearman agreement of model rankings with the reference, and whether the best model changes.

    metrics has dataset, week, protocol, model and the four metrics; of equally good models the first by name is best.
    """
    rows = metrics.unpivot(["dataset", "week", "protocol", "model"], METRICS, "metric", "value").where("value IS NOT NULL")
    rows = rows.withColumn("value", F.when(F.col("metric").isin("brier", "ece"), F.col("value")).otherwise(-F.col("value")))
    base = rows.where(F.col("protocol") == reference).select("dataset", "week", "model", "metric", F.col("value").alias("base"))
    by = ["dataset", "week", "protocol", "metric"]
    pairs = rows.where(F.col("protocol") != reference).join(base, ["dataset", "week", "model", "metric"])
    pairs = pairs.withColumn("rank_other", average_rank(by, "value")).withColumn("rank_ref", average_rank(by, "base"))
    best = lambda c: F.min(F.struct(c, "model"))["model"]
    out = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("rank_ref"), F.col("rank_other")).alias("spearman_rank_correlation"), best("base").alias("best_reference"), best("value").alias("best_protocol"))
    return out.where("n >= 2").drop("n").withColumn("reference_protocol", F.lit(reference)).withColumn("ranking_reversal", F.col("best_reference") != F.col("best_protocol"))


def with_components(predictions: DataFrame) -> DataFrame:
    """Rows of the arms AA, AI, AV, VA, VI, VV; AI and VI are the eligible of AA and VA."""
    code: Column = F.lit(None).cast("array<string>")
    for protocol, arms in ((AA, ["AA", "AI"]), (AV, ["AV"]), (VA, ["VA", "VI"]), (VV, ["VV"])):
        code = F.when(F.col("protocol") == protocol, F.array(*map(F.lit, arms))).otherwise(code)
    rows = predictions.withColumn("arm", F.explode(code))
    return rows.where(~F.col("arm").isin("AI", "VI") | F.col("cutoff_valid"))


def metric_components(predictions: DataFrame) -> DataFrame:
    """Per week, model and metric: the share of ineligibility and of silence in the evaluation component."""
    keys = ["week", "model"]
    values = cell_metrics(with_components(predictions), [*keys, "arm"]).unpivot([*keys, "arm"], METRICS, "metric", "value")
    s = values.groupBy(*keys, "metric").pivot("arm", ["AA", "AI", "AV", "VA", "VI", "VV"]).agg(F.first("value"))
    half = lambda a, b, c, d: 0.5 * ((F.col(a) - F.col(b)) + (F.col(c) - F.col(d)))
    return s.select(*keys, "metric", half("AA", "AI", "VA", "VI").alias("nonelig"), half("AI", "AV", "VI", "VV").alias("silence"), half("AA", "AV", "VA", "VV").alias("evaluation"))


def component_budget(predictions: DataFrame, budget: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Per week, model and arm (AA, AI, AV, VV) recall and precision at the budget, and the paired recall gains."""
    keys = ["week", "model"]
    rows = with_components(predictions)
    ref = rows.where("arm = 'VV'")
    arms = rows.where(F.col("arm").isin("AA", "AI", "AV", "VV"))
    chosen = select_at_budget(arms, capacities(ref, [budget], keys), keys, "arm")
    totals = ref.groupBy(*keys).agg(F.sum("risk").alias("risks"), F.count(F.lit(1)).alias("n_ref"))
    there = arms.groupBy(*keys, "arm").agg(F.count_if("cutoff_valid").alias("eligible_candidates"))
    picked = chosen.groupBy(*keys, "arm", "budget").agg(F.count(F.lit(1)).alias("n"), F.count_if("cutoff_valid").alias("eligible"), F.sum(F.when(F.col("cutoff_valid"), F.col("risk")).otherwise(0)).alias("reached"))
    all_rows = picked.join(there, [*keys, "arm"]).join(totals, keys)
    table = all_rows.select(
        *keys, "arm", "budget", ratio(F.col("reached"), F.nullif(F.col("risks"), F.lit(0))).alias("coverage_adjusted_recall"), ratio(F.col("reached"), F.col("n")).alias("actionable_precision"),
        (1 - ratio(F.col("eligible"), F.col("n"))).alias("wasted_budget_rate"), ratio(F.col("eligible_candidates"), F.col("n_ref")).alias("candidate_coverage"),
    )
    wide = table.groupBy(*keys, "budget").pivot("arm", ["AA", "AI", "AV", "VV"]).agg(F.first("coverage_adjusted_recall"))
    gains = wide.select(*keys, "budget", (F.col("AI") - F.col("AA")).alias("eligibility"), (F.col("AV") - F.col("AI")).alias("silence"), (F.col("AV") - F.col("AA")).alias("total"))
    return table, gains


def gain_summary(gains: DataFrame) -> DataFrame:
    """Median gain and number of cells by its sign."""
    rows = gains.unpivot(["week", "model", "budget"], ["eligibility", "silence", "total"], "gain", "value")
    return rows.groupBy("gain").agg(F.median("value").alias("median"), F.count_if(F.col("value") > 0).alias("positive"), F.count_if(F.col("value") < 0).alias("negative"), F.count_if(F.col("value") == 0).alias("zero"))


ATTRIBUTES = ["imd_band", "disability", "gender", "age_band", "highest_education"]


def _by_attribute(rows: DataFrame, info: DataFrame, attributes: list[str]) -> DataFrame:
    """Each row once per attribute with its group; a null group is called nan."""
    about = info.select(*KEY, F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.coalesce(F.col(a).cast("string"), F.lit("nan")).alias("group")) for a in attributes])).alias("a"))
    return rows.join(about.select(*KEY, "a.attribute", "a.group"), KEY)


def subgroup_coverage(members: DataFrame, info: DataFrame, attributes: list[str] = ATTRIBUTES, protocols: tuple[str, ...] = (AA, "static_full", VV)) -> DataFrame:
    """Per week, attribute, group and protocol: how much of the valid population a protocol includes."""
    rows = _by_attribute(members.where("cutoff_valid"), info, attributes)
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("protocol"), F.col(p).alias("included")) for p in protocols]))
    rows = rows.withColumn("p", each).select("dataset", "week", "attribute", "group", "risk", "p.protocol", "p.included")
    return rows.groupBy("dataset", "week", "attribute", "group", "protocol").agg(
        F.count(F.lit(1)).alias("n_reference"), F.count_if("included").alias("n_included"), ratio(F.count_if("included"), F.count(F.lit(1))).alias("coverage"), F.avg("risk").alias("reference_risk_rate"), F.avg(F.when(F.col("included"), F.col("risk"))).alias("included_risk_rate")
    )


def _sums_by_group(rows: DataFrame, by: list[str], attributes: list[str], sums: dict[str, Column]) -> DataFrame:
    """by, attribute, group and sums. Rows are added up by all attributes at once, so that their combinations and not the
    rows are multiplied."""
    few = rows.groupBy(*by, *attributes).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("group")) for a in attributes])).alias("a")
    return few.select(*by, *sums, each).groupBy(*by, "a.attribute", "a.group").agg(*[F.sum(k).alias(k) for k in sums])


def subgroup_allocation(members: DataFrame, info: DataFrame, predictions: DataFrame, selections: DataFrame, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """Per selection and group: what a budget reaches among the valid; invalid selections use budget up for nothing.

    Each population is counted by group where it lies, and only the counts meet: the valid are not multiplied by cells.
    """
    own = [*CELL, "protocol", "budget"]
    about = info.select(*KEY, *[F.coalesce(F.col(a).cast("string"), F.lit("nan")).alias(a) for a in attributes])
    valid = members.where("cutoff_valid").select("dataset", "week", *KEY, "risk")
    # An enrolment's valid landmarks in one row: then all joins are by enrolment, and rows dealt by it stay where they are.
    # Enrolments are a row each in few bytes of files, but hundreds of bytes in memory: Spark would broadcast them.
    known = valid.groupBy(*KEY).agg(F.collect_list(F.struct("dataset", "week", "risk")).alias("valid"))
    known = about.hint("merge").join(known.hint("merge"), KEY, "left").hint("merge")
    here = F.filter("valid", lambda v: (v["dataset"] == F.col("dataset")) & (v["week"] == F.col("week")))
    there = F.coalesce(F.array_size("here"), F.lit(0))
    reached = F.coalesce(F.aggregate("here", F.lit(0).cast("long"), lambda total, v: total + F.coalesce(v["risk"], F.lit(0))), F.lit(0))
    reference = _sums_by_group(valid.join(about.hint("merge"), KEY), ["dataset", "week"], attributes, {"n_reference": F.lit(1), "risks": F.col("risk")})
    candidates = predictions.select(*CELL, "protocol", *KEY).distinct().join(known, KEY).withColumn("here", here)
    candidates = _sums_by_group(candidates, [*CELL, "protocol"], attributes, {"n_candidates": there})
    n = parts(selections, ROWS)
    dealt = selections.repartition(n, *KEY) if n else selections.repartition(*KEY)
    times = dealt.groupBy(*own, *KEY).agg(F.count(F.lit(1)).alias("times")).join(known, KEY).withColumn("here", here)
    selected = _sums_by_group(times, own, attributes, {"n_selected": F.col("times"), "n_actionable_selected": there, "caught": reached})
    by = [*own, "attribute", "group"]
    cells = selections.select(*own).distinct()
    base = cells.join(reference, ["dataset", "week"]).join(candidates, [*CELL, "protocol", "attribute", "group"], "left")
    rows = base.join(selected, by, "left").fillna(0, ["n_candidates", "n_selected", "n_actionable_selected", "caught"])
    some = lambda a, b: F.when(F.col(b) > 0, ratio(a, F.nullif(F.col(b), F.lit(0))))
    return rows.select(
        *by, "n_reference", "n_candidates", "n_selected", "n_actionable_selected", some(F.col("n_candidates"), "n_reference").alias("candidate_coverage"), some(F.col("n_actionable_selected"), "n_reference").alias("selection_rate"),
        some(F.col("caught"), "n_selected").alias("actionable_precision"), some(F.col("caught"), "risks").alias("coverage_adjusted_risk_recall"), some(F.col("n_selected") - F.col("n_actionable_selected"), "n_selected").alias("wasted_budget_rate"),
    )


def excluded_categorical(members: DataFrame, info: DataFrame, attributes: tuple[str, ...] = ("gender", "region", "highest_education", "imd_band", "age_band", "disability")) -> DataFrame:
    """Shares and risk of each group among the eligible active and the eligible silent."""
    rows = _by_attribute(members.where("cutoff_valid"), info, list(attributes)).withColumnRenamed("membership_class", "observability")
    counts = rows.groupBy("dataset", "week", "attribute", "group", "observability").agg(F.count("label").alias("n"), F.avg("risk").alias("risk_rate"))
    return counts.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("dataset", "week", "attribute", "observability"))))


def excluded_numeric(members: DataFrame, info: DataFrame, attributes: tuple[str, ...] = ("num_of_prev_attempts", "studied_credits", "date_registration")) -> DataFrame:
    """Means and standardised difference (silent less active) of numeric attributes; the roster's registration day is used."""
    rows = members.where("cutoff_valid").join(info.select(*KEY, *[a for a in attributes if a in info.columns]), KEY, "left")
    rows = rows.select("dataset", "week", "has_activity", F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), finite(F.col(a)).alias("value")) for a in attributes])).alias("a")).select("dataset", "week", "has_activity", "a.*")
    active, silent = (F.when(c, F.col("value")) for c in (F.col("has_activity"), ~F.col("has_activity")))
    spread = lambda v: F.greatest(F.count(v) - 1, F.lit(0)) * F.var_samp(v)
    pooled = F.sqrt((spread(active) + spread(silent)) / F.greatest(F.count(active) + F.count(silent) - 2, F.lit(1)))
    out = rows.groupBy("dataset", "week", "attribute").agg(F.count(active).alias("active_n"), F.count(silent).alias("silent_n"), F.avg(active).alias("active_mean"), F.avg(silent).alias("silent_mean"), pooled.alias("pooled"))
    return out.withColumn("standardized_mean_difference", F.when(F.col("pooled") > 0, (F.col("silent_mean") - F.col("active_mean")) / F.col("pooled"))).drop("pooled")
