"""The queries in DuckDB SQL, written against the star-schema tables without the library's plans."""

from __future__ import annotations

from waymark.sources.fixtures import WEEKS

# Fixed values, written here anew so that an error in the library's does not show on both sides.
METRICS = ["auc", "pr_auc_risk", "brier", "ece"]
EDGES = [k * 0.1 for k in range(1, 10)]
CELLS = ["activity_conditioned", "activity_to_cutoff_valid", "cutoff_valid_to_activity", "cutoff_valid"]
_JOINT, _HALF = (1, 0, 0, -1), 0.5
CONTRASTS = {
    "joint_population_difference": _JOINT,
    "evaluation_population_component": (1, -1, 0, 0),
    "training_population_component": (0, 1, 0, -1),
    "training_population_component_at_activity": (1, 0, -1, 0),
    "evaluation_population_component_at_valid": (0, 0, 1, -1),
    "evaluation_population_shapley": (_HALF, -_HALF, _HALF, -_HALF),
    "training_population_shapley": (_HALF, _HALF, -_HALF, -_HALF),
}

_BASE = """
info AS (
  SELECT c_custkey AS id_student, c_mktsegment AS code_module, r_name AS code_presentation, c_acctbal,
    CASE c_custkey % 5 WHEN 0 THEN 'Withdrawn' WHEN 1 THEN 'Fail' WHEN 2 THEN 'Pass' WHEN 3 THEN 'Distinction' ELSE 'Other' END AS final_result,
    CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, n_name AS region,
    (['No Formal quals', 'Lower Than A Level', 'A Level or Equivalent', 'HE Qualification', 'Post Graduate Qualification', 'Unknown'])[c_custkey % 6 + 1] AS highest_education,
    CASE c_custkey % 4 WHEN 0 THEN '0-10%' WHEN 1 THEN '10-20' WHEN 2 THEN '90-100%' END AS imd_band,
    CASE c_custkey % 3 WHEN 0 THEN '0-35' WHEN 1 THEN '35-55' ELSE '55<=' END AS age_band,
    CASE WHEN c_custkey % 7 = 0 THEN 'Y' ELSE 'N' END AS disability, (c_custkey % 3)::INT AS num_of_prev_attempts, (30 * (c_custkey % 5 + 1))::INT AS studied_credits
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
roster AS (
  SELECT id_student, code_module, code_presentation, (c_acctbal >= 3000)::INT AS label, 1 - (c_acctbal >= 3000)::INT AS risk,
    CASE WHEN id_student % 29 <> 0 THEN (id_student * 37) % 160 - 60 END::INT AS date_registration,
    CASE WHEN id_student % 5 = 0 THEN (id_student * 37) % 160 - 60 + 20 + (id_student * 13) % 120 END::INT AS date_unregistration
  FROM info),
vle AS (
  SELECT r.id_student, code_module, code_presentation, l_partkey AS id_site, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS date, l_quantity::BIGINT AS sum_click
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN info r ON o_custkey = r.id_student),
pres AS (SELECT code_module, code_presentation, dense_rank() OVER (ORDER BY code_module, code_presentation) - 1 AS nth FROM (SELECT DISTINCT code_module, code_presentation FROM info)),
assess AS (SELECT (nth * 8 + k)::BIGINT AS id_assessment, code_module, code_presentation, CASE WHEN k < 7 THEN 14.0 * (k + 1) END AS due, 5.0 * (k + 1) AS weight FROM pres, range(8) t(k)),
sub AS (
  SELECT id_student, code_module, code_presentation, (nth * 8 + l_suppkey % 8)::BIGINT AS id_assessment, date_diff('day', DATE '1995-01-01', l_shipdate::DATE)::DOUBLE AS day,
    CASE WHEN l_linenumber <> 7 THEN round(l_discount * 1000)::BIGINT END AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN info ON o_custkey = id_student JOIN pres USING (code_module, code_presentation)
  WHERE l_shipdate::DATE >= DATE '1995-01-01' AND NOT (l_linestatus = 'F' AND l_linenumber = 1)),
wk AS (SELECT unnest([2, 4, 6, 8, 10, 12, 14, 16])::INT AS w),
mem AS (
  SELECT *, CASE WHEN NOT registered_by_cutoff THEN 'not_yet_registered' WHEN outcome_realized THEN 'outcome_realized_' || act ELSE 'eligible_' || act END AS membership_class,
    registered_by_cutoff AND NOT outcome_realized AS cutoff_valid
  FROM (
    SELECT r.*, w AS week, coalesce(first < 7 * w, false) AS has_activity, CASE WHEN coalesce(first < 7 * w, false) THEN 'active' ELSE 'silent' END AS act,
      date_registration IS NULL OR date_registration < 7 * w AS registered_by_cutoff, coalesce(date_unregistration < 7 * w, false) AS outcome_realized
    FROM roster r CROSS JOIN wk LEFT JOIN (SELECT id_student, min(date) AS first FROM vle WHERE date >= 0 GROUP BY ALL) f USING (id_student)))"""

_PANEL = """
vlew AS (
  SELECT id_student, code_module, code_presentation, (date // 7 + 1)::INT AS week_index, sum(sum_click)::BIGINT AS clicks_total, count(DISTINCT date) AS active_days,
    coalesce(sum(sum_click) FILTER (WHERE t = 't0'), 0)::BIGINT AS clicks_t0, coalesce(sum(sum_click) FILTER (WHERE t = 't1'), 0)::BIGINT AS clicks_t1, coalesce(sum(sum_click) FILTER (WHERE t = 't2'), 0)::BIGINT AS clicks_t2,
    coalesce(sum(sum_click) FILTER (WHERE t = 't3'), 0)::BIGINT AS clicks_t3, coalesce(sum(sum_click) FILTER (WHERE t = 't4'), 0)::BIGINT AS clicks_t4
  FROM vle LEFT JOIN (SELECT p_partkey, CASE WHEN p_partkey % 17 <> 0 THEN 't' || p_size % 5 END AS t FROM part) ON id_site = p_partkey WHERE date >= 0 GROUP BY ALL),
assw AS (
  SELECT id_student, s.code_module, s.code_presentation, (floor(day / 7) + 1)::INT AS week_index, count(*) AS assess_attempts, avg(score / 100) AS assess_score_mean, max(score / 100) AS assess_score_max,
    coalesce(sum(score / 100 * weight / 100), 0) / sum(weight / 100) AS assess_score_weighted
  FROM sub s JOIN assess a USING (id_assessment) GROUP BY ALL),
panel AS (SELECT * FROM (SELECT * FROM vlew WHERE week_index <= 16) FULL JOIN (SELECT * FROM assw WHERE week_index <= 16) USING (id_student, code_module, code_presentation, week_index))"""

_PRED = """
pred AS (
  SELECT 'oulab' AS dataset, week, protocol, train_protocol, eval_protocol, 'm' || m AS model, id_student, code_module, code_presentation, label AS y, risk, has_activity, cutoff_valid, membership_class,
    code_module || '::' || code_presentation AS cluster_id, (300 * label + (id_student * 7919 + week * 31 + m * 17 + shift * 13) % 700) / 1000.0::DOUBLE AS p_success,
    1 - (300 * label + (id_student * 7919 + week * 31 + m * 17 + shift * 13) % 700) / 1000.0::DOUBLE AS risk_score
  FROM mem CROSS JOIN range(1, 4) t(m) CROSS JOIN (VALUES
    ('activity_conditioned', 'activity_conditioned', 'activity_conditioned', 0), ('activity_to_cutoff_valid', 'activity_conditioned', 'cutoff_valid', 0), ('static_full', 'static_full', 'static_full', 1),
    ('cutoff_valid', 'cutoff_valid', 'cutoff_valid', 2), ('cutoff_valid_to_activity', 'cutoff_valid', 'activity_conditioned', 2)) c(protocol, train_protocol, eval_protocol, shift)
  WHERE CASE eval_protocol WHEN 'cutoff_valid' THEN cutoff_valid WHEN 'activity_conditioned' THEN has_activity ELSE true END)"""


def _metrics(source: str, keys: str, name: str) -> str:
    """CTEs that give `name` the metrics of source (y, p_success) by keys, row by row instead of by threshold."""
    bins = "len(list_filter(" + str(EDGES) + ", lambda e: e <= p))"
    return f"""
{name}_r AS (
  SELECT {keys}, y, p_success AS p, sum(1 - y) OVER (PARTITION BY {keys} ORDER BY p_success) AS upto, sum(1 - y) OVER (PARTITION BY {keys}, p_success) AS tied,
    sum(1 - y) OVER (PARTITION BY {keys} ORDER BY 1 - p_success DESC) AS caught, count(*) OVER (PARTITION BY {keys} ORDER BY 1 - p_success DESC) AS flagged
  FROM {source}),
{name}_b AS (SELECT {keys}, sum(off) AS ece FROM (SELECT {keys}, {bins} AS bin, abs(sum(y - p)) AS off FROM {name}_r GROUP BY ALL) GROUP BY ALL),
{name} AS (
  SELECT {keys}, count(*) AS n,
    CASE WHEN min(y) < max(y) THEN sum(CASE WHEN y = 1 THEN upto - tied / 2.0 END) / (sum(y)::DOUBLE * sum(1 - y)) END AS auc,
    CASE WHEN min(y) < max(y) THEN sum(CASE WHEN y = 0 THEN caught / flagged::DOUBLE END) / sum(1 - y) END AS pr_auc_risk,
    CASE WHEN min(y) < max(y) THEN avg((y - p) ** 2) END AS brier, CASE WHEN min(y) < max(y) THEN any_value(ece) / count(*) END AS ece
  FROM {name}_r JOIN {name}_b USING ({keys}) GROUP BY {keys})"""


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 7) + 0.0 AS {n.split('.')[-1]}" for n in names)


K = "id_student, code_module, code_presentation"
_SELECT = """
cap AS (
  SELECT dataset, week, model, budget, cluster_id, greatest(1, round_even(budget * count(*), 0))::INT AS capacity
  FROM pred CROSS JOIN (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) b(budget) WHERE protocol = 'cutoff_valid' GROUP BY dataset, week, model, budget, cluster_id),
sel AS (
  SELECT pred.*, budget FROM pred JOIN cap USING (dataset, week, model, cluster_id)
  QUALIFY row_number() OVER (PARTITION BY dataset, week, model, protocol, budget, cluster_id ORDER BY risk_score DESC, id_student, code_module, code_presentation) <= capacity)"""
_COMP = """
arm AS (
  SELECT *, unnest(CASE protocol WHEN 'activity_conditioned' THEN ['AA', 'AI'] WHEN 'activity_to_cutoff_valid' THEN ['AV'] WHEN 'cutoff_valid_to_activity' THEN ['VA', 'VI'] WHEN 'cutoff_valid' THEN ['VV'] END) AS a
  FROM pred WHERE protocol <> 'static_full'),
arms AS (SELECT * FROM arm WHERE a NOT IN ('AI', 'VI') OR cutoff_valid)"""
_GAIN = """
ccap AS (SELECT week, model, cluster_id, greatest(1, round_even(0.1::DOUBLE * count(*), 0))::INT AS capacity FROM arms WHERE a = 'VV' GROUP BY ALL),
csel AS (
  SELECT arms.* FROM arms JOIN ccap USING (week, model, cluster_id) WHERE a IN ('AA', 'AI', 'AV', 'VV')
  QUALIFY row_number() OVER (PARTITION BY week, model, a, cluster_id ORDER BY risk_score DESC, id_student, code_module, code_presentation) <= capacity),
cb AS (
  SELECT week, model, a AS arm, 0.1::DOUBLE AS budget, sum(CASE WHEN cutoff_valid THEN risk ELSE 0 END) / nullif(any_value(risks), 0)::DOUBLE AS coverage_adjusted_recall,
    sum(CASE WHEN cutoff_valid THEN risk ELSE 0 END) / count(*)::DOUBLE AS actionable_precision, 1 - sum(cutoff_valid::INT) / count(*)::DOUBLE AS wasted_budget_rate, any_value(elig) / any_value(nref)::DOUBLE AS candidate_coverage
  FROM csel JOIN (SELECT week, model, sum(risk) AS risks, count(*) AS nref FROM arms WHERE a = 'VV' GROUP BY ALL) USING (week, model)
    JOIN (SELECT week, model, a, sum(cutoff_valid::INT) AS elig FROM arms GROUP BY ALL) USING (week, model, a) GROUP BY week, model, a),
gains AS (
  SELECT week, model, budget, max(r) FILTER (arm = 'AI') - max(r) FILTER (arm = 'AA') AS eligibility, max(r) FILTER (arm = 'AV') - max(r) FILTER (arm = 'AI') AS silence, max(r) FILTER (arm = 'AV') - max(r) FILTER (arm = 'AA') AS total
  FROM (SELECT *, coverage_adjusted_recall AS r FROM cb) GROUP BY ALL)"""
_TRAV = """
ev AS (SELECT vle.*, w AS snapshot_week FROM vle JOIN wk ON date >= 0 AND date < 7 * w),
med AS (SELECT code_module, code_presentation, snapshot_week, id_site, median(date) AS d FROM ev GROUP BY ALL),
rk AS (SELECT *, dense_rank() OVER (PARTITION BY code_module, code_presentation, snapshot_week ORDER BY d)::DOUBLE AS k FROM med),
nm AS (SELECT *, k / greatest(max(k) OVER (PARTITION BY code_module, code_presentation, snapshot_week), 1) AS pos FROM rk)"""
_TIMING = """
tsub AS (
  SELECT s.id_student, s.code_module, s.code_presentation, w AS snapshot_week, id_assessment, day, day - due AS late, coalesce(due < 7 * w, false) AS was_due, weight
  FROM sub s JOIN assess a USING (id_assessment) JOIN wk ON day < 7 * w),
tagg AS (
  SELECT id_student, code_module, code_presentation, snapshot_week, count(*) AS n, avg(late) AS mean, max(late) AS mx, last(late ORDER BY day, id_assessment) FILTER (late IS NOT NULL) AS lst,
    avg(CASE WHEN late > 0 THEN 1.0 ELSE 0.0 END) AS rate, sum(weight) AS done, sum(was_due::INT) AS due_done
  FROM tsub GROUP BY ALL),
tdue AS (SELECT code_module, code_presentation, w AS snapshot_week, count(*) AS due, sum(weight) AS due_weight FROM assess JOIN wk ON due < 7 * w GROUP BY ALL)"""

ORACLE_SQL: dict[str, str] = {}
_BODIES: dict[str, str] = {}


def _add(name: str, body: str, *ctes: str) -> None:
    _BODIES[name] = body
    ORACLE_SQL[name] = "WITH " + ",".join([_BASE, *ctes]) + "\n" + body


_add("P1_labels", f"SELECT {K}, final_result AS label_name, CASE final_result WHEN 'Withdrawn' THEN 0 WHEN 'Fail' THEN 1 WHEN 'Pass' THEN 2 WHEN 'Distinction' THEN 3 END::INT AS label FROM info WHERE final_result <> 'Other'")
_add("P2_kdd_labels", "SELECT c_custkey AS id_student, c_mktsegment AS code_module, c_mktsegment AS code_presentation, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 - c_custkey % 2 END::INT AS label FROM customer")
_add("P3_admissible_submissions", "SELECT id_student, count(*) AS n, sum(day)::BIGINT AS days FROM sub GROUP BY ALL")
_add("P9_membership", f"SELECT {K}, week, has_activity, (NOT has_activity)::INT AS no_activity, registered_by_cutoff, outcome_realized, cutoff_valid, membership_class FROM mem")
_add("P11_roster", f"SELECT {K}, label, date_registration, date_unregistration, risk FROM roster")
#: The 25 regions of the tables.
_REGIONS = ", ".join(f"(region = 'NATION_{k}')::INT::DOUBLE AS stat_region_NATION_{k}" for k in range(25))
_add(
    "P13_static_features",
    f"""SELECT {K}, date_registration::DOUBLE AS stat_registration_day, (coalesce(date_registration, 0) > 0)::INT::DOUBLE AS stat_registered_late, CASE WHEN date_registration IS NOT NULL THEN greatest(-date_registration, 0)::DOUBLE END AS stat_registration_lead,
  num_of_prev_attempts::DOUBLE AS stat_prev_attempts, (num_of_prev_attempts > 0)::INT::DOUBLE AS stat_is_repeat, studied_credits::DOUBLE AS stat_studied_credits, CASE WHEN id_student % 6 < 5 THEN (id_student % 6)::DOUBLE END AS stat_education,
  CASE id_student % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0 WHEN 2 THEN 9.0 END AS stat_imd, (id_student % 3)::DOUBLE AS stat_age, (gender = 'F')::INT::DOUBLE AS stat_female, (disability = 'Y')::INT::DOUBLE AS stat_disability,
  round(studied_credits - avg(studied_credits) OVER (PARTITION BY code_module, code_presentation), 7) + 0.0 AS stat_credits_vs_cohort, {_REGIONS}
FROM info JOIN roster USING ({K})""",
)
_add("A1_vle_weekly", "SELECT * FROM vlew", _PANEL)
_add("A3_assess_weekly", f"SELECT {K}, week_index, assess_attempts, {_r('assess_score_mean', 'assess_score_max', 'assess_score_weighted')} FROM assw", _PANEL)
_KDD = """
kl AS (
  SELECT user_id AS id_student, c_mktsegment AS code_module, ts, event_type, CASE WHEN c_mktsegment <> 'MACHINERY' THEN (floor(date_diff('second', TIMESTAMP '2024-01-01', ts) / 604800) + 1)::INT END AS week_index FROM events LEFT JOIN customer ON user_id = c_custkey)"""
_add(
    "A5_kdd_weekly",
    "SELECT id_student, code_module, week_index, count(event_type) AS clicks_total, count(DISTINCT ts::DATE) AS active_days, " + ", ".join(f"count(*) FILTER (event_type = '{s}') AS clicks_src_{s}" for s in ("click", "error", "purchase", "scroll", "view")) + ", code_module AS code_presentation FROM kl WHERE week_index >= 1 AND code_module IS NOT NULL GROUP BY ALL",
    _KDD,
)
_add("A6_kdd_assess_weekly", "SELECT DISTINCT id_student, code_module, code_module AS code_presentation, week_index, 0 AS assess_attempts, 0.0::DOUBLE AS assess_score_mean, 0.0::DOUBLE AS assess_score_max, 0.0::DOUBLE AS assess_score_weighted FROM kl WHERE week_index >= 1 AND code_module IS NOT NULL", _KDD)
_SPAN = """
span AS (
  SELECT code_module, code_presentation, greatest(1, least(min(f), min(v)))::INT AS low, greatest(max(f) + 10, max(h))::INT AS high
  FROM (SELECT code_module, code_presentation, min(id_student) % 3 AS f FROM info GROUP BY ALL) LEFT JOIN (SELECT code_module, code_presentation, min(date // 7 + 1) AS v, max(date // 7 + 1) AS h FROM vle WHERE date >= 0 GROUP BY ALL) USING (code_module, code_presentation) GROUP BY ALL),
cw AS (
  SELECT code_module || '_' || code_presentation || '_W' || CASE WHEN w < 10 THEN '0' ELSE '' END || w AS competency_id, code_module, code_presentation, w::INT AS week_index, code_module || '-' || code_presentation || ' week ' || w AS name
  FROM (SELECT *, unnest(range(low, greatest(low, high) + 1)) AS w FROM span))"""
_add("A7_course_weeks", "SELECT * FROM cw", _SPAN)
_add("A8_kdd_course_weeks", "SELECT m || '_week' || w AS competency_id, m AS code_module, m AS code_presentation, w::INT AS week_index, m || ' Week ' || w AS name FROM (SELECT DISTINCT c_mktsegment AS m FROM customer WHERE c_mktsegment <> 'MACHINERY'), range(1, 6) t(w)")
_add("W14_prerequisite_edges", "SELECT a.competency_id AS source_competency_id, 'prerequisiteOf' AS relation, b.competency_id AS target_competency_id, a.code_module, a.code_presentation FROM cw a JOIN cw b ON a.code_module = b.code_module AND a.code_presentation = b.code_presentation AND b.week_index = a.week_index + 1", _SPAN)
_add("J8_weekly_panel", f"SELECT {K}, week_index, clicks_total, active_days, clicks_t0, clicks_t1, clicks_t2, clicks_t3, clicks_t4, assess_attempts, {_r('assess_score_mean', 'assess_score_max', 'assess_score_weighted')} FROM panel", _PANEL)
_add(
    "A9_gap_features",
    f"""SELECT {K}, snapshot_week, gap_active_days, gap_first_day, gap_last_day, round(coalesce(gm, s), 7) + 0.0 AS gap_max, round(coalesce(ga, s), 7) + 0.0 AS gap_mean, round(coalesce(gs, 0), 7) + 0.0 AS gap_std, s::INT AS gap_days_since_last,
  gap_last_day - gap_first_day AS gap_span, round(gap_active_days / greatest(gap_last_day - gap_first_day, 1), 7) + 0.0 AS gap_density, round((re + 1.0) / (ea + 1.0), 7) + 0.0 AS gap_momentum, round(ln(1 + re), 7) + 0.0 AS gap_recent_clicks
FROM (
  SELECT {K}, w AS snapshot_week, count(*) AS gap_active_days, min(date) AS gap_first_day, max(date) AS gap_last_day, (7 * w - max(date))::DOUBLE AS s, max(g) AS gm, avg(g) AS ga, stddev_samp(g) AS gs,
    coalesce(sum(c) FILTER (date >= 7 * w - 14), 0)::DOUBLE AS re, coalesce(sum(c) FILTER (date < 7 * w - 14 AND date >= 7 * w - 28), 0)::DOUBLE AS ea
  FROM (SELECT *, date - lag(date) OVER (PARTITION BY {K} ORDER BY date) AS g FROM (SELECT {K}, date, sum(sum_click) AS c FROM vle WHERE date >= 0 GROUP BY ALL)) JOIN wk ON date < 7 * w GROUP BY {K}, w)""",
)
_add(
    "A11_timing_features",
    f"""SELECT {K}, snapshot_week, coalesce(n, 0)::DOUBLE AS time_submissions, round(coalesce(mean, 0), 7) + 0.0 AS time_lateness_mean, coalesce(mx, 0) + 0.0 AS time_lateness_max, coalesce(lst, 0) + 0.0 AS time_lateness_last, round(coalesce(rate, 0)::DOUBLE, 7) AS time_late_rate,
  round(-coalesce(mean, 0), 7) + 0.0 AS time_earliness_mean, greatest(coalesce(due, 0) - coalesce(due_done, 0), 0)::DOUBLE AS time_missed, round(greatest(coalesce(due, 0) - coalesce(due_done, 0), 0) / greatest(coalesce(due, 0), 1)::DOUBLE, 7) AS time_missed_rate,
  round(coalesce(done, 0) / greatest(coalesce(due_weight, 0), 1)::DOUBLE, 7) AS time_weight_completed
FROM (SELECT {K}, w AS snapshot_week FROM roster CROSS JOIN wk) LEFT JOIN tagg USING ({K}, snapshot_week) LEFT JOIN tdue USING (code_module, code_presentation, snapshot_week)""",
    _TIMING,
)
_COHORT = """
cbase AS (SELECT id_student, code_module, code_presentation, snapshot_week, sum(sum_click) AS clicks, count(DISTINCT date) AS days, count(DISTINCT id_site) AS sites FROM ev GROUP BY ALL)"""


def _cohort(x: str) -> str:
    by = "PARTITION BY code_module, code_presentation, snapshot_week"
    pct = f"(rank() OVER ({by} ORDER BY {x}) + (count(*) OVER ({by}, {x}) - 1) / 2.0) / (count(*) OVER ({by}))::DOUBLE"
    return f"round({pct}, 7) AS cohort_{x}_pct, round(coalesce(({x} - avg({x}) OVER ({by})) / nullif(stddev_samp({x}) OVER ({by}), 0), 0), 7) + 0.0 AS cohort_{x}_z"


_add("A13_cohort_features", f"SELECT {K}, snapshot_week, {_cohort('clicks')}, {_cohort('days')}, {_cohort('sites')} FROM cbase", _TRAV, _COHORT)
_ON = f"USING ({K}, snapshot_week)"
_add("R3_behavioural_features", f"SELECT * FROM ({_BODIES['A9_gap_features']}) FULL JOIN ({_BODIES['A11_timing_features']}) {_ON} FULL JOIN ({_BODIES['A13_cohort_features']}) {_ON}", _TIMING, _TRAV, _COHORT)
_add("A14_canonical_order", "SELECT code_module, code_presentation, id_site, d AS canonical_day, k AS canonical_rank, round(pos, 7) AS canonical_norm FROM nm WHERE snapshot_week = 16", _TRAV)
_add(
    "A15_traversal_features",
    f"""SELECT {K}, snapshot_week, count(*) AS trav_n_events, count(DISTINCT id_site) AS trav_n_distinct, round(max(pos), 7) AS trav_reach, round(avg(pos), 7) AS trav_position_mean, round(coalesce(stddev_samp(pos), 0), 7) AS trav_position_std,
  round(avg(CASE WHEN st < 0 THEN 1.0::DOUBLE ELSE 0 END), 7) AS trav_backtrack_rate, round(avg(CASE WHEN pos < mx - 1e-9 THEN 1.0::DOUBLE ELSE 0 END), 7) AS trav_below_frontier_rate, round(1 - count(DISTINCT id_site) / count(*)::DOUBLE, 7) AS trav_revisit_rate,
  round(avg(abs(coalesce(st, 0))), 7) AS trav_step_absmean, round(avg(greatest(coalesce(st, 0), 0)), 7) AS trav_forward_jump_mean,
  CASE WHEN count(*) >= 3 AND stddev_pop(pos) >= 1e-12 THEN round(covar_pop(i, r) / (stddev_pop(i) * stddev_pop(r)), 7) + 0.0 ELSE 0.0 END AS trav_order_agreement, round(count(DISTINCT id_site) / any_value(av)::DOUBLE, 7) AS trav_coverage
FROM (
  SELECT *, pos - lag(pos) OVER o AS st, max(pos) OVER (o ROWS UNBOUNDED PRECEDING) AS mx, row_number() OVER o AS i, rank() OVER (PARTITION BY {K}, snapshot_week ORDER BY pos) + (count(*) OVER (PARTITION BY {K}, snapshot_week, pos) - 1) / 2.0 AS r
  FROM ev JOIN nm USING (code_module, code_presentation, snapshot_week, id_site) JOIN (SELECT code_module, code_presentation, snapshot_week, count(*) AS av FROM med GROUP BY ALL) USING (code_module, code_presentation, snapshot_week)
  WINDOW o AS (PARTITION BY {K}, snapshot_week ORDER BY date, pos)) GROUP BY {K}, snapshot_week""",
    _TRAV,
)
_NUM = ["clicks_total", "active_days", "clicks_t0", "clicks_t1", "clicks_t2", "clicks_t3", "clicks_t4", "assess_attempts", "assess_score_mean", "assess_score_max", "assess_score_weighted"]
_add("A16_flat_features", f"SELECT {K}, 16 AS snapshot_week, " + ", ".join(f"round(sum(coalesce({c}, 0)::DOUBLE), 7) AS {c}" for c in _NUM) + f" FROM panel GROUP BY {K}", _PANEL)
_TEMP = ["clicks_total", "active_days", *_NUM[7:]]
_add(
    "A17_temporal_features",
    f"SELECT {K}, 4 AS snapshot_week, " + ", ".join(f"round(coalesce(avg({'ln(1 + coalesce(clicks_total, 0))' if c == 'clicks_total' else f'coalesce({c}, 0)'}::DOUBLE) FILTER (week_index = {w}), 0), 7) AS {c}_week{w}" for c in _TEMP for w in range(1, 5)) + f" FROM panel WHERE week_index <= 4 GROUP BY {K}",
    _PANEL,
)
_add(
    "J7_align_to_roster",
    f"""SELECT {K}, coalesce(c, studied_credits)::DOUBLE AS clicks_total, coalesce(d, 0)::DOUBLE AS active_days, coalesce(n, 0)::DOUBLE AS assess_attempts, CASE WHEN f.id_student IS NULL THEN 1 ELSE 0 END AS no_activity
FROM info LEFT JOIN (SELECT id_student, sum(coalesce(clicks_total, 0)) AS c, sum(coalesce(active_days, 0)) AS d, sum(coalesce(assess_attempts, 0)) AS n FROM panel WHERE week_index <= 8 GROUP BY ALL) f USING (id_student)""",
    _PANEL,
)
_add("A20_flow", "SELECT 'oulab' AS dataset, week, membership_class, count(*) AS n, round(avg(risk), 7) AS risk_rate FROM mem GROUP BY ALL")
_add("A20_totals", "SELECT 'oulab' AS dataset, week, count(*) AS n_labelled, count_if(has_activity)::BIGINT AS n_activity, count(*) AS n_static, count_if(cutoff_valid)::BIGINT AS n_cutoff_valid, count_if(outcome_realized)::BIGINT AS n_outcome_realized FROM mem GROUP BY ALL")
_add(
    "A20_composition",
    """SELECT 'oulab' AS dataset, week, count_if(a)::BIGINT AS n_activity, count_if(v)::BIGINT AS n_cutoff_valid, count_if(a AND outcome_realized)::BIGINT AS known_outcomes_in_activity, count_if(v AND NOT a)::BIGINT AS eligible_silent_excluded, count_if(v AND a)::BIGINT AS eligible_active,
  round(count_if(a AND outcome_realized) / nullif(count_if(a), 0)::DOUBLE, 7) AS activity_contamination_rate, round(count_if(v AND NOT a) / nullif(count_if(v), 0)::DOUBLE, 7) AS silent_exclusion_rate, round(count_if(a AND v) / nullif(count_if(a OR v), 0)::DOUBLE, 7) AS cohort_jaccard,
  round(avg(risk) FILTER (v AND NOT a), 7) AS silent_risk_rate, round(avg(risk) FILTER (v AND a), 7) AS eligible_active_risk_rate, round(avg(risk) FILTER (v AND NOT a) / nullif(avg(risk) FILTER (v AND a), 0), 7) AS risk_concentration_ratio
FROM (SELECT *, has_activity AS a, cutoff_valid AS v FROM mem) GROUP BY week""",
)
_add("A21_average_repeats", "SELECT week, protocol, train_protocol, eval_protocol, model, id_student, round(p_success + 0.002, 7) AS p_success, round(1 - p_success - 0.002, 7) + 0.0 AS risk_score, 0.001::DOUBLE AS prediction_sd, 3::BIGINT AS n_repeats FROM pred", _PRED)
_add("M5_cell_metrics", f"SELECT dataset, week, protocol, model, n, {_r(*METRICS)} FROM met", _PRED, _metrics("pred", "dataset, week, protocol, model", "met"))
_add(
    "A22_stratum_summary",
    f"""SELECT dataset, week, model, protocol, membership_class, train_protocol, eval_protocol, n_clusters, round(rr, 7) AS risk_rate, round(mp, 7) AS mean_predicted_risk, n, {_r(*METRICS)}
FROM met JOIN (SELECT dataset, week, model, protocol, membership_class, any_value(train_protocol) AS train_protocol, any_value(eval_protocol) AS eval_protocol, count(DISTINCT cluster_id) AS n_clusters, avg(risk) AS rr, avg(risk_score) AS mp FROM st GROUP BY ALL) USING (dataset, week, model, protocol, membership_class)""",
    _PRED, "st AS (SELECT * FROM pred WHERE protocol IN ('activity_to_cutoff_valid', 'cutoff_valid') AND membership_class LIKE 'eligible%')", _metrics("st", "dataset, week, model, protocol, membership_class", "met"),
)
_LONG = "lng AS (UNPIVOT met ON " + ", ".join(METRICS) + " INTO NAME metric VALUE value)"
_WIDE = "wide AS (SELECT week, model, metric, " + ", ".join(f"max(value) FILTER (protocol = '{c}') AS {c}" for c in CELLS) + " FROM lng GROUP BY ALL)"
_add("B6_contrasts", " UNION ALL ".join(f"SELECT week, model, metric, '{name}' AS contrast, round(" + " + ".join(f"{w} * {c}" for c, w in zip(CELLS, ws) if w) + ", 7) + 0.0 AS value FROM wide" for name, ws in CONTRASTS.items()), _PRED, _metrics("pred", "week, model, protocol", "met"), _LONG, _WIDE)
_add("B10_tie_audit", "SELECT dataset, week, protocol, model, count(DISTINCT p_success) AS n_p, count(DISTINCT 1 - p_success) AS n_risk, count(DISTINCT p_success) - count(DISTINCT 1 - p_success) AS merged_thresholds FROM pred GROUP BY ALL", _PRED)
_add("O2_capacities", "SELECT * FROM cap", _PRED, _SELECT)
_add("O1_selections", "SELECT week, model, protocol, budget, cluster_id, id_student, risk, round(risk_score, 7) + 0.0 AS risk_score FROM sel", _PRED, _SELECT)
_add(
    "D1_budget_table",
    """SELECT dataset, week, model, protocol, 'cutoff_valid' AS reference_protocol, budget, nc AS n_candidates, nr AS n_reference, n AS n_flagged, nac AS n_actionable_candidates, na AS n_actionable_flagged, n - na AS n_invalid_flagged, round(caught / n, 7) AS precision, round(reached / n, 7) AS actionable_precision,
  CASE WHEN na > 0 THEN round(reached / na, 7) END AS precision_among_actionable, round((n - na) / n::DOUBLE, 7) AS wasted_budget_rate, CASE WHEN risks > 0 THEN round(caught / risks, 7) END AS recall_protocol, CASE WHEN rrisks > 0 THEN round(reached / rrisks, 7) END AS coverage_adjusted_recall, round(nac / nr::DOUBLE, 7) AS candidate_coverage
FROM (SELECT dataset, week, model, protocol, budget, count(*) AS n, count_if(cutoff_valid)::BIGINT AS na, sum(risk)::DOUBLE AS caught, sum(CASE WHEN cutoff_valid THEN risk ELSE 0 END)::DOUBLE AS reached FROM sel GROUP BY ALL)
JOIN (SELECT dataset, week, model, protocol, count(*) AS nc, count_if(cutoff_valid)::BIGINT AS nac, sum(risk)::DOUBLE AS risks FROM pred GROUP BY ALL) USING (dataset, week, model, protocol)
JOIN (SELECT week, model, count(*) AS nr, sum(risk)::DOUBLE AS rrisks FROM pred WHERE protocol = 'cutoff_valid' GROUP BY ALL) USING (week, model)""",
    _PRED, _SELECT,
)
_PAIR = "count_if(l AND r)::BIGINT AS intersection, count(*) AS \"union\", round(count_if(l AND r) / count(*)::DOUBLE, 7) AS jaccard"
_add(
    "D2_overlap_table",
    f"""SELECT * FROM (
SELECT kind AS comparison_type, dataset, week AS week_from, week AS week_to, model, budget, a AS protocol, b AS reference_protocol, {_PAIR}
FROM (
  SELECT kind, dataset, week, model, budget, a, b, id_student, bool_or(protocol = a) AS l, bool_or(protocol = b) AS r
  FROM sel JOIN (VALUES ('protocol', 'activity_conditioned', 'cutoff_valid'), ('protocol', 'static_full', 'cutoff_valid'), ('protocol', 'activity_to_cutoff_valid', 'cutoff_valid'), ('protocol', 'cutoff_valid_to_activity', 'cutoff_valid'),
    ('evaluation_population', 'activity_conditioned', 'activity_to_cutoff_valid'), ('evaluation_population', 'cutoff_valid', 'cutoff_valid_to_activity')) v(kind, a, b) ON protocol IN (a, b) GROUP BY ALL)
GROUP BY ALL HAVING bool_or(l) AND (kind = 'protocol' OR bool_or(r))
UNION ALL
SELECT 'time', dataset, f, t, model, budget, protocol, protocol, {_PAIR}
FROM (
  SELECT dataset, f, t, model, budget, protocol, id_student, bool_or(week = f) AS l, bool_or(week = t) AS r
  FROM sel JOIN (SELECT dataset, model, budget, protocol, week AS f, lead(week) OVER (PARTITION BY dataset, model, budget, protocol ORDER BY week) AS t FROM (SELECT DISTINCT dataset, model, budget, protocol, week FROM sel)) USING (dataset, model, budget, protocol)
  WHERE week = f OR week = t GROUP BY ALL)
WHERE t IS NOT NULL GROUP BY ALL)""",
    _PRED, _SELECT,
)
_add(
    "D3_ranking_stability",
    """SELECT dataset, week, protocol, metric, CASE WHEN stddev_pop(ra) * stddev_pop(rb) > 0 THEN round(covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)), 7) + 0.0 END AS spearman_rank_correlation, first(model ORDER BY vb, model) AS best_reference, first(model ORDER BY va, model) AS best_protocol,
  'cutoff_valid' AS reference_protocol, first(model ORDER BY vb, model) <> first(model ORDER BY va, model) AS ranking_reversal
FROM (
  SELECT *, rank() OVER (PARTITION BY week, protocol, metric ORDER BY va) + (count(*) OVER (PARTITION BY week, protocol, metric, va) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY week, protocol, metric ORDER BY vb) + (count(*) OVER (PARTITION BY week, protocol, metric, vb) - 1) / 2.0 AS rb
  FROM (SELECT a.*, a.v AS va, b.v AS vb FROM sgn a JOIN sgn b USING (dataset, week, model, metric) WHERE a.protocol <> 'cutoff_valid' AND b.protocol = 'cutoff_valid'))
GROUP BY dataset, week, protocol, metric HAVING count(*) >= 2""",
    _PRED, _metrics("pred", "dataset, week, protocol, model", "met"), _LONG, "sgn AS (SELECT *, CASE WHEN metric IN ('brier', 'ece') THEN value ELSE -value END AS v FROM lng)",
)
_add(
    "D4_metric_components",
    """SELECT week, model, metric, round(0.5 * (aa - ai + va - vi), 7) + 0.0 AS nonelig, round(0.5 * (ai - av + vi - vv), 7) + 0.0 AS silence, round(0.5 * (aa - av + va - vv), 7) + 0.0 AS evaluation
FROM (SELECT week, model, metric, """ + ", ".join(f"max(value) FILTER (a = '{x}') AS {x.lower()}" for x in ("AA", "AI", "AV", "VA", "VI", "VV")) + " FROM lng GROUP BY ALL)",
    _PRED, _COMP, _metrics("arms", "week, model, a", "met"), _LONG.replace("UNPIVOT met", "UNPIVOT INCLUDE NULLS met").replace("UNPIVOT INCLUDE NULLS met ON", "SELECT * FROM met UNPIVOT INCLUDE NULLS (value FOR metric IN (").replace(" INTO NAME metric VALUE value)", ")))"),
)
_add("D4_component_budget", "SELECT week, model, arm, budget, " + _r("coverage_adjusted_recall", "actionable_precision", "wasted_budget_rate", "candidate_coverage") + " FROM cb", _PRED, _COMP, _GAIN)
_add("D4_recall_gains", f"SELECT week, model, budget, {_r('eligibility', 'silence', 'total')} FROM gains", _PRED, _COMP, _GAIN)
_add(
    "A27_gain_summary",
    """SELECT gain, round(median(v), 7) + 0.0 AS median, count_if(v > 0)::BIGINT AS positive, count_if(v < 0)::BIGINT AS negative, count_if(v = 0)::BIGINT AS zero
FROM (SELECT 'eligibility' AS gain, eligibility AS v FROM gains UNION ALL SELECT 'silence', silence FROM gains UNION ALL SELECT 'total', total FROM gains) GROUP BY gain""",
    _PRED, _COMP, _GAIN,
)
_ATTR = """
attr AS (SELECT id_student, attribute, coalesce(g, 'nan') AS "group" FROM (SELECT id_student, unnest(['imd_band', 'disability', 'gender', 'age_band', 'highest_education', 'region']) AS attribute, unnest([imd_band, disability, gender, age_band, highest_education, region]) AS g FROM info))"""
_add(
    "A23_subgroup_coverage",
    """SELECT 'oulab' AS dataset, week, attribute, "group", protocol, count(*) AS n_reference, count_if(inc)::BIGINT AS n_included, round(count_if(inc) / count(*)::DOUBLE, 7) AS coverage, round(avg(risk), 7) AS reference_risk_rate, round(avg(risk) FILTER (inc), 7) AS included_risk_rate
FROM (SELECT m.*, attribute, "group", p.protocol, p.protocol <> 'activity_conditioned' OR has_activity AS inc FROM mem m JOIN attr USING (id_student) CROSS JOIN (VALUES ('activity_conditioned'), ('static_full'), ('cutoff_valid')) p(protocol) WHERE cutoff_valid AND attribute <> 'region')
GROUP BY week, attribute, "group", protocol""",
    _ATTR,
)
_add(
    "A23_subgroup_allocation",
    """SELECT dataset, week, model, protocol, budget, attribute, "group", count(*) AS n_reference, count_if(cand)::BIGINT AS n_candidates, coalesce(any_value(ns), 0)::BIGINT AS n_selected, count_if(picked)::BIGINT AS n_actionable_selected, round(count_if(cand) / count(*)::DOUBLE, 7) AS candidate_coverage, round(count_if(picked) / count(*)::DOUBLE, 7) AS selection_rate,
  CASE WHEN coalesce(any_value(ns), 0) > 0 THEN round(sum(CASE WHEN picked THEN risk ELSE 0 END) / any_value(ns)::DOUBLE, 7) END AS actionable_precision, CASE WHEN sum(risk) > 0 THEN round(sum(CASE WHEN picked THEN risk ELSE 0 END) / sum(risk)::DOUBLE, 7) END AS coverage_adjusted_risk_recall,
  CASE WHEN coalesce(any_value(ns), 0) > 0 THEN round((any_value(ns) - count_if(picked)) / any_value(ns)::DOUBLE, 7) END AS wasted_budget_rate
FROM (
  SELECT c.*, m.id_student, m.risk, attribute, "group", ns, EXISTS (SELECT 1 FROM s2 s WHERE s.model = c.model AND s.protocol = c.protocol AND s.budget = c.budget AND s.id_student = m.id_student) AS picked,
    EXISTS (SELECT 1 FROM pred p WHERE p.week = 16 AND p.model = c.model AND p.protocol = c.protocol AND p.id_student = m.id_student) AS cand
  FROM (SELECT DISTINCT dataset, week, model, protocol, budget FROM s2) c JOIN mem m ON m.week = 16 AND m.cutoff_valid JOIN attr a ON a.id_student = m.id_student AND attribute <> 'region'
  LEFT JOIN (SELECT model, protocol, budget, attribute, "group", count(*) AS ns FROM s2 JOIN attr USING (id_student) GROUP BY ALL) t USING (model, protocol, budget, attribute, "group"))
GROUP BY dataset, week, model, protocol, budget, attribute, "group\"""",
    _PRED, _SELECT, _ATTR, "s2 AS (SELECT * FROM sel WHERE week = 16 AND budget IN (0.05::DOUBLE, 0.2::DOUBLE))",
)
_add(
    "A24_excluded_categorical",
    """SELECT 'oulab' AS dataset, week, attribute, "group", membership_class AS observability, count(*) AS n, round(avg(risk), 7) AS risk_rate, round(count(*) / (sum(count(*)) OVER (PARTITION BY week, attribute, membership_class))::DOUBLE, 7) AS share FROM mem JOIN attr USING (id_student) WHERE cutoff_valid GROUP BY week, attribute, "group", membership_class""",
    _ATTR,
)
_add(
    "A24_excluded_numeric",
    """SELECT dataset, week, attribute, active_n, silent_n, round(am, 7) AS active_mean, round(sm, 7) AS silent_mean, CASE WHEN pooled > 0 THEN round((sm - am) / pooled, 7) + 0.0 END AS standardized_mean_difference
FROM (
  SELECT 'oulab' AS dataset, week, attribute, count(v) FILTER (has_activity) AS active_n, count(v) FILTER (NOT has_activity) AS silent_n, avg(v) FILTER (has_activity) AS am, avg(v) FILTER (NOT has_activity) AS sm,
    sqrt((greatest(count(v) FILTER (has_activity) - 1, 0) * var_samp(v) FILTER (has_activity) + greatest(count(v) FILTER (NOT has_activity) - 1, 0) * var_samp(v) FILTER (NOT has_activity)) / greatest(count(v) - 2, 1)) AS pooled
  FROM (SELECT week, has_activity, unnest(['num_of_prev_attempts', 'studied_credits', 'date_registration']) AS attribute, unnest([num_of_prev_attempts::DOUBLE, studied_credits::DOUBLE, m.date_registration::DOUBLE]) AS v FROM mem m JOIN info USING (id_student) WHERE cutoff_valid)
  GROUP BY week, attribute)""",
)
_add(
    "H1_hazard_frame",
    f"SELECT {K}, week AS landmark_week, coalesce(date_unregistration >= 7 * week AND date_unregistration < 7 * week + 7, false)::INT AS hazard_event, code_module || '::' || code_presentation AS split_group, code_module || '::' || code_presentation AS cluster_id FROM mem WHERE cutoff_valid",
)
_add(
    "H3_hazard_summary", f"SELECT week, model, n, {_r(*METRICS)} FROM met",
    "hz AS (SELECT week, 'm1' AS model, 1 - e AS y, 1 - ((id_student * 7919 + week * 31) % 700 + 300 * e) / 1000.0::DOUBLE AS p_success FROM (SELECT *, coalesce(date_unregistration >= 7 * week AND date_unregistration < 7 * week + 7, false)::INT AS e FROM mem WHERE cutoff_valid))",
    _metrics("hz", "week, model", "met"),
)
_CHAIN = """
row1 AS (SELECT *, 1 - exp(-(ln(1 + k) + 0.35 * d) / 3) AS e, 0.55 * (1 - exp(-(k / 12 + d / 3))) AS ec, 1 - exp(-n) AS ac FROM (
  SELECT id_student, code_module, code_presentation, week_index, coalesce(clicks_total, 0)::DOUBLE AS k, coalesce(active_days, 0)::DOUBLE AS d, coalesce(assess_attempts, 0)::DOUBLE AS n, least(coalesce(assess_score_mean, 0), 1) AS score FROM panel WHERE week_index <= 8)),
row2 AS (SELECT id_student, code_module, code_presentation, week_index, least(ec + ac, 1) AS c, e, CASE WHEN ac > 0 THEN score ELSE 0.5 END AS a, ln(1 + k) + n AS v, CASE WHEN least(ec + ac, 1) > 0 THEN (ec * e + ac * score) / least(ec + ac, 1) ELSE 0.5 END AS m FROM row1),
grid0 AS (SELECT g.*, coalesce(m, 0.5) AS m, coalesce(c, 0) AS c, coalesce(e, 0) AS e, coalesce(a, 0.5) AS a, coalesce(v, 0) AS v FROM (SELECT DISTINCT id_student, code_module, code_presentation, t.week_index FROM row2, range(1, 9) t(week_index)) g LEFT JOIN row2 USING (id_student, code_module, code_presentation, week_index)),
grid1 AS (SELECT * REPLACE (CASE WHEN pc IS NULL THEN m ELSE (1 - 0.25 * pc) * m + 0.25 * pc * pm END AS m, greatest(c, coalesce(0.7 * pc, 0)) AS c) FROM (SELECT *, lag(m) OVER o AS pm, lag(c) OVER o AS pc FROM grid0 WINDOW o AS (PARTITION BY id_student ORDER BY week_index))),
grid2 AS (SELECT * REPLACE (CASE WHEN pc IS NULL THEN m ELSE (1 - 0.25 * pc) * m + 0.25 * pc * pm END AS m, greatest(c, coalesce(0.7 * pc, 0)) AS c) FROM (SELECT * EXCLUDE (pm, pc), lag(m) OVER o AS pm, lag(c) OVER o AS pc FROM grid1 WINDOW o AS (PARTITION BY id_student ORDER BY week_index)))"""


def _chain(grid: str, uncertainty: bool) -> str:
    unsure = "round(avg(1 - c), 7) + 0.0 AS pcgut_uncertainty_mean, round(max(1 - c), 7) + 0.0 AS pcgut_uncertainty_max, " if uncertainty else ""
    return f"""SELECT {K}, 8 AS snapshot_week, round(avg(m), 7) AS pcgut_mastery_mean, round(stddev_pop(m), 7) AS pcgut_mastery_std, round(avg(c), 7) AS pcgut_confidence_mean, {unsure}max(CASE WHEN m >= 0.55 AND c > 0.05 THEN week_index ELSE 0 END)::INT AS pcgut_frontier,
  round(avg(CASE WHEN m >= 0.55 AND c > 0.05 THEN 1.0::DOUBLE ELSE 0 END), 7) AS pcgut_mastered_ratio, round(avg(CASE WHEN pm2 IS NOT NULL THEN greatest(m - pm2, 0) * c END), 7) AS pcgut_prerequisite_gap, round(avg(abs(m - pm2)), 7) AS pcgut_smoothness, round(avg(e), 7) AS pcgut_engagement_mean, round(avg(a), 7) AS pcgut_assessment_mean,
  round(sum(v), 7) AS pcgut_evidence_volume, round(max(c) FILTER (week_index = 8), 7) AS pcgut_recent_confidence, round(max(m) FILTER (week_index = 8), 7) AS pcgut_recent_mastery
FROM (SELECT *, lag(m) OVER (PARTITION BY id_student ORDER BY week_index) AS pm2 FROM {grid}) GROUP BY {K}"""


_add("R1_chain_features", _chain("grid2", True), _PANEL, _CHAIN)
_add("R1_chain_none", _chain("grid0", False), _PANEL, _CHAIN)

def _weekly_differences(days_later: int) -> str:
    again = f"SELECT {K}, ((date + {days_later}) // 7 + 1)::INT AS week_index, sum(sum_click)::DOUBLE AS actual_clicks, count(DISTINCT date)::DOUBLE AS actual_days, true AS in_actual FROM vle WHERE date >= 0 GROUP BY ALL"
    return f"""SELECT * FROM (SELECT {K}, week_index, clicks_total::DOUBLE AS expected_clicks, active_days::DOUBLE AS expected_days, true AS in_expected FROM vlew) FULL JOIN ({again}) USING ({K}, week_index)
WHERE expected_clicks IS DISTINCT FROM actual_clicks OR expected_days IS DISTINCT FROM actual_days"""


_add("V1_validate_weekly", _weekly_differences(0), _PANEL)
_add("V1_weeks_a_day_late", _weekly_differences(1), _PANEL)
_add(
    "U4_equal_sets",
    f"""SELECT {K}, CASE WHEN bool_or(v) THEN 'left' ELSE 'right' END AS side
FROM (SELECT {K}, clicks_total IS NOT NULL AS v, assess_attempts IS NOT NULL AS a FROM panel) GROUP BY {K} HAVING bool_or(v) <> bool_or(a)""",
    _PANEL,
)

# The bootstrap with few draws: each slot of a draw takes the cluster that a hash of seed, draw and slot chooses.
_SCORES = "auc, pr_auc_risk, brier, ece"


def _draws(n: int, seed: int = 42) -> str:
    return f"""
named AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 AS nth FROM (SELECT DISTINCT cluster_id FROM pred)),
drawn AS (
  SELECT draw, cluster_id, count(*) AS w
  FROM (SELECT draw, ('0x' || substr(md5(concat_ws(':', {seed}, draw, nth)), 1, 13))::BIGINT % (SELECT count(*) FROM named) AS nth FROM range({n}) d(draw), named)
  JOIN named USING (nth) GROUP BY ALL)"""


def _drawn_metrics(source: str, name: str) -> str:
    """CTEs that give `name` the metrics of source by dataset, week, model, protocol and draw."""
    k, cell = "cell, draw", "dataset, week, model, protocol"
    bins = "len(list_filter(" + str(EDGES) + ", lambda e: e <= p))"
    return f"""
{name}_k AS (SELECT *, (row_number() OVER ())::INTEGER AS cell FROM (SELECT DISTINCT {cell} FROM {source})),
{name}_c AS (
  SELECT {k}, p, sum(s * w)::INTEGER AS s, sum(f * w)::INTEGER AS f
  FROM (SELECT cell, cluster_id, p_success AS p, sum(y)::INTEGER AS s, sum(1 - y)::INTEGER AS f FROM {source} JOIN {name}_k USING ({cell}) GROUP BY ALL) JOIN (SELECT draw::INTEGER AS draw, cluster_id, w::INTEGER AS w FROM drawn) USING (cluster_id) GROUP BY ALL),
{name}_r AS (
  SELECT *, sum(f) OVER (PARTITION BY {k} ORDER BY p ROWS UNBOUNDED PRECEDING) - f AS below, sum(f) OVER (PARTITION BY {k} ORDER BY 1 - p DESC) AS caught, sum(s + f) OVER (PARTITION BY {k} ORDER BY 1 - p DESC) AS flagged
  FROM {name}_c),
{name}_b AS (SELECT {k}, sum(off) AS off FROM (SELECT {k}, {bins} AS bin, abs(sum(s - (s + f) * p)) AS off FROM {name}_c GROUP BY ALL) GROUP BY ALL),
{name}_m AS (
  SELECT {k}, CASE WHEN sum(s) > 0 AND sum(f) > 0 THEN sum(s * (below + f / 2)) / (sum(s)::DOUBLE * sum(f)) END AS auc, CASE WHEN sum(s) > 0 AND sum(f) > 0 THEN sum(f * caught / flagged) / sum(f) END AS pr_auc_risk,
    CASE WHEN sum(s) > 0 AND sum(f) > 0 THEN sum(s * (1 - p) * (1 - p) + f * p * p) / sum(s + f) END AS brier, CASE WHEN sum(s) > 0 AND sum(f) > 0 THEN any_value(off) / sum(s + f) END AS ece
  FROM {name}_r JOIN {name}_b USING ({k}) GROUP BY {k}),
{name} AS (SELECT * EXCLUDE (cell) FROM (SELECT * FROM {name}_m JOIN {name}_k USING (cell)) UNPIVOT INCLUDE NULLS (value FOR metric IN ({_SCORES})))"""


def _contrasts(source: str, keys: str, name: str) -> str:
    each = " UNION ALL ".join(f"SELECT {keys}, metric, '{c}' AS contrast, " + " + ".join(f"{w} * {cell}" for cell, w in zip(CELLS, ws) if w) + f" AS value FROM {name}_w" for c, ws in CONTRASTS.items())
    there = ", ".join(f"max(value) FILTER (protocol = '{c}') AS {c}" for c in CELLS)
    listed = ", ".join(f"'{c}'" for c in CELLS)
    return f"""
{name}_w AS (SELECT {keys}, metric, {there} FROM {source} WHERE protocol IN ({listed}) GROUP BY {keys}, metric HAVING count(DISTINCT protocol) = 4),
{name} AS ({each})"""


def _n(*names: str) -> str:
    """As _r, rounded to twelve digits first."""
    return ", ".join(f"round(round({n}, 12), 7) + 0.0 AS {n}" for n in names)


_CI = "quantile_cont(value, 0.025) AS ci_low, quantile_cont(value, 0.975) AS ci_high"
_POINT = [_metrics("pred", "dataset, week, model, protocol", "met"), "pnt AS (SELECT * FROM met UNPIVOT INCLUDE NULLS (value FOR metric IN (" + _SCORES + ")))"]
_CELL = "dataset, week, model"
_PLAIN = _contrasts("pnt", _CELL, "pc")
_DREW = _contrasts("drm", f"{_CELL}, draw", "dc")


def _sided() -> str:
    out = []
    for side, sign in (("left_protocol", 1), ("right_protocol", -1)):
        single = {c: [cell for cell, w in zip(CELLS, ws) if w * sign > 0] for c, ws in CONTRASTS.items()}
        out.append("CASE contrast " + " ".join(f"WHEN '{c}' THEN '{own[0]}'" for c, own in single.items() if len(own) == 1) + f" ELSE 'combination' END AS {side}")
    return ", ".join(out)


def _term(contrast: str) -> str:
    return f"max(CASE WHEN contrast = '{contrast}' THEN value END) OVER (PARTITION BY dataset, week, model, metric)"


_DECOMPOSED = f"""
dec AS (
  SELECT dataset, week, model, metric, contrast, value AS delta, ci_low, ci_high, {_term('joint_population_difference')} - {_term('evaluation_population_shapley')} - {_term('training_population_shapley')} AS identity_residual, {_sided()}
  FROM pc LEFT JOIN (SELECT dataset, week, model, metric, contrast, {_CI} FROM dc GROUP BY ALL) USING (dataset, week, model, metric, contrast))"""
_DEC = f"SELECT dataset, week, model, metric, contrast, {_n('delta', 'ci_low', 'ci_high', 'identity_residual')}, left_protocol, right_protocol FROM dec"
_MODULES = _PRED.replace("code_module || '::' || code_presentation AS cluster_id", "code_module AS cluster_id")


def _sizes(source: str, keys: str) -> str:
    """source and the difference of the two components' absolute values."""
    term = lambda c: f"max(abs(value)) FILTER (contrast = '{c}')"
    return f"(SELECT * FROM {source} UNION ALL BY NAME SELECT {keys}, 'absolute_evaluation_minus_absolute_training' AS contrast, {term('evaluation_population_shapley')} - {term('training_population_shapley')} AS value FROM {source} GROUP BY {keys})"


def _bootstraps(n: int, suffix: str) -> None:
    spread = [_PRED, *_POINT, _draws(n), _drawn_metrics("pred", "drm")]
    _add(
        f"B4_bootstrap_summary{suffix}",
        f"""SELECT dataset, week, protocol, model, metric, {_n('point')}, n, n_clusters, 'presentation' AS cluster_unit, {_n('ci_low', 'ci_high')}
    FROM (SELECT dataset, week, model, protocol, metric, value AS point FROM pnt) JOIN (SELECT dataset, week, model, protocol, count(*) AS n, count(DISTINCT cluster_id) AS n_clusters FROM pred GROUP BY ALL) USING (dataset, week, model, protocol)
    LEFT JOIN (SELECT dataset, week, model, protocol, metric, {_CI} FROM drm GROUP BY ALL) USING (dataset, week, model, protocol, metric)""",
        *spread,
    )
    _add(
        f"B5_bootstrap_distortion{suffix}",
        f"""SELECT dataset, week, model, protocol, metric, {_n('delta', 'ci_low', 'ci_high')}, 'cutoff_valid' AS reference_protocol
    FROM (SELECT p.dataset, p.week, p.model, p.protocol, p.metric, p.value - r.value AS delta FROM pnt p JOIN pnt r USING (dataset, week, model, metric) WHERE p.protocol <> 'cutoff_valid' AND r.protocol = 'cutoff_valid')
    LEFT JOIN (SELECT dataset, week, model, protocol, metric, {_CI} FROM (SELECT p.dataset, p.week, p.model, p.protocol, p.metric, p.value - r.value AS value FROM drm p JOIN drm r USING (dataset, week, model, metric, draw) WHERE p.protocol <> 'cutoff_valid' AND r.protocol = 'cutoff_valid') GROUP BY ALL)
      USING (dataset, week, model, protocol, metric)""",
        *spread,
    )
    _add(f"B6_decomposition{suffix}", _DEC, *spread, _PLAIN, _DREW, _DECOMPOSED)
    _add(f"B7_module_clusters{suffix}", _DEC, _MODULES, *_POINT, _draws(n), _drawn_metrics("pred", "drm"), _PLAIN, _DREW, _DECOMPOSED)
    _add(f"A26_exclusion_counts{suffix}", f"SELECT metric, contrast, count(*) AS cells, count_if(ci_low > 0 OR ci_high < 0)::BIGINT AS excluding_zero, {_n('median_delta', 'mean_delta')} FROM (SELECT *, median(delta) OVER g AS median_delta, avg(delta) OVER g AS mean_delta FROM dec WINDOW g AS (PARTITION BY metric, contrast)) GROUP BY metric, contrast, median_delta, mean_delta", *spread, _PLAIN, _DREW, _DECOMPOSED)
    _add(
        f"B8_aggregate{suffix}",
        f"""SELECT metric, contrast, {_n('point_mean', 'bootstrap_mean', 'ci_low', 'ci_high')}, finite_draws, (SELECT count(*) FROM (SELECT DISTINCT dataset, week, model FROM pc)) AS cells
    FROM (SELECT metric, contrast, value AS point_mean FROM {_sizes('pm', 'metric')})
    JOIN (SELECT metric, contrast, avg(value) AS bootstrap_mean, {_CI}, count(value) AS finite_draws FROM {_sizes('dm', 'draw, metric')} GROUP BY ALL) USING (metric, contrast)""",
        *spread, _PLAIN, _DREW, "pm AS (SELECT metric, contrast, avg(value) AS value FROM pc GROUP BY ALL)",
        "dm AS (SELECT draw, metric, contrast, CASE WHEN count(value) = (SELECT count(*) FROM (SELECT DISTINCT dataset, week, model FROM pc)) THEN avg(value) END AS value FROM dc GROUP BY ALL)",
    )
    _add(
        f"B9_paired_difference{suffix}",
        f"""SELECT metric, contrast, {_n('bootstrap_mean', 'ci_low', 'ci_high')}, finite_draws
    FROM (SELECT metric, contrast, avg(value) AS bootstrap_mean, {_CI}, count(value) AS finite_draws FROM (
      SELECT metric, contrast, a.value - b.value AS value FROM (SELECT draw, metric, contrast, avg(value) AS value FROM ec GROUP BY ALL) a JOIN (SELECT draw, metric, contrast, avg(value) AS value FROM dc GROUP BY ALL) b USING (draw, metric, contrast)) GROUP BY ALL)""",
        _PRED, _draws(n), _drawn_metrics("pred", "drm"), _DREW, _PRED.replace("pred AS", "pred2 AS").replace("7919", "6421"), _drawn_metrics("pred2", "erm"), _contrasts("erm", f"{_CELL}, draw", "ec"),
    )


_bootstraps(1000, "")
_bootstraps(20, "_20_draws")

_add(
    "B11_precision_by_rows", f"SELECT dataset, week, model, protocol, draw, {_n('pr_auc_risk')} FROM (SELECT dataset, week, model, protocol, draw, value AS pr_auc_risk FROM drm WHERE metric = 'pr_auc_risk')",
    _PRED, _draws(1000).replace("drawn AS", "all_drawn AS") + ",\ndrawn AS (SELECT * FROM all_drawn WHERE draw IN (0, 500, 999))", _drawn_metrics("pred", "drm"),
)
_add("B11_cross_check", "SELECT dataset, week, protocol, model, 0 AS draw, 0.0::DOUBLE AS first, 0.0::DOUBLE AS second, 0.0::DOUBLE AS difference FROM pred WHERE false", _PRED)
_add("O4_first_occurrence", "SELECT code_module, in_debt, row_number() OVER (ORDER BY min(k)) - 1 AS nth FROM (SELECT row_number() OVER () AS k, c_mktsegment AS code_module, c_acctbal < 0 AS in_debt FROM customer) GROUP BY code_module, in_debt")
_add("O7_first_labels", "SELECT o_custkey AS id_student, o_orderkey, (o_orderstatus = 'F')::INT AS label FROM (SELECT row_number() OVER () AS k, * FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY k) = 1")
_add(
    "V1_landmark_audit",
    f"""SELECT week, 7 * week AS cutoff_day, (SELECT count(*) FROM sub WHERE day < 7 * week) AS admissible_submissions,
  (SELECT count(*) FROM (SELECT {K} FROM sub WHERE day < 7 * week UNION SELECT {K} FROM vle WHERE date >= 0 AND date < 7 * week)) AS activity_enrolments,
  (SELECT coalesce(sum(sum_click), 0)::BIGINT FROM vle WHERE date >= 0 AND date < 7 * week) AS vle_clicks
FROM (SELECT unnest([{', '.join(map(str, WEEKS))}])::INT AS week)""",
    _PANEL,
)
_add("J2_incomplete_joins", "SELECT DISTINCT l_partkey AS id_site, 0::BIGINT AS matches FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_partkey % 17 = 0")

_FOLDS = f"""WITH RECURSIVE {_BASE},
grp AS (SELECT code_module || '::' || code_presentation AS split_group, count(*) FILTER (label = 0) AS bad, count(*) FILTER (label = 1) AS good FROM roster GROUP BY ALL),
tot AS (SELECT greatest(sum(bad), 1)::DOUBLE AS b, greatest(sum(good), 1)::DOUBLE AS g FROM grp),
shp AS (SELECT repeat, bad, good, count(*) AS m, row_number() OVER (PARTITION BY repeat ORDER BY abs(bad - good) DESC, md5(concat_ws(':', 41 + repeat, bad, good))) AS o FROM grp, (SELECT unnest(range(1, 6)) AS repeat) GROUP BY repeat, bad, good),
stp AS (SELECT repeat, bad, good, i, row_number() OVER (PARTITION BY repeat ORDER BY o, i) AS k FROM (SELECT *, unnest(range(m % 5)) AS i FROM shp)),
walk AS (
  SELECT repeat, 0::BIGINT AS k, [0::DOUBLE, 0, 0, 0, 0] AS hb, [0::DOUBLE, 0, 0, 0, 0] AS hg, 0 AS fold FROM (SELECT DISTINCT repeat FROM shp)
  UNION ALL
  SELECT repeat, k, [hb[f] + CASE WHEN f = best THEN bad ELSE 0 END FOR f IN [1, 2, 3, 4, 5]], [hg[f] + CASE WHEN f = best THEN good ELSE 0 END FOR f IN [1, 2, 3, 4, 5]], best
  FROM (
    SELECT w.repeat, s.k, hb, hg, bad, good, list_sort([
      {{'s': round((list_aggregate([(hb[x] + CASE WHEN x = f THEN bad ELSE 0 END) / b FOR x IN [1, 2, 3, 4, 5]], 'stddev_pop') + list_aggregate([(hg[x] + CASE WHEN x = f THEN good ELSE 0 END) / g FOR x IN [1, 2, 3, 4, 5]], 'stddev_pop')) / 2, 12),
        't': hb[f] + hg[f], 'f': f}} FOR f IN [1, 2, 3, 4, 5]])[1].f AS best
    FROM walk w JOIN stp s ON w.repeat = s.repeat AND s.k = w.k + 1, tot)),
ranked AS (SELECT repeat, split_group, bad, good, row_number() OVER (PARTITION BY repeat, bad, good ORDER BY md5(concat_ws(':', 41 + repeat, split_group)), split_group) - 1 AS i FROM grp, (SELECT unnest(range(1, 6)) AS repeat)),
maps AS (
  SELECT r.repeat, split_group, coalesce(w.fold, (r.i - m % 5) % 5 + 1)::INT AS fold
  FROM ranked r JOIN shp USING (repeat, bad, good) LEFT JOIN stp s ON s.repeat = r.repeat AND s.bad = r.bad AND s.good = r.good AND s.i = r.i LEFT JOIN walk w ON w.repeat = s.repeat AND w.k = s.k)
SELECT {K}, label, 'presentation' AS split_unit, split_group, repeat::INT AS repeat, fold FROM roster JOIN maps ON split_group = code_module || '::' || code_presentation"""
ORACLE_SQL["L8_folds"] = _FOLDS

# Learner states on the graph of weeks and modalities: a row per learner, week and modality.
_GRAPH = f"""
gw AS (SELECT {K}, week_index AS week, unnest(range(5)) AS lane, unnest([clicks_t0, clicks_t1, clicks_t2, clicks_t3, clicks_t4]) AS k, coalesce(assess_attempts, 0) AS n, coalesce(assess_score_mean, 0) AS score FROM panel WHERE week_index <= 8),
gg AS (
  SELECT g.*, coalesce(gw.k, 0)::DOUBLE AS k, coalesce(n, 0)::DOUBLE AS n, CASE WHEN gw.id_student IS NULL THEN 0.5::DOUBLE ELSE least(greatest(score, 0), 1) END AS wm
  FROM (SELECT DISTINCT {K}, t.week, l.lane FROM gw, range(1, 9) t(week), range(5) l(lane)) g LEFT JOIN gw USING ({K}, week, lane)),
p0 AS (SELECT {K}, week, lane, k, wm, 1 - exp(-n) AS wc, 1 - exp(-n) AS fwc, 1 - exp(-ln(1 + k) / 3) AS m, 0.55 * (1 - exp(-k / 12)) AS c FROM gg)"""


def _pass(before: str, name: str) -> str:
    """CTEs that give `name`: weeks move their modalities, then the week takes from them and gives back."""
    return f"""
{name}_t AS (
  SELECT * REPLACE (CASE WHEN pc IS NULL THEN m ELSE (1 - 0.25 * pc) * m + 0.25 * pc * pm END AS m, greatest(c, coalesce(0.7 * pc, 0)) AS c)
  FROM (SELECT *, lag(m) OVER o AS pm, lag(c) OVER o AS pc FROM {before} WINDOW o AS (PARTITION BY id_student, lane ORDER BY week))),
{name}_w AS (SELECT *, max(c) OVER w AS own, sum(c) OVER w AS sc, sum(m * c) OVER w AS smc FROM {name}_t WINDOW w AS (PARTITION BY id_student, week)),
{name}_s AS (SELECT * REPLACE (CASE WHEN wc + own > 1e-9 THEN (wc * wm + own * CASE WHEN sc > 1e-9 THEN smc / sc ELSE 0.5 END) / greatest(wc + own, 1e-9) ELSE wm END AS wm, greatest(wc, 0.7 * own) AS wc) FROM {name}_w),
{name} AS (SELECT {K}, week, lane, k, wm, wc, fwc, (1 - 0.15 * wc) * m + 0.15 * wc * wm AS m, c FROM {name}_s)"""


def _states(source: str, residual: bool) -> str:
    """Summaries of the states in source."""
    lanes = ["mastery_mean", "mastery_std", "confidence_mean", "evidence_volume", "recent_mastery", "recent_confidence", "uncertainty_mean", "uncertainty_max", "parent_child_gap"]
    weeks, mixed = ["week_mastery_mean", "mastered_ratio", "prerequisite_gap", "smoothness", "modality_std"], ["breadth", "modality_entropy"]
    extra = ["res_t_mean", "res_t_absmean", "res_t_negative", "res_h_absmean", "res_h_std", "res_h_max", "res_h_min"] if residual else []
    more = """, sum((m - pm) * pc) / greatest(sum(pc), 1e-9) AS res_t_mean, sum(abs(m - pm) * pc) / greatest(sum(pc), 1e-9) AS res_t_absmean, sum(least(m - pm, 0) * pc) / greatest(sum(pc), 1e-9) AS res_t_negative,
    avg(abs(m - pool)) AS res_h_absmean, stddev_pop(m - pool) AS res_h_std, max(m - pool) AS res_h_max, min(m - pool) AS res_h_min""" if residual else ""  # fmt: skip
    return f"""SELECT {K}, 8 AS snapshot_week, frontier::INT AS pcgg_frontier, {', '.join(f'round({c}, 7) + 0.0 AS pcgg_{c}' for c in [*lanes, *weeks, *mixed, *extra])}
FROM (
  SELECT {K}, avg(m) AS mastery_mean, stddev_pop(m) AS mastery_std, avg(c) AS confidence_mean, sum(ln(1 + k)) AS evidence_volume, avg(m) FILTER (week = 8) AS recent_mastery, avg(c) FILTER (week = 8) AS recent_confidence,
    1 - avg(c) AS uncertainty_mean, 1 - min(c) AS uncertainty_max, avg(abs(wm - m)) AS parent_child_gap{more}
  FROM (SELECT *, lag(m) OVER o AS pm, lag(c) OVER o AS pc, CASE WHEN sum(c) OVER w > 1e-9 THEN sum(m * c) OVER w / sum(c) OVER w ELSE 0.5 END AS pool FROM {source} WINDOW o AS (PARTITION BY id_student, lane ORDER BY week), w AS (PARTITION BY id_student, week)) GROUP BY {K})
JOIN (
  SELECT id_student, avg(wm) AS week_mastery_mean, avg(known::INT) AS mastered_ratio, max(CASE WHEN known THEN week ELSE 0 END) AS frontier, avg(CASE WHEN pwm IS NOT NULL THEN greatest(wm - pwm, 0) * fwc END) AS prerequisite_gap, avg(abs(wm - pwm)) AS smoothness, avg(spread) AS modality_std
  FROM (SELECT *, lag(wm) OVER (PARTITION BY id_student ORDER BY week) AS pwm, wm >= 0.55 AND fwc > 0.05 AS known FROM (SELECT id_student, week, any_value(wm) AS wm, any_value(fwc) AS fwc, stddev_pop(m) AS spread FROM {source} GROUP BY ALL)) GROUP BY ALL) USING (id_student)
JOIN (
  SELECT id_student, avg(seen::INT) AS breadth, -sum(share * ln(greatest(share, 1e-12))) / ln(5::DOUBLE) AS modality_entropy
  FROM (SELECT id_student, seen, clicks / greatest(sum(clicks) OVER (PARTITION BY id_student), 1e-9) AS share FROM (SELECT id_student, lane, max(c) > 0.05 AS seen, sum(k) AS clicks FROM {source} GROUP BY ALL)) GROUP BY ALL) USING (id_student)"""


_add("R2_graph_features", _states("p2", False), _PANEL, _GRAPH, _pass("p0", "p1"), _pass("p1", "p2"))
_add("R2_graph_residual", _states("p0", True), _PANEL, _GRAPH)

_SCORED_WEEKS = ", ".join(f"round(coalesce(max(coalesce({c}, 0)::DOUBLE) FILTER (week_index = {w}), 0), 7) + 0.0 AS {c}_week{w}" for c in _NUM[7:] for w in range(1, 9))
_ORDER = "trav_reach, trav_position_mean, trav_position_std, trav_backtrack_rate, trav_below_frontier_rate, trav_revisit_rate, trav_step_absmean, trav_forward_jump_mean, trav_order_agreement"


def _block(body: str, columns: str = f"* EXCLUDE ({K})") -> str:
    return f"LEFT JOIN (SELECT {K}, COLUMNS({columns})::DOUBLE FROM ({body})) USING ({K})"


_week8 = lambda name, columns="*": f"SELECT {columns} FROM ({_BODIES[name]}) WHERE snapshot_week = 8"
_add(
    "R6_stack_7_full",
    f"""SELECT {K}, snapshot_week, pcgg_frontier, coalesce(COLUMNS(* EXCLUDE ({K}, snapshot_week, pcgg_frontier)), 0)
FROM ({_BODIES['R2_graph_residual']})
LEFT JOIN (SELECT {K}, {_SCORED_WEEKS} FROM panel WHERE week_index <= 8 GROUP BY {K}) USING ({K})
{_block(_BODIES['P13_static_features'])}
{_block(_week8('A9_gap_features', '* EXCLUDE (snapshot_week)'))} {_block(_week8('A11_timing_features', '* EXCLUDE (snapshot_week)'))} {_block(_week8('A13_cohort_features', '* EXCLUDE (snapshot_week)'))}
{_block(_week8('A15_traversal_features', f'{K}, {_ORDER}'))}""",
    _PANEL, _GRAPH, _TIMING, _TRAV, _COHORT,
)
assert WEEKS == [2, 4, 6, 8, 10, 12, 14, 16]
