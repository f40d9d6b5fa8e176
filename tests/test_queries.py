from __future__ import annotations

import pytest

from oracle import SMALL, assert_matches
from waymark.plans.oracle import ORACLE_SQL
from waymark.plans.queries import QUERIES

SLOW = {"L2_benchmark_logistic"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert_matches(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys() - SLOW))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_bootstraps_take_all_landmarks_and_draws(spark):
    from waymark.plans import queries
    from waymark.sources.fixtures import WEEKS

    assert queries.DRAWS == 1000
    assert {r["week"] for r in QUERIES["B5_bootstrap_distortion"](spark, SMALL).select("week").distinct().collect()} == set(WEEKS)
    assert QUERIES["B9_paired_difference"](spark, SMALL).agg({"finite_draws": "max"}).first()[0] == 1000
    assert {r["repeat"] for r in QUERIES["L8_folds"](spark, SMALL).select("repeat").distinct().collect()} == {1, 2, 3, 4, 5}
    every = QUERIES["A23_subgroup_allocation_all"](spark, SMALL)
    assert every.select("week").distinct().count() == len(WEEKS)


def test_entry_has_all(spark):
    import __spark_entry__ as entry

    assert QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).count() == 8


def test_logistic_benchmark_is_whole(spark):
    """All landmarks, logistic models, repeats and folds, and every enrolment once in each of them."""
    from waymark.operators.models import LOGISTIC
    from waymark.sources.fixtures import WEEKS

    rows = QUERIES["L2_benchmark_logistic"](spark, SMALL).where("protocol = 'static_full'").select("week", "model", "repeat", "fold", "id_student").toPandas()
    assert set(rows["week"]) == set(WEEKS) and set(rows["model"]) == set(LOGISTIC)
    assert set(rows["repeat"]) == {1, 2, 3, 4, 5} == set(rows["fold"])
    assert (rows.groupby(["week", "model", "repeat"])["id_student"].nunique() == rows["id_student"].nunique()).all() and not rows.duplicated().any()
