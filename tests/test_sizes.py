"""What plans hold and move: faults that only larger tables show."""

from __future__ import annotations

import re

from oracle import SMALL
from pyspark.sql import functions as F

from waymark.operators import bootstrap, decide
from waymark.plans import queries
from waymark.plans.queries import QUERIES
from waymark.sources import fixtures
from waymark.sources.fixtures import Binding


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def same_rows(a, b) -> bool:
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_precision_by_rows_never_broadcasts_the_panel(spark, monkeypatch):
    found = QUERIES["B11_precision_by_rows"](spark, SMALL)
    assert "BuildLeft" not in plan(found).split("Window")[1]
    rows = queries.scored(Binding(spark, SMALL))
    drawn = queries.draws(Binding(spark, SMALL), rows).where(F.col("draw").isin(0, 500, 999))
    monkeypatch.setattr(bootstrap, "HELD", 0)
    many = bootstrap.row_weighted_precision(rows, drawn, ["dataset", "week", "protocol", "model"])
    assert "SortMergeJoin" in plan(many)
    assert same_rows(queries.rounded(many, steady=True), found)


def test_weekly_evidence_of_large_tables_is_dealt_to_more_tasks(spark, monkeypatch):
    for name in ("A1_vle_weekly", "A3_assess_weekly"):
        plain = QUERIES[name](spark, SMALL)
        with monkeypatch.context() as m:
            m.setattr(fixtures, "LINES", 200)
            dealt = QUERIES[name](spark, SMALL)
        parts = -(-Binding(spark, SMALL).read("lineitem").count() // 200)
        assert "o_custkey#" in plan(dealt) and f", {parts})" in plan(dealt)
        assert same_rows(plain, dealt)


def test_submissions_are_not_dealt_by_assessment(spark):
    assert "hashpartitioning(id_assessment" not in plan(QUERIES["A3_assess_weekly"](spark, SMALL))
    timing = QUERIES["A11_timing_features"](spark, SMALL)
    assert "hashpartitioning(id_assessment" not in plan(timing)


def test_audit_leaves_later_days_in_the_scans(spark):
    found = plan(QUERIES["V1_landmark_audit"](spark, SMALL))
    assert found.count("< 112)") >= 3 and "hashpartitioning(id_assessment" not in found


def test_enrolments_are_dealt_before_landmarks_multiply_them(spark, monkeypatch):
    plain = QUERIES["A21_average_repeats"](spark, SMALL)
    with monkeypatch.context() as m:
        m.setattr(queries, "ENROLMENTS", 10)
        dealt = QUERIES["A21_average_repeats"](spark, SMALL)
    assert "REPARTITION_BY_NUM" in plan(dealt)
    assert same_rows(plain, dealt)


def test_selections_are_the_same_however_they_are_dealt(spark, monkeypatch):
    rows = queries.predictions(Binding(spark, SMALL))
    plain = decide.budget_table(rows)[1]
    overlap = decide.overlap_table(plain)
    with monkeypatch.context() as m:
        m.setattr(decide, "ROWS", 1000)
        m.setattr(decide, "HELD", 0)
        dealt = decide.selections(rows)
        again = decide.overlap_table(dealt)
    assert same_rows(plain.select(sorted(plain.columns)), dealt.select(sorted(plain.columns)))
    assert same_rows(overlap.select(sorted(overlap.columns)), again.select(sorted(overlap.columns)))
    assert "REPARTITION_BY_NUM" in plan(again)


def by_enrolment(df) -> list[str]:
    """Broadcasts whose key is an enrolment, in the plan that ran: Spark chooses most of them only then."""
    df.collect()
    return re.findall(r"HashedRelationBroadcastMode\(List\(input\[\d+, bigint, \w+\], input\[\d+, string.*", plan(df))


def test_allocation_never_broadcasts_enrolments(spark):
    found = QUERIES["A23_subgroup_allocation_all"](spark, SMALL)
    assert not by_enrolment(found)
    assert "l_orderkey" not in plan(found)


def test_many_enrolments_are_never_broadcast(spark, monkeypatch):
    plain = QUERIES["P9_membership"](spark, SMALL)
    assert by_enrolment(plain)
    with monkeypatch.context() as m:
        m.setattr(queries, "ENROLMENTS", 10)
        m.setattr(fixtures, "CUSTOMERS", 10)
        m.setattr(fixtures, "LINES", 200)
        merged = QUERIES["P9_membership"](spark, SMALL)
        assert not by_enrolment(merged)
    assert same_rows(plain, merged)


def test_stack_takes_the_landmark_days_from_the_lines_once(spark, monkeypatch):
    read, name = [], QUERIES["R6_stack_7_full"]
    lines = Binding.lines
    monkeypatch.setattr(Binding, "lines", lambda b: read.append(b) or lines(b))
    plain = name(spark, SMALL)
    assert len(read) == 2
    assert "l_orderkey" not in plan(plain)
    monkeypatch.setattr(queries, "LEARNERS", 10)
    assert same_rows(plain, name(spark, SMALL))


def test_panel_is_dealt_before_its_columns_multiply(spark, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(queries, "LEARNERS", 10)
        dealt = QUERIES["A17_temporal_features"](spark, SMALL)
    assert "REPARTITION_BY_NUM" in plan(dealt)
    assert same_rows(QUERIES["A17_temporal_features"](spark, SMALL), dealt)
