"""Publication of several tables at once, its undoing, and the validator with a planted fault per table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from oracle import SMALL
from waymark.operators import behaviour, checks, evidence
from waymark.plans.queries import TYPES, roster
from waymark.sources import publish as publishing
from waymark.sources.fixtures import Binding
from waymark.sources.publish import JOURNAL, MANIFEST, Store, publish, recover, verify

NAMES = ["a", "b", "c"]


def tables(spark, n):
    return {name: spark.createDataFrame([(n, name)], "n int, name string") for name in NAMES}


def held(spark, root):
    store = Store(spark, root)
    return {name: spark.read.parquet(f"{root}/{name}").first()["n"] for name in NAMES if store.exists(name)}


def test_replaces_all_and_keeps_a_backup(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    first = publish(spark, root, tables(spark, 1), lambda staged: {"rows": {k: df.count() for k, df in staged.items()}}, {"policy": "p"})
    assert verify(spark, root) == first and first["validation"] == {"rows": dict.fromkeys(NAMES, 1)}
    second = publish(spark, root, {"a": tables(spark, 2)["a"]}, lambda staged: None, {})
    assert verify(spark, root) == second and held(spark, root) == {"a": 2, "b": 1, "c": 1}
    assert spark.read.parquet(f"{root}/{second['backup']}/a").first()["n"] == 1
    assert not Store(spark, root).exists(f"_staging/{second['run']}")


def test_a_failed_validation_moves_nothing(spark, tmp_path):
    root = f"{tmp_path}/out"
    publish(spark, root, tables(spark, 1), lambda staged: None, {})

    def fail(staged):
        raise ValueError("wrong")

    with pytest.raises(ValueError, match="wrong"):
        publish(spark, root, tables(spark, 2), fail, {})
    assert held(spark, root) == dict.fromkeys(NAMES, 1) and verify(spark, root)


@pytest.mark.parametrize("old, at", [(True, 1), (True, 2), (True, 3), (True, 6), (True, 7), (False, 2), (False, 4)])
def test_a_failure_between_renames_is_undone(spark, tmp_path, monkeypatch, at, old):
    root = f"{tmp_path}/out"
    if old:
        publish(spark, root, tables(spark, 1), lambda staged: None, {})
    moves, move = [], Store.move

    def failing(self, source, target):
        if "_staging" in source or "_backups" in target or target == MANIFEST:
            moves.append(target)
            if len(moves) == at:
                raise OSError("lost")
        move(self, source, target)

    monkeypatch.setattr(Store, "move", failing)
    # Two moves for each old table, one for a new one, and the manifest at last.
    with pytest.raises(OSError, match="lost"):
        publish(spark, root, tables(spark, 2), lambda staged: None, {})
    assert held(spark, root) == (dict.fromkeys(NAMES, 1) if old else {})
    assert (verify(spark, root)["tables"].keys() == set(NAMES)) if old else not Store(spark, root).exists(MANIFEST)


def test_a_dead_driver_is_recovered_from(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/out"
    publish(spark, root, tables(spark, 1), lambda staged: None, {})
    move = Store.move

    def failing(self, source, target):
        if target == "b" and "_staging" in source:
            raise KeyboardInterrupt
        move(self, source, target)

    monkeypatch.setattr(Store, "move", failing)
    monkeypatch.setattr(publishing, "recover", lambda *a: False)  # the driver does not live to undo it
    with pytest.raises(KeyboardInterrupt):
        publish(spark, root, tables(spark, 2), lambda staged: None, {})
    assert Store(spark, root).exists(JOURNAL)
    with pytest.raises(ValueError, match="did not end"):
        verify(spark, root)
    monkeypatch.undo()
    assert recover(spark, root) and not recover(spark, root)
    assert held(spark, root) == dict.fromkeys(NAMES, 1) and verify(spark, root)


def test_changed_tables_and_paths_are_found(spark, tmp_path):
    root = f"{tmp_path}/out"
    publish(spark, root, tables(spark, 1), lambda staged: None, {})
    store = Store(spark, root)
    with pytest.raises(ValueError, match="leads out"):
        store.path("../x")
    tables(spark, 3)["b"].write.mode("overwrite").parquet(f"{root}/b")
    with pytest.raises(ValueError, match="b is missing or changed"):
        verify(spark, root)
    store.drop("b")
    with pytest.raises(ValueError, match="b is missing or changed"):
        verify(spark, root)
    note = store.read(MANIFEST)
    store.write(MANIFEST, note | {"about": {"policy": "other"}})
    with pytest.raises(ValueError, match="manifest was changed"):
        verify(spark, root)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    b, weeks, folder = Binding(spark, SMALL), [4, 8], tmp_path_factory.mktemp("evidence")
    made = {
        "assess_weekly": evidence.assess_weekly(b.submissions(), b.assessments()), "vle_weekly": evidence.vle_weekly(b.vle_events(), b.sites(), TYPES),
        "behavioural": behaviour.behavioural_features(b.vle_events(), roster(b), b.submissions(), b.assessments(), weeks),
    }
    for name, df in made.items():
        df.write.parquet(f"{folder}/{name}")
    read = {name: spark.read.parquet(f"{folder}/{name}") for name in made}
    return b, weeks, read


def test_the_validator_agrees_with_the_builders(built):
    b, weeks, staged = built
    audit = checks.validate_evidence(staged, b.vle_events(), b.submissions(), b.assessments(), roster(b), weeks)
    assert [r["week"] for r in audit["landmarks"]] == weeks and all(r["admissible_submissions"] > 0 for r in audit["landmarks"])


FAULTS = {
    "a score": ("assess_weekly", lambda df: df.withColumn("assess_score_max", F.col("assess_score_max") + 1e-6), "assess_weekly differs"),
    "a lost week": ("assess_weekly", lambda df: df.where("NOT (week_index = 2)"), "assess_weekly differs"),
    "clicks": ("vle_weekly", lambda df: df.withColumn("clicks_total", F.col("clicks_total") + F.when(F.col("week_index") == 3, 1).otherwise(0)), "vle_weekly differs"),
    "a repeated row": ("vle_weekly", lambda df: df.unionByName(df.limit(1)), "vle_weekly repeats"),
    "a missing enrolment": ("behavioural", lambda df: df.where("NOT (snapshot_week = 4 AND id_student % 50 = 7)"), "behavioural lacks"),
    "a repeated enrolment": ("behavioural", lambda df: df.unionByName(df.where("snapshot_week = 4 AND id_student % 50 = 7")), "behavioural repeats"),
    "a later submission": ("behavioural", lambda df: df.withColumn("time_submissions", F.col("time_submissions") + F.when(F.col("id_student") % 50 == 7, 1).otherwise(0)), "counts other submissions"),
}


@pytest.mark.parametrize("name", FAULTS)
def test_the_validator_finds_a_planted_fault(built, name):
    b, weeks, staged = built
    table, change, message = FAULTS[name]
    with pytest.raises(ValueError, match=message):
        checks.validate_evidence(staged | {table: change(staged[table])}, b.vle_events(), b.submissions(), b.assessments(), roster(b), weeks)


def test_the_validator_finds_an_unknown_assessment(built):
    b, weeks, staged = built
    with pytest.raises(ValueError, match="exactly one assessment"):
        checks.validate_evidence(staged, b.vle_events(), b.submissions(), b.assessments().where("id_assessment != 3"), roster(b), weeks)
