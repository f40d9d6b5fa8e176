"""Whitening against NumPy's eigenvectors and exact integers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from oracle import SMALL
from waymark.llm import whitening
from waymark.llm.queries import QUERIES

ROWS = "vec_id long, embedding array<double>, label int, n string, component string"


def expected(vectors):
    """id -> (deviation, whitened by component), explained, of whole vectors of one length."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    exact = [int(sum((n * a - s) ** 2 for a, s in zip(r, sums))) for r in x]
    centred = (n * x - sums).astype(float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return exact, centred @ v / np.sqrt(e), e / e.sum()


def check(got, vectors):
    exact, white, share = expected(vectors)
    k = min(8, white.shape[1])
    assert len(got) == k * len(vectors)
    at = {vec_id: i for i, (vec_id, _) in enumerate(vectors)}
    own = np.zeros((len(vectors), k))
    for r in got:
        assert r["deviation"] == exact[at[r["vec_id"]]] and r["n"] == len(vectors)
        assert r["explained"] == pytest.approx(share[r["component"] - 1], rel=1e-9) and r["identity_error"] < 1e-9
        own[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
    signs = np.sign((own * white[:, :k]).sum(axis=0))
    assert np.abs(own * signs - white[:, :k]).max() < 1e-7
    assert np.abs(own.T @ own / len(own) - np.eye(k)).max() < 1e-9


def test_query_equals_numpy(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    whole = [(r[0], [float(c) for c in r[1]]) for r in table if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    check(QUERIES["op12_whitening"](spark, SMALL).collect(), whole)


def test_lengths_odd_rows_and_many_partitions(spark):
    rng = np.random.default_rng(3)
    whole = [(k, (rng.normal(size=5) * [1, 2, 3, 4, 5]).tolist()) for k in range(80)]
    other = [(100 + k, rng.normal(size=3).tolist()) for k in range(30)]
    odd = [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("nan")] * 5), (204, [float("inf")] * 3), (205, [1e300] * 5)]
    df = spark.createDataFrame([(k, v, 1, "x", "y") for k, v in whole + other + odd], ROWS).repartition(70)
    got = whitening.whiten(df).collect()
    check([r for r in got if r["vec_id"] < 100], whole)
    check([r for r in got if r["vec_id"] >= 100], other)
    assert {r["vec_id"] for r in got} == {k for k, _ in whole + other}
    assert whitening.whiten(df.where("false")).count() == 0


def test_vectors_without_variance(spark):
    same = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    for r in whitening.whiten(same).collect():
        assert r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] == 0
    few = spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (2, [2.0, 4.0, 0.0])], "vec_id long, embedding array<float>")
    for r in whitening.whiten(few).collect():
        assert (abs(abs(r["whitened"]) - 1) < 1e-12) if r["component"] == 1 else r["whitened"] is None


def test_deviation_beyond_a_long_is_null_and_large_entries_stay_exact(spark):
    rows = [(1, [2.0**50, 0.0]), (2, [0.0, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r["deviation"] is None for r in got)
    x = np.array([[2**60, 5], [-3, 2]], np.int64)
    sums = [2**60 - 3, 7]
    assert whitening._squares(x, 2, sums) == [sum((2 * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x]


@pytest.mark.parametrize("d", [1, 2, 7, 64])
def test_rotations_equal_numpy(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(200, d)) * np.logspace(0, -9, d)
    v, s = whitening.jacobi(whitening.triangle(a))
    # Columns of very different lengths: the small values keep their digits.
    assert np.allclose(s, np.linalg.svd(a, compute_uv=False), rtol=1e-9, atol=0)
    assert np.abs(v.T @ v - np.eye(d)).max() < 1e-13 and np.all(np.diff(s) <= 0)
