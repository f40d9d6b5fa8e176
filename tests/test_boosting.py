"""Leaf-wise boosting against a grower that tries every split of every leaf."""

from __future__ import annotations

import numpy as np
import pytest

from waymark.operators.boosting import Boosting, fit_boosting

NAMES = ["a", "b", "c"]


def rows(n, seed):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n), rng.integers(0, 30, n) / 7, rng.normal(size=n)])
    y = (x[:, 0] * x[:, 1] + 3 * x[:, 2] + rng.normal(size=n) > 8).astype(int)
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, c double, y int").repartition(5)


def brute(x, y, s):
    """The raw scores of x: leaves are split best first, each by the best of all splits."""
    edges = [(v[:-1] + v[1:]) / 2 for v in (np.unique(c) for c in x.T)]
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        worth = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + s.l2)  # noqa: B023, E731

        def best(node):
            found = (0.0, None)
            for f, cuts in enumerate(edges):
                for cut in cuts:
                    left, right = node[x[node, f] <= cut], node[x[node, f] > cut]
                    if min(len(left), len(right)) >= s.least_rows and min(h[left].sum(), h[right].sum()) >= s.least_hessian:  # noqa: B023
                        gain = worth(left) + worth(right) - worth(node)
                        if gain > found[0] + 1e-12:
                            found = (gain, (left, right))
            return found

        leaves = [(np.arange(len(y)), best(np.arange(len(y))))]
        while len(leaves) < s.leaves:
            k = max(range(len(leaves)), key=lambda k: leaves[k][1][0])
            if leaves[k][1][1] is None:
                break
            node = leaves.pop(k)
            leaves += [(part, best(part)) for part in node[1][1]]
        for node, _ in leaves:
            raw[node] -= s.rate * g[node].sum() / (h[node].sum() + s.l2)
    return raw


@pytest.mark.parametrize("settings", [Boosting(rounds=3), Boosting(rounds=2, leaves=5, least_rows=3, rate=0.5, l2=0.1)])
def test_equals_brute_force(spark, settings):
    x, y = rows(160, 1)
    model = fit_boosting(frame(spark, x, y), NAMES, settings)
    assert np.abs(model.raw(x) - brute(x, y, settings)).max() < 1e-9
    got = model.score(frame(spark, x, y), NAMES).select(*NAMES, "p_success").collect()
    at = {tuple(r): 1 / (1 + np.exp(-v)) for r, v in zip(map(tuple, x), model.raw(x))}
    assert all(abs(r["p_success"] - at[r["a"], r["b"], r["c"]]) < 1e-12 for r in got)


def test_leaves_are_limited_and_depth_is_not(spark):
    # Each split takes the end of what is left: a chain as deep as there are leaves.
    x = np.column_stack([np.repeat(np.arange(16), 20), np.zeros(320), np.zeros(320)]).astype(float)
    y = (x[:, 0] % 2).astype(int)
    model = fit_boosting(frame(spark, x, y), NAMES, Boosting(rounds=1, leaves=15, least_rows=20))
    assert sum(f < 0 for f in model.trees[0].feature) == 15


def test_stops_early_on_held_out_rows(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, 3)), rng.integers(0, 2, 300)  # nothing to learn
    model = fit_boosting(frame(spark, x, y), NAMES, Boosting(rounds=40, rate=0.5, stop_early=True, patience=3))
    assert 3 <= len(model.trees) < 20 and len(model.losses) == len(model.trees) + 1


def test_odd_tables(spark):
    x, y = rows(60, 2)
    one = fit_boosting(frame(spark, x, np.ones(60, int)), NAMES, Boosting(rounds=2))
    assert (one.raw(x) > 20).all()
    few = fit_boosting(frame(spark, x[:5], np.array([0, 1, 0, 1, 1])), NAMES, Boosting(rounds=2))
    assert few.trees == [] and np.allclose(1 / (1 + np.exp(-few.raw(x))), 0.6)
    with pytest.raises(ValueError):
        fit_boosting(frame(spark, x[:0], y[:0]), NAMES)
    x[0, 0] = np.nan
    with pytest.raises(ValueError):
        fit_boosting(frame(spark, x, y), NAMES)
