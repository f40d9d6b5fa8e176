"""The network: gradients against finite differences, training and its end."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators.network import Layers, Training, fit_network


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(0)
    layers = Layers([4, 5, 3, 1])
    params, x, y = layers.start(1), rng.normal(size=(20, 4)), rng.integers(0, 2, 20)
    _, grad = layers.loss(params, x, y, 0.1)
    for k in range(layers.count):
        step = np.zeros(layers.count)
        step[k] = 1e-6
        near = (layers.loss(params + step, x, y, 0.1)[0] - layers.loss(params - step, x, y, 0.1)[0]) / 2e-6
        # The offsets are not part of the decay, which the gradient of the weights holds.
        assert abs(near - grad[k]) < 1e-7


def frame(spark, n, parts, labels):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3))
    y = labels(x, rng)
    return spark.createDataFrame([([float(v) for v in r], int(t)) for r, t in zip(x, y)], "x array<double>, y int").repartition(parts), x, y


@pytest.mark.parametrize("parts", [1, 4])
def test_learns_what_no_line_tells_apart(spark, parts):
    df, x, y = frame(spark, 1200, parts, lambda x, rng: x[:, 0] * x[:, 1] > 0)
    net = fit_network(df, F.col("x"), Training(hidden=(16, 8), epochs=40, batch=16, rate=0.01), seed=1)
    got = net.score(df, F.col("x")).select("y", "p_success").toPandas()
    assert ((got.p_success > 0.5) == got.y).mean() > 0.9
    assert max(net.accuracies) > 0.85


def test_stops_early_and_keeps_the_best(spark):
    df, x, y = frame(spark, 400, 2, lambda x, rng: rng.integers(0, 2, len(x)))  # nothing to learn
    settings = Training(hidden=(8,), epochs=60, batch=32, rate=0.01, patience=3)
    net = fit_network(df, F.col("x"), settings, seed=1)
    assert 4 <= len(net.accuracies) < 55
    best = int(np.argmax(net.accuracies))
    assert len(net.accuracies) - 1 - best <= 3 + best + 1
    again = fit_network(df, F.col("x"), Training(hidden=(8,), epochs=best + 2, batch=32, rate=0.01, patience=3), seed=1)
    assert np.allclose(again.params, net.params)


def test_no_rows(spark):
    with pytest.raises(ValueError):
        fit_network(spark.createDataFrame([], "x array<double>, y int"), F.col("x"))
