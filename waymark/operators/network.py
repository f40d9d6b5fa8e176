"""A network of rectified layers for two classes, trained by mini-batches where the rows are.

Rows are stored in packed blocks. In an epoch each task walks through the mini-batches of its blocks from the common
parameters, by Adam; the tasks' parameters and moments are then averaged by rows, piece by piece on the executors, so the
driver sees one set of them whatever the number of tasks. With one task this is plain mini-batch training. A part of the
rows is held out, and training ends when they are told apart no better for a number of epochs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.sources.scratch import stored

#: Numbers in a block of rows, and in a piece of the parameters.
BLOCK, PIECE = 2**20, 4096
BLOCKS = "block long, n int, x binary, y binary, held binary"
_BLOCKS = pa.schema([("block", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("x", "y", "held")]])
_PIECES = pa.schema([("piece", pa.int32()), ("n", pa.int64()), ("values", pa.binary())])


@dataclass(frozen=True)
class Training:
    """Settings. hidden are the layers' widths; decay is the squared weights' share of the loss; first and second are the
    moments' rates."""

    hidden: tuple[int, ...] = (128, 64, 32)
    decay: float = 1e-4
    batch: int = 256
    rate: float = 1e-3
    epochs: int = 300
    held: float = 0.1
    patience: int = 15
    tolerance: float = 1e-4
    first: float = 0.9
    second: float = 0.999


class Layers:
    """The network's shape; parameters are one flat array, each layer's weights before its offsets."""

    def __init__(self, sizes: list[int]):
        self.sizes = sizes
        self.places, at = [], 0
        for a, b in zip(sizes, sizes[1:]):
            self.places.append((at, at + a * b, at + a * b + b))
            at += a * b + b
        self.count = at

    def start(self, seed: int) -> np.ndarray:
        """Uniform in a width that keeps the signals' variance from layer to layer."""
        rng, out = np.random.default_rng(seed), np.zeros(self.count)
        for k, ((low, _, high), a, b) in enumerate(zip(self.places, self.sizes, self.sizes[1:])):
            width = np.sqrt((6.0 if k < len(self.places) - 1 else 2.0) / (a + b))
            out[low:high] = rng.uniform(-width, width, high - low)
        return out

    def parts(self, params: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(params[low:mid].reshape(a, b), params[mid:high]) for (low, mid, high), a, b in zip(self.places, self.sizes, self.sizes[1:])]

    def outputs(self, params: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """What each layer gives, the rows themselves first; the last is the log-odds."""
        out, layers = [x], self.parts(params)
        for k, (w, b) in enumerate(layers):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0) if k < len(layers) - 1 else z)
        return out

    def loss(self, params: np.ndarray, x: np.ndarray, y: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
        """The mean log-loss with the decay of the weights, and its gradient."""
        out, layers, grad = self.outputs(params, x), self.parts(params), np.zeros_like(params)
        z = out[-1][:, 0]
        value = np.logaddexp(0, np.where(y > 0, -z, z)).mean()
        delta = ((1 / (1 + np.exp(-z)) - y) / len(y))[:, None]
        for k in range(len(layers) - 1, -1, -1):
            low, mid, high = self.places[k]
            w = layers[k][0]
            value += decay * (w * w).sum() / 2 / len(y)
            grad[low:mid] = (out[k].T @ delta + decay * w / len(y)).ravel()
            grad[mid:high] = delta.sum(axis=0)
            if k:
                delta = (delta @ w.T) * (out[k] > 0)
        return float(value), grad


@dataclass
class Network:
    """A fitted network and the held-out accuracy after each epoch."""

    layers: Layers
    params: np.ndarray
    accuracies: list[float]

    def score(self, rows: DataFrame, features: Column, name: str = "p_success") -> DataFrame:
        """rows with the probability of class 1; the parameters travel with the task."""
        layers, params = self.layers, self.params

        @F.pandas_udf("double")
        def probability(x: pd.Series) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-layers.outputs(params, np.stack(x.to_numpy()))[-1][:, 0])) if len(x) else np.zeros(0))

        return rows.withColumn(name, probability(features))


def _packed(train: DataFrame, features: Column, held: float, seed: int) -> DataFrame:
    """Stored blocks of rows. Which rows are held out is a hash of their values."""
    from pyspark import TaskContext

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        block, numbers = TaskContext.get().partitionId() << 32, 0

        def row() -> pa.RecordBatch:
            x, y, out = (np.concatenate(c) for c in zip(*kept))
            return pa.RecordBatch.from_pydict({"block": [block], "n": [len(y)], "x": [x.tobytes()], "y": [y.astype(np.uint8).tobytes()], "held": [out.astype(np.uint8).tobytes()]}, _BLOCKS)

        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            kept.append((x, batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)))
            numbers += x.size
            if numbers >= BLOCK:
                yield row()
                kept, numbers, block = [], 0, block + 1
        if kept:
            yield row()

    out = F.pmod(F.xxhash64("x", "y", F.lit(seed)), F.lit(10_000)) < F.lit(int(held * 10_000))
    rows = train.select(features.cast("array<double>").alias("x"), F.col("y").cast("int").alias("y"))
    return stored(rows.withColumn("held", out).mapInArrow(pack, BLOCKS), "network")


def _epoch(blocks: DataFrame, layers: Layers, state: np.ndarray, steps: int, epoch: int, seed: int, s: Training) -> tuple[np.ndarray, float | None, int]:
    """The state (parameters and both moments) after an epoch, averaged over the tasks; the held-out accuracy before it;
    and the most steps that a task took."""
    count = layers.count

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done, fitted = state.reshape(3, count).copy(), steps, 0
        right = np.zeros(2)
        for batch in batches:
            for block, n, x, y, held in zip(*[c.to_pylist() for c in batch.columns]):
                x, y, out = np.frombuffer(x).reshape(n, -1), np.frombuffer(y, np.uint8), np.frombuffer(held, np.uint8) > 0
                if out.any():
                    z = layers.outputs(state[:count], x[out])[-1][:, 0]
                    right += [((z > 0) == (y[out] > 0)).sum(), out.sum()]
                rows = np.random.default_rng([seed, epoch, block]).permutation(np.flatnonzero(~out))
                for at in range(0, len(rows), s.batch):
                    part = rows[at : at + s.batch]
                    _, grad = layers.loss(own[0], x[part], y[part], s.decay)
                    done += 1
                    own[1] = s.first * own[1] + (1 - s.first) * grad
                    own[2] = s.second * own[2] + (1 - s.second) * grad**2
                    own[0] -= s.rate * np.sqrt(1 - s.second**done) / (1 - s.first**done) * own[1] / (np.sqrt(own[2]) + 1e-8)
                fitted += len(rows)
        if fitted:
            flat = np.append(own.ravel(), float(done)) * fitted
            for k in range(0, len(flat), PIECE):
                yield pa.RecordBatch.from_pydict({"piece": [k // PIECE], "n": [fitted], "values": [flat[k : k + PIECE].tobytes()]}, _PIECES)
        if right[1]:
            yield pa.RecordBatch.from_pydict({"piece": [-1], "n": [0], "values": [right.tobytes()]}, _PIECES)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for piece, n, values in zip(*[c.to_pylist() for c in batch.columns]):
                own = sums.setdefault(piece, [0, 0.0])
                own[0], own[1] = own[0] + n, own[1] + np.frombuffer(values)
        for piece, (n, values) in sums.items():
            yield pa.RecordBatch.from_pydict({"piece": [piece], "n": [n], "values": [values.tobytes()]}, _PIECES)

    shape = "piece int, n long, values binary"
    found = {r["piece"]: r for r in blocks.mapInArrow(walk, shape).repartition("piece").mapInArrow(merge, shape).collect()}
    right = np.frombuffer(found.pop(-1)["values"]) if -1 in found else None
    if not found:
        raise ValueError("no rows to fit")
    flat = np.concatenate([np.frombuffer(found[k]["values"]) for k in sorted(found)]) / found[0]["n"]
    return flat[:-1], None if right is None else float(right[0] / right[1]), int(round(flat[-1]))


def fit_network(train: DataFrame, features: Column, settings: Training = Training(), seed: int = 0) -> Network:
    """The network of train (an array of features, and y, 0 or 1).

    Without held-out rows, as a tiny table may have, all epochs are run. The parameters of the best held-out accuracy are
    kept. A table without rows to fit is an error.
    """
    blocks = _packed(train, features, settings.held, seed)
    width = train.select(F.size(features).alias("d")).first()
    if width is None:
        raise ValueError("no rows to fit")
    layers = Layers([width["d"], *settings.hidden, 1])
    state = np.concatenate([layers.start(seed), np.zeros(2 * layers.count)])
    best, since, steps, accuracies, kept = -1.0, 0, 0, [], state[: layers.count]
    for epoch in range(settings.epochs):
        after, accuracy, steps = _epoch(blocks, layers, state, steps, epoch, seed, settings)
        if accuracy is not None and epoch:
            accuracies.append(accuracy)
            since = 0 if accuracy > best + settings.tolerance else since + 1
            if accuracy > best:
                best, kept = accuracy, state[: layers.count]
            if since > settings.patience:
                break
        state = after
    return Network(layers, kept if accuracies else state[: layers.count], accuracies)
