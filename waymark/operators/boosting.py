"""Leaf-wise gradient boosting of two classes on histograms.

Features become bins by quantiles once; rows are stored in packed blocks. Each step of a tree sums gradients and hessians
by node, feature and bin: per task in arrays, then merged by node and feature on the executors, which return the best
split of each. The driver sees these, one row per node and feature, keeps the queue of leaves by gain and decides which
to split next. A step looks at the children of all leaves that may still be split, so a tree takes about as many steps
as it is deep.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.sources.scratch import stored

#: Cells (rows x features) of a block, and rounds after which the rows' scores are written anew.
BLOCK, REFRESH = 2**22, 25
BLOCKS = "n int, bins binary, y binary, held binary, raw binary"
_BLOCKS = pa.schema([("n", pa.int32()), *[(c, pa.binary()) for c in ("bins", "y", "held", "raw")]])
_SUMS = pa.schema([("node", pa.int32()), ("feature", pa.int32()), ("sums", pa.binary())])
_SPLITS = pa.schema([("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("gain", pa.float64()), *[(c, pa.float64()) for c in ("g", "h", "n", "gl", "hl", "nl")]])
SPLITS = "node int, feature int, bin int, gain double, g double, h double, n double, gl double, hl double, nl double"


@dataclass(frozen=True)
class Boosting:
    """Settings. Without a choice of early stopping it is on from more than 10,000 rows: a tenth of the rows is held out,
    and boosting ends when the held-out loss has not fallen by the tolerance for as many rounds as patience says."""

    rounds: int = 250
    rate: float = 0.06
    leaves: int = 15
    l2: float = 1.0
    bins: int = 255
    least_rows: int = 20
    least_hessian: float = 1e-3
    stop_early: bool | None = None
    held: float = 0.1
    patience: int = 10
    tolerance: float = 1e-7


class Tree:
    """A binary tree in arrays; feature is -1 for leaves. Rows go left where their bin is at most the node's."""

    def __init__(self) -> None:
        self.feature, self.bin, self.left, self.right, self.value = [-1], [0], [0], [0], [0.0]

    def split(self, node: int, feature: int, place: int) -> tuple[int, int]:
        left = len(self.feature)
        for values, own in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            values += [own, own]
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, place, left, left + 1
        return left, left + 1

    def leaf(self, rows: np.ndarray, places: np.ndarray | list = ()) -> np.ndarray:
        """The leaf of each row, compared with the nodes' bins or with other thresholds by node."""
        feature, left, right = (np.array(x) for x in (self.feature, self.left, self.right))
        limit = np.array(self.bin if not len(places) else places)
        at, each = np.zeros(len(rows), np.int64), np.arange(len(rows))
        while (inner := feature[at] >= 0).any():
            down = rows[each, np.maximum(feature[at], 0)] <= limit[at]
            at = np.where(inner, np.where(down, left[at], right[at]), at)
        return at


@dataclass
class Split:
    """A node's sums, and its best split with the sums on the left."""

    gain: float
    feature: int
    bin: int
    g: float
    h: float
    n: float
    gl: float
    hl: float
    nl: float


@dataclass
class Boosted:
    """A fitted model: the start, the trees and the bins' edges by feature."""

    start: float
    trees: list[Tree]
    edges: list[np.ndarray]
    losses: list[float]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            limits = [self.edges[f][b] if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.bin)]
            out += np.array(tree.value)[tree.leaf(x, limits)]
        return out

    def score(self, rows: DataFrame, features: list[str], name: str = "p_success") -> DataFrame:
        """rows with the probability of class 1; the trees travel with the task."""

        @F.pandas_udf("double")
        def probability(x: pd.Series) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-self.raw(np.stack(x.to_numpy())))) if len(x) else np.zeros(0))

        return rows.withColumn(name, probability(_features(features)))


def _features(features: list[str]):
    return F.array(*[F.col(c).cast("double") for c in features])


def bin_edges(train: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Middles between neighbouring quantiles, so all values are told apart where a feature has few; one pass for all."""
    shares = [k / bins for k in range(bins + 1)]
    found = train.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 100 * bins).alias(f"q{k}") for k, c in enumerate(features)]).first()
    values = [np.unique(np.array(v if v is not None else [], float)) for v in found]
    if any(not np.isfinite(v).all() for v in values):
        raise ValueError("features must be finite")
    return [(v[:-1] + v[1:]) / 2 for v in values]


def _packed(train: DataFrame, features: list[str], edges: list[np.ndarray], start: float, held: float, seed: int) -> DataFrame:
    """Stored blocks of binned rows. Which rows are held out is a hash of their values."""
    kind = np.uint8 if max(map(len, edges), default=0) < 256 else np.uint16
    most = max(1, BLOCK // max(len(features), 1))

    def row(x: np.ndarray, y: np.ndarray, out: np.ndarray) -> pa.RecordBatch:
        bins = np.empty(x.shape, kind)
        for f, edge in enumerate(edges):
            bins[:, f] = np.searchsorted(edge, x[:, f], side="left")
        cells = [bins.tobytes(), y.astype(np.uint8).tobytes(), out.astype(np.uint8).tobytes(), np.full(len(y), start).tobytes()]
        return pa.RecordBatch.from_pydict({"n": [len(y)], **{c: [v] for c, v in zip(("bins", "y", "held", "raw"), cells)}}, _BLOCKS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            kept.append((x, batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)))
            if sum(len(k[1]) for k in kept) >= most:
                yield row(*[np.concatenate(c) for c in zip(*kept)])
                kept = []
        if kept:
            yield row(*[np.concatenate(c) for c in zip(*kept)])

    out = F.pmod(F.xxhash64(*features, "y", F.lit(seed)), F.lit(10_000)) < F.lit(int(held * 10_000))
    rows = train.select(_features(features).alias("x"), F.col("y").cast("int"), out.alias("held"))
    return stored(rows.mapInArrow(pack, BLOCKS), "boosting")


def _open(batch: pa.RecordBatch, i: int, width: int, kind: type, trees: list[Tree]) -> tuple[np.ndarray, ...]:
    """A block's bins, classes, what is held out, and scores, with those of the trees that were not written yet."""
    y, held = (np.frombuffer(batch.column(c)[i].as_py(), np.uint8) for c in (2, 3))
    x = np.frombuffer(batch.column(1)[i].as_py(), kind).reshape(len(y), width)
    raw = np.frombuffer(batch.column(4)[i].as_py()).copy()
    for tree in trees:
        raw += np.array(tree.value)[tree.leaf(x)]
    return x, y, held, raw


class Grower:
    """Boosting over stored blocks."""

    def __init__(self, blocks: DataFrame, edges: list[np.ndarray], settings: Boosting):
        self.blocks, self.edges, self.settings = blocks, edges, settings
        self.width = len(edges)
        self.bins = max((len(e) for e in edges), default=0) + 1
        self.kind = np.uint8 if self.bins <= 256 else np.uint16
        self.recent: list[Tree] = []  # trees since the blocks were written

    def refresh(self) -> None:
        """Write the rows' scores by all trees so far."""
        trees, width, kind = list(self.recent), self.width, self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raws = [_open(batch, i, width, kind, trees)[3].tobytes() for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(raws, pa.binary())], schema=_BLOCKS)

        self.blocks = stored(self.blocks.mapInArrow(run, BLOCKS), "boosting")
        self.recent = []

    def splits(self, tree: Tree, nodes: list[int], loss: bool) -> tuple[dict[int, Split], float | None]:
        """The best split of each node, and the mean loss of the held-out rows."""
        trees, s, width, n_bins, kind = list(self.recent), self.settings, self.width, self.bins, self.kind
        slot = np.full(len(tree.feature), -1)
        slot[nodes] = np.arange(len(nodes))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, len(nodes) * width * n_bins))
            lost = np.zeros(3)
            for batch in batches:
                for i in range(batch.num_rows):
                    x, y, held, raw = _open(batch, i, width, kind, trees)
                    out = held > 0
                    if loss and out.any():
                        lost += [np.logaddexp(0, np.where(y[out] > 0, -raw[out], raw[out])).sum(), out.sum(), 0]
                    own = np.where(out, -1, slot[tree.leaf(x)])
                    x, y, raw, own = (v[own >= 0] for v in (x, y, raw, own))
                    p = 1 / (1 + np.exp(-raw))
                    cell = ((own[:, None] * width + np.arange(width)) * n_bins + x).ravel()
                    for k, w in enumerate((p - y, p * (1 - p), None)):
                        total[k] += np.bincount(cell, None if w is None else np.repeat(w, width), total.shape[1])
            table = total.reshape(3, len(nodes), width, n_bins)
            for k, node in enumerate(nodes):
                if table[2, k].any():
                    parts = [np.ascontiguousarray(table[:, k, f]).tobytes() for f in range(width)]
                    yield pa.RecordBatch.from_pydict({"node": [node] * width, "feature": list(range(width)), "sums": parts}, _SUMS)
            if lost[1]:
                yield pa.RecordBatch.from_pydict({"node": [-1], "feature": [-1], "sums": [lost.tobytes()]}, _SUMS)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for node, f, part in zip(*[batch.column(c).to_pylist() for c in range(3)]):
                    own = np.frombuffer(part)
                    held[node, f] = held[node, f] + own if (node, f) in held else own
            out = [(node, f, *_best(v.reshape(3, -1), s)) if node >= 0 else (node, f, 0, v[0] / v[1], *[0.0] * 6) for (node, f), v in held.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(_SPLITS.names, r)) for r in out], _SPLITS)

        merged = self.blocks.mapInArrow(sums, "node int, feature int, sums binary").repartition("node", "feature").mapInArrow(merge, SPLITS)
        found, mean = {}, None
        for row in sorted(merged.collect(), key=lambda r: r["feature"]):  # one row per node and feature
            if row["node"] < 0:
                mean = row["gain"]
            elif row["node"] not in found or row["gain"] > found[row["node"]].gain:
                found[row["node"]] = Split(**{k: row[k] for k in _SPLITS.names[1:]})
        return found, mean

    def tree(self, stop) -> Tree | None:
        """The next tree; None if stop says so of the held-out loss, or where no rows are left to fit."""
        s, shape = self.settings, Tree()
        known, loss = self.splits(shape, [0], True)
        if stop(loss) or 0 not in known:
            return None
        while True:
            # Best first, as far as the children's splits are known.
            taken, leaves, blocked = [], [0], False
            while len(leaves) < s.leaves and not blocked:
                node = max(leaves, key=lambda k: (known[k].gain, -k))
                if not known[node].gain > 0:
                    break
                if shape.feature[node] < 0 or shape.left[node] not in known:
                    blocked = True
                    continue
                leaves.remove(node)
                leaves += [shape.left[node], shape.right[node]]
                taken.append(node)
            if not blocked:
                break
            wanted = []
            for node in sorted((k for k in leaves if known[k].gain > 0), key=lambda k: -known[k].gain)[: s.leaves - len(leaves)]:
                if shape.feature[node] < 0:
                    own = known[node]
                    left, right = shape.split(node, own.feature, own.bin)
                    for child, sums in ((left, (own.gl, own.hl, own.nl)), (right, (own.g - own.gl, own.h - own.hl, own.n - own.nl))):
                        known[child] = Split(0.0, -1, 0, *sums, 0.0, 0.0, 0.0)
                        if sums[2] >= 2 * s.least_rows:
                            wanted.append(child)
            if wanted and len(leaves) + 1 < s.leaves:
                known |= self.splits(shape, wanted, False)[0]
        return self._cut(shape, known, set(taken))

    def _cut(self, shape: Tree, known: dict[int, Split], taken: set[int]) -> Tree:
        """The nodes that were taken, with the leaves' values."""
        out, todo = Tree(), [(0, 0)]
        while todo:
            node, place = todo.pop()
            if node in taken:
                children = out.split(place, shape.feature[node], shape.bin[node])
                todo += zip((shape.left[node], shape.right[node]), children)
            else:
                out.value[place] = -self.settings.rate * known[node].g / (known[node].h + self.settings.l2)
        return out


def _best(sums: np.ndarray, s: Boosting) -> tuple[int, float, float, float, float, float, float, float]:
    """(bin, gain, g, h, n, gl, hl, nl) of a feature's best split; gain 0 where none is allowed or gains."""
    total = sums.sum(axis=1)
    left = np.cumsum(sums, axis=1)[:, :-1]
    right = total[:, None] - left
    worth = lambda v: v[0] ** 2 / (v[1] + s.l2)
    gain = worth(left) + worth(right) - worth(total)
    allowed = (np.minimum(left[2], right[2]) >= s.least_rows) & (np.minimum(left[1], right[1]) >= s.least_hessian)
    gain = np.where(allowed, gain, 0.0)
    if not len(gain) or not gain.max() > 1e-12:
        return 0, 0.0, *total, 0.0, 0.0, 0.0
    k = int(np.argmax(gain))
    return k, float(gain[k]), *total, *left[:, k]


def fit_boosting(train: DataFrame, features: list[str], settings: Boosting = Boosting(), seed: int = 0) -> Boosted:
    """The model of train (features and y, 0 or 1), by log-loss.

    Features must be finite numbers. Rows of one class give a constant; an empty table is an error.
    """
    sizes = train.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("ones")).first()
    if not sizes["n"]:
        raise ValueError("no rows to fit")
    early = sizes["n"] > 10_000 if settings.stop_early is None else settings.stop_early
    p = min(max(sizes["ones"] / sizes["n"], 1e-12), 1 - 1e-12)
    start = float(np.log(p / (1 - p)))
    edges = bin_edges(train, features, settings.bins)
    grower = Grower(_packed(train, features, edges, start, settings.held if early else 0.0, seed), edges, settings)
    trees: list[Tree] = []
    losses: list[float] = []

    def stop(loss: float | None) -> bool:
        if not early or loss is None:
            return False
        losses.append(loss)
        before = losses[: -settings.patience]
        return bool(before) and not min(losses[-settings.patience :]) < min(before) - settings.tolerance

    while len(trees) < settings.rounds:
        tree = grower.tree(stop)
        if tree is None or tree.feature == [-1]:
            break
        trees.append(tree)
        grower.recent.append(tree)
        if len(grower.recent) == REFRESH:
            grower.refresh()
    return Boosted(start, trees, edges, losses)
