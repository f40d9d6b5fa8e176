"""PCA whitening of embeddings by one-sided Jacobi SVD of a blockwise tall-skinny QR.

Each partition compresses its centred rows to a triangle R, block by block; triangles are stacked and compressed again in
rounds of a bounded number until one is left, whose columns plane rotations make orthogonal: R V = U diag(s). The columns
of V are the components, s / sqrt(n) the standard deviations, accurate also where they are small, since no covariance
is formed. Whitened rows are projections of centred rows over the standard deviations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Numbers in a block of rows that meets the triangle at once, and triangles that are stacked at once.
BLOCK, STACK = 2**20, 32
#: Scaled entries are below this in absolute value.
LIMIT = 2.0**62
#: Two columns count as orthogonal from this cosine on; rounds of rotations over all pairs, at most.
COSINE, SWEEPS = 1e-15, 60
#: Standard deviations below this share of the largest are those of no variance at all.
RANK = 1e-13


@dataclass
class Fit:
    """What is fitted to the n vectors of one length: exact sums by dimension, axes by falling deviation, trace."""

    n: int
    sums: list[int]
    axes: np.ndarray  # dimension x components
    deviations: np.ndarray
    variance: float

    def rows(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums) @ self.axes / np.where(self.deviations > 0, self.deviations, np.nan)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n: whole parts as integers, so that only the fraction and the result are rounded."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole).astype(float) - np.array([s % n / n for s in sums])


def _squares(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The exact sum over the dimensions of (n x - S)^2 of each row, with y = x - S // n and r = S % n as
    n^2 y y - 2 n r y + r r."""
    y, rest = x - np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], object)
    most = float(np.abs(y.astype(float)).max(initial=0))
    wide = most * max(most, n) * x.shape[1] >= LIMIT
    if wide:
        y = y.astype(object)
    yy, ry = (y * y).sum(axis=1).tolist(), (y * (rest if wide else rest.astype(np.int64))).sum(axis=1).tolist()
    own = int((rest * rest).sum())
    return [n * n * int(a) - 2 * n * int(b) + own for a, b in zip(yy, ry)]


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(V, s) with orthogonal V and R V of orthogonal columns of the falling lengths s.

    Each round rotates half as many disjoint pairs as there are columns, by the tournament's order.
    """
    d = r.shape[1]
    size = d + d % 2
    a, v = np.zeros((len(r), size)), np.eye(size)
    a[:, :d] = r
    order = np.arange(size)
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(max(size - 1, 1)):
            left, right = order[: size // 2], order[: size // 2 - 1 : -1]
            p, q = a[:, left], a[:, right]
            alpha, beta, gamma = (p * p).sum(0), (q * q).sum(0), (p * q).sum(0)
            with np.errstate(divide="ignore", invalid="ignore"):
                cosine = np.where(alpha * beta > 0, np.abs(gamma) / np.sqrt(alpha) / np.sqrt(beta), 0.0)
                zeta = (beta - alpha) / (2 * gamma)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            turn = cosine > COSINE
            worst = max(worst, float(cosine.max(initial=0)))
            t = np.where(turn, t, 0.0)
            c = 1 / np.hypot(1, t)
            s = c * t
            for m in (a, v):
                x, y = m[:, left], m[:, right]
                m[:, left], m[:, right] = c * x - s * y, s * x + c * y
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
        if worst <= COSINE * 10:
            break
    lengths = np.sqrt((a * a).sum(0))[:d]
    falling = np.argsort(-lengths, kind="stable")
    return v[:d, :d][:, falling], lengths[falling]


def whole_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """id and x, the scaled and shifted integers, of the vectors that take part: not those that are null, empty or hold
    an entry that is null, not finite or too large for a long. Null ids take part."""
    scaled = lambda c: F.floor(c.cast("double") * scale)
    fits = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) * scale < LIMIT), F.lit(False))
    rows = vectors.where(F.col(vector_col).isNotNull()).where((F.size(vector_col) > 0) & F.forall(vector_col, fits))
    return rows.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda c: scaled(c) + shift).alias("x"))


_SUMS = pa.schema([("dim", pa.int32()), ("pos", pa.int32()), ("n", pa.int64()), ("s", pa.string())])
_TRIANGLES = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("r", pa.binary())])
_AXES = pa.schema([("dim", pa.int32()), ("axes", pa.binary()), ("s", pa.list_(pa.float64())), ("total", pa.float64())])
_MOMENTS = pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("a", pa.float64()), ("b", pa.float64()), ("s", pa.float64())])


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of the vectors in a batch."""
    x = batch.column(batch.num_columns - 1)
    sizes, flat = np.diff(x.offsets.to_numpy()), x.flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[starts[rows][:, None] + np.arange(d)]


def _sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """n and the exact sums by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for _, x in _by_length(batch):
                d = x.shape[1]
                n, before = held.get(d, (0, np.zeros(d, object)))
                small = float(np.abs(x.astype(float)).max()) * len(x) < LIMIT
                held[d] = n + len(x), before + (x if small else x.astype(object)).sum(axis=0).astype(object)
        for d, (n, total) in held.items():
            yield pa.RecordBatch.from_pydict({"dim": [d] * d, "pos": list(range(d)), "n": [n] * d, "s": [str(int(s)) for s in total]}, _SUMS)

    parts = rows.select("x").mapInArrow(run, "dim int, pos int, n long, s string")
    sums = parts.groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found: dict[int, tuple[int, list[int]]] = {}
    for row in sums.orderBy("dim", "pos").collect():  # one row per dimension
        found.setdefault(row["dim"], (row["n"], []))[1].append(int(row["s"]))
    return found


def _packed(d: int, block: int, r: np.ndarray) -> dict[str, list]:
    return {"dim": [d], "block": [block], "r": [np.ascontiguousarray(r).tobytes()]}


def _triangles(rows: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> DataFrame:
    """dim and r, the triangle of all centred rows of a length."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_length(batch):
                d = x.shape[1]
                step = max(d, BLOCK // d)
                for at in range(0, len(x), step):
                    y = _centred(x[at : at + step], *sums[d])
                    held[d] = triangle(np.vstack([held[d], y]) if d in held else y)
        for d, r in held.items():
            yield pa.RecordBatch.from_pydict(_packed(d, TaskContext.get().partitionId(), r), _TRIANGLES)

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        d = table.column("dim")[0].as_py()
        stacked = np.vstack([np.frombuffer(r.as_py()).reshape(-1, d) for r in table.column("r")])
        return pa.Table.from_pydict(_packed(d, table.column("block")[0].as_py() // STACK, triangle(stacked)), _TRIANGLES)

    found = stored(rows.select("x").mapInArrow(leaves, "dim int, block long, r binary"), "triangles")
    blocks = (found.agg(F.max("block")).first()[0] or 0) + 1
    while blocks > 1:
        found = found.groupBy("dim", F.floor(F.col("block") / STACK).alias("part")).applyInArrow(merge, "dim int, block long, r binary")
        blocks = -(-blocks // STACK)
    return found


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit by length of the vectors; what the driver sees is one fit for each length, of components + 1 numbers a
    dimension."""
    sums = _sums(rows)

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, r in zip(batch.column("dim").to_pylist(), batch.column("r").to_pylist()):
                v, s = jacobi(np.frombuffer(r).reshape(-1, d))
                s = np.where(s > RANK * s.max(initial=0), s, 0.0)
                yield pa.RecordBatch.from_pydict({"dim": [d], "axes": [np.ascontiguousarray(v[:, :components]).tobytes()], "s": [s[:components].tolist()], "total": [float((s * s).sum())]}, _AXES)

    found = {}
    for row in _triangles(rows, sums).mapInArrow(rotate, "dim int, axes binary, s array<double>, total double").collect():
        d = row["dim"]
        n, own = sums[d]
        found[d] = Fit(n, own, np.frombuffer(row["axes"]).reshape(d, -1), np.array(row["s"]) / np.sqrt(n), row["total"] / n)
    return found


def identity_errors(rows: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """By length the largest absolute entry of the whitened rows' covariance less the identity, over the components that
    have a variance; 0 without any. Partitions centre on their own means, which the merge accounts for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for _, x in _by_length(batch):
                d = x.shape[1]
                w = fits[d].rows(x)[:, fits[d].deviations > 0]
                k = w.shape[1]
                n, mean, spread = held.get(d, (0, np.zeros(k), np.zeros((k, k))))
                m, own = len(w), w.mean(axis=0)
                off, step = w - own, own - mean
                held[d] = n + m, mean + step * m / (n + m), spread + off.T @ off + np.outer(step, step) * n * m / (n + m)
        for d, (n, mean, spread) in held.items():
            i, j = (x.ravel() for x in np.indices(spread.shape))
            yield pa.RecordBatch.from_pydict({"dim": [d] * len(i), "i": i.tolist(), "j": j.tolist(), "n": [n] * len(i), "a": mean[i].tolist(), "b": mean[j].tolist(), "s": spread.ravel().tolist()}, _MOMENTS)

    parts = rows.select("x").mapInArrow(run, "dim int, i int, j int, n long, a double, b double, s double")
    n = F.sum("n")
    cell = (F.sum(F.col("s") + F.col("n") * F.col("a") * F.col("b")) - F.sum(F.col("n") * F.col("a")) * F.sum(F.col("n") * F.col("b")) / n) / n
    cells = parts.groupBy("dim", "i", "j").agg(cell.alias("c"))
    worst = cells.groupBy("dim").agg(F.max(F.abs(F.col("c") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))).alias("e"))
    return {row["dim"]: row["e"] for row in worst.collect()}


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """id_col, component (from 1 by falling variance), n, deviation, whitened, explained and identity_error for each
    vector that takes part and each component up to the number asked for or the vectors' length.

    See whole_rows for the vectors that take part. Vectors of several lengths are fitted and whitened apart, each length
    on its own. deviation is exact, and null where it does not fit a long. A component without variance (fewer vectors
    than dimensions, equal vectors, constant entries) explains 0 and has a null whitened value. Repeated rows count and
    are returned each time; further columns are not read. Signs are those of the rotations, the same for all rows.
    """
    rows = whole_rows(vectors, id_col, vector_col, scale, shift)
    fits = fit(rows, components)
    errors = identity_errors(rows, fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_length(batch):
                own = fits[x.shape[1]]
                w = own.rows(x)
                k, dev = w.shape[1], _squares(x, own.n, own.sums)
                ids = pa.compute.take(batch.column(0), pa.array(np.repeat(at, k)))
                dev = pa.array([e if e < 2**63 else None for e in dev], pa.int64())
                share = own.deviations**2 / own.variance if own.variance > 0 else np.zeros(k)
                yield pa.RecordBatch.from_pydict({
                    id_col: ids, "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), "n": pa.array(np.full(k * len(x), own.n)),
                    "deviation": pa.compute.take(dev, pa.array(np.repeat(np.arange(len(x)), k))), "whitened": pa.array(w.ravel(), from_pandas=True),
                    "explained": pa.array(np.tile(share, len(x))), "identity_error": pa.array(np.full(k * len(x), errors.get(x.shape[1]) or 0.0)),
                })

    id_type = vectors.schema[id_col].dataType.simpleString()
    return rows.select("id", "x").mapInArrow(run, f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
