"""All logistic fits of a benchmark at once: one pass over the rows serves every landmark, model, population, repeat and fold.

Fits of one cell (a landmark and a model) differ only in the rows that they leave out. A pass adds up the gradient and the
second derivatives of each fit in the tasks, sums meet by fit on the executors, which solve for the step of Newton's method,
and the driver sees the steps: one number for each feature and fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.columns import KEY, group_id
from waymark.sources.scratch import stored, stored_all

#: Rows whose products are taken at once, so that they stay in a processor's cache.
CHUNK = 2_048
#: Passes at most, and the decrement (in log-loss, twice what a step still gains) up to which a step is the last.
PASSES, DECREMENT = 60, 1e-9
#: Share of a column's mean square that its variance must exceed; the rest is rounding of a constant.
CONSTANT = 1e-12
#: Columns of a scored panel that the rows carry.
CARRIED = ["dataset", "week", *KEY, "risk", "has_activity", "no_activity", "outcome_realized", "membership_class"]
_SUMS = pa.schema([("cell", pa.int32()), ("fit", pa.int32()), ("values", pa.binary())])
SUMS = "cell int, fit int, values binary"
Sums = dict[tuple[int, int], np.ndarray]


@dataclass(frozen=True)
class Layout:
    """Numbers of the fits of a cell: first one for each training population over all its rows, where the others start,
    then one for each population, repeat and fold."""

    specs: dict[str, list[tuple[str, str]]]
    repeats: int
    folds: int

    @property
    def flags(self) -> list[str]:
        """Columns of the populations, of training and of evaluation."""
        return sorted({*self.specs, *[e for cells in self.specs.values() for _, e in cells]})

    @property
    def protocols(self) -> list[tuple[str, str, str]]:
        return [(p, population, e) for population, cells in self.specs.items() for p, e in cells]

    @property
    def pooled(self) -> range:
        return range(len(self.specs))

    @property
    def fits(self) -> range:
        return range(len(self.specs) * (1 + self.repeats * self.folds))

    def number(self, population: str, repeat: int, fold: int) -> int:
        p = list(self.specs).index(population)
        return len(self.specs) + (p * self.repeats + repeat - 1) * self.folds + fold - 1

    def start(self, fit: int) -> int:
        return (fit - len(self.specs)) // (self.repeats * self.folds)

    def trains(self, fit: int, flags: dict[str, np.ndarray], folds: np.ndarray) -> np.ndarray:
        """Rows that a fit is made of; rows without a fold (0) train none of a repeat."""
        names = list(self.specs)
        if fit < len(names):
            return flags[names[fit]]
        rest, fold = divmod(fit - len(names), self.folds)
        p, repeat = divmod(rest, self.repeats)
        return flags[names[p]] & (folds[:, repeat] > 0) & (folds[:, repeat] != fold + 1)


@dataclass
class Fit:
    """A fit under way: place is looked at next, and kept is the best yet, of that loss; spread has its rows' deviations."""

    spread: np.ndarray
    place: np.ndarray
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0))
    loss: float = np.inf
    done: bool = False

    def move(self, loss: float, decrement: float, step: np.ndarray) -> None:
        if loss > self.loss + 1e-9 * (1 + abs(self.loss)):
            self.place = (self.place + self.kept) / 2  # too far: half way back
            return
        self.kept, self.loss, self.done = self.place, loss, decrement <= DECREMENT
        self.place = self.place - step


def model_rows(base: DataFrame, folds: DataFrame, weeks: list[int], k: int, name: str, layout: Layout) -> DataFrame:
    """The rows of a model's cells, one cell for each week: what the panel carries, the flags of the populations, y, the features
    x, and the fold of each repeat (0 for none). folds has KEY and folds, one row each (see fold_lists)."""
    flags = [F.col(c).cast("boolean").alias(f"in_{c}") for c in layout.flags]
    cell = F.lit(k * len(weeks)) + F.array_position(F.array(*map(F.lit, weeks)), F.col("week")).cast("int") - 1
    rows = base.where(F.col("week").isin(weeks)).join(folds.hint("merge"), KEY)
    return rows.select(cell.alias("cell"), F.lit(name).alias("model"), *CARRIED, F.col("cutoff_valid").alias("valid"), *flags, F.col("label").cast("int").alias("y"), "x", "folds")


def fold_lists(folds: DataFrame, repeats: int) -> DataFrame:
    """KEY and folds: the fold of each repeat in their order, 0 where there is none."""
    by = folds.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("repeat", "fold"))).alias("by"))
    return by.select(*KEY, F.array(*[F.coalesce(F.try_element_at("by", F.lit(r + 1)), F.lit(0)) for r in range(repeats)]).alias("folds"))


def counted(rows: DataFrame, layout: Layout) -> DataFrame:
    """Equal rows once, with their number n, stored: those without activity differ by little more than their folds. Rows of a
    cell lie together."""
    by = ["cell", "y", "folds", *[f"in_{c}" for c in layout.flags], "x"]
    return stored(rows.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n")).sortWithinPartitions("cell"), "counted")


def _parts(batch: pa.RecordBatch, layout: Layout, chunk: int = CHUNK) -> Iterator[tuple]:
    """Chunks of a batch by cell: the cell, how often each row counts, ones and features, y, flags and folds."""
    cells = batch.column("cell").to_numpy()
    for cell in np.unique(cells):
        own = np.flatnonzero(cells == cell)
        for at in range(0, len(own), chunk):
            some = batch if len(own) == batch.num_rows <= chunk else batch.take(pa.array(own[at : at + chunk]))
            lists = lambda c, some=some: some.column(c).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)
            x = np.column_stack([np.ones(some.num_rows), lists("x")])
            if not np.isfinite(x).all():
                raise ValueError("a feature is null or no finite number")
            flags = {c: some.column(f"in_{c}").to_numpy(zero_copy_only=False).astype(bool) for c in layout.flags}
            yield int(cell), some.column("n").to_numpy(), x, some.column("y").to_numpy().astype(float), flags, lists("folds")


def _summed(rows: DataFrame, layout: Layout, add: Callable[[Sums, tuple], None], end: Callable[[tuple[int, int], np.ndarray], np.ndarray]) -> Sums:
    """What add makes of all chunks, summed by cell and fit on the executors, and what end makes of a sum there."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Sums = {}
        for batch in batches:
            for part in _parts(batch, layout):
                add(sums, part)
        for (cell, fit), values in sums.items():
            yield pa.RecordBatch.from_pydict({"cell": [cell], "fit": [fit], "values": [values.tobytes()]}, _SUMS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Sums = {}
        for batch in batches:
            for cell, fit, values in zip(*[c.to_pylist() for c in batch.columns]):
                sums[cell, fit] = sums.get((cell, fit), 0.0) + np.frombuffer(values)
        for (cell, fit), values in sums.items():
            yield pa.RecordBatch.from_pydict({"cell": [cell], "fit": [fit], "values": [end((cell, fit), values).tobytes()]}, _SUMS)

    found = rows.mapInArrow(walk, SUMS).repartition("cell", "fit").mapInArrow(merge, SUMS).collect()
    return {(r["cell"], r["fit"]): np.frombuffer(r["values"]) for r in found}


def _moments(rows: DataFrame, layout: Layout) -> Sums:
    """Of each fit the number of its rows, their successes, sums and squares by feature; at -1 numbers and successes of the
    test rows by evaluation population, repeat and fold."""
    repeats, folds, names = layout.repeats, layout.folds, layout.flags

    def add(sums: Sums, part: tuple) -> None:
        cell, n, x, y, flags, of = part
        all_values = n[:, None] * np.column_stack([x[:, :1], y, x[:, 1:], x[:, 1:] ** 2])
        trains = np.column_stack([layout.trains(f, flags, of) for f in layout.fits]).astype(float)
        for f, values in zip(layout.fits, trains.T @ all_values):
            sums[cell, f] = sums.get((cell, f), 0.0) + values
        tests = np.column_stack([flags[e] & (of[:, r] == k + 1) for e in names for r in range(repeats) for k in range(folds)]).astype(float)
        sums[cell, -1] = sums.get((cell, -1), 0.0) + (tests.T @ all_values[:, :2]).ravel()

    return _summed(rows, layout, add, lambda _, values: values)


def _pass(rows: DataFrame, layout: Layout, fits: dict[tuple[int, int], Fit]) -> Sums:
    """Loss, decrement and Newton's step of each fit at its place. Weights of the scaled features are shrunk as with C = 1: half
    the sum of their squares is added to the sum of the log-losses. The intercept is not shrunk."""
    places = {key: fit.place for key, fit in fits.items()}
    spreads = {key: fit.spread for key, fit in fits.items()}
    by_cell = {cell: [f for c, f in places if c == cell] for cell, _ in places}

    def add(sums: Sums, part: tuple) -> None:
        cell, n, x, y, flags, of = part
        for f in by_cell.get(cell, []):
            mine = layout.trains(f, flags, of)
            a, t, times = x[mine], y[mine], n[mine]
            z = a @ places[cell, f]
            e = np.exp(-np.abs(z))
            p = np.where(z >= 0, 1, e) / (1 + e)
            loss = times @ np.logaddexp(0, np.where(t > 0, -z, z))
            slope = a.T @ (times * (p - t))
            a *= np.sqrt(times * p * (1 - p))[:, None]
            curve = a.T @ a
            sums[cell, f] = sums.get((cell, f), 0.0) + np.concatenate([[loss], slope, curve[np.triu_indices(len(slope))]])

    def step(key: tuple[int, int], values: np.ndarray) -> np.ndarray:
        place, spread = places[key], spreads[key]
        d = len(place)
        loss, slope, curve = values[0], values[1 : d + 1], np.zeros((d, d))
        curve[np.triu_indices(d)] = values[d + 1 :]
        curve = curve + np.triu(curve, 1).T
        # In scaled features a constant one is zero, and its weight stays zero.
        scale = np.concatenate([[1.0], np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)])
        shrunk = np.concatenate([[0.0], spread]) * place
        slope = scale * slope + shrunk
        curve = scale[:, None] * curve * scale + np.diag(np.concatenate([[0.0], np.ones(d - 1)]))
        try:
            move = np.linalg.solve(curve, slope)
        except np.linalg.LinAlgError:
            move = np.linalg.lstsq(curve, slope, rcond=None)[0]
        return np.concatenate([[loss + (shrunk**2).sum() / 2, slope @ move], scale * move])

    return _summed(rows, layout, add, step)


def _settle(rows: DataFrame, layout: Layout, fits: dict[tuple[int, int], Fit]) -> None:
    """Passes until all fits are done. A fit that is not after PASSES of them is an error."""
    for _ in range(PASSES):
        open_fits = {key: fit for key, fit in fits.items() if not fit.done}
        if not open_fits:
            return
        for key, values in _pass(rows, layout, open_fits).items():
            fits[key].move(values[0], values[1], values[2:])
    raise ValueError("a logistic fit does not settle")


def fit_all(rows: DataFrame, layout: Layout) -> tuple[dict[tuple[int, int], np.ndarray], dict[int, np.ndarray]]:
    """Intercept and weights of each cell and fit whose training rows hold both classes; and by cell, of each evaluation
    population, repeat and fold, whether its test rows do."""
    rows = counted(rows, layout)
    moments = _moments(rows, layout)
    both = lambda n, s: (s > 0) & (s < n)
    tests = {cell: both(*v.reshape(len(layout.flags), layout.repeats, layout.folds, 2).transpose(3, 0, 1, 2)) for (cell, f), v in moments.items() if f < 0}

    def begun(key: tuple[int, int], start: np.ndarray | None) -> Fit:
        n, values = moments[key][0], moments[key][2:]
        sums, squares = np.split(values, 2)
        variance = (squares - sums * sums / n) / max(n - 1, 1)
        spread = np.sqrt(np.where(variance > CONSTANT * squares / n, variance, 0.0))
        place = np.zeros(len(spread) + 1) if start is None else start.copy()
        place[1:][spread == 0] = 0.0
        return Fit(spread, place)

    usable = [key for key, v in moments.items() if key[1] >= 0 and both(v[0], v[1])]
    pooled = {key: begun(key, None) for key in usable if key[1] in layout.pooled}
    _settle(rows, layout, pooled)
    fits = {(c, f): begun((c, f), pooled[c, layout.start(f)].place) for c, f in usable if f not in layout.pooled}
    _settle(rows, layout, fits)
    return {key: fit.place for key, fit in fits.items()}, tests


def score_all(rows: DataFrame, layout: Layout, weights: dict[tuple[int, int], np.ndarray], tests: dict[int, np.ndarray]) -> DataFrame:
    """rows with p: the probability of success by protocol and repeat, NaN where a row is not in the evaluation population or
    has no fold, or where the fit or the test is left out."""
    names, flags_of, order = list(layout.specs), layout.flags, layout.protocols
    shape = (len(names), layout.repeats, layout.folds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            for cell in np.unique(cells):
                some = batch.take(pa.array(np.flatnonzero(cells == cell)))
                _, _, x, _, flags, of = next(_parts(some, layout, len(cells)))
                nothing = np.full(x.shape[1], np.nan)
                each = np.stack([weights.get((int(cell), layout.number(p, r + 1, k + 1)), nothing) for p in names for r in range(layout.repeats) for k in range(layout.folds)])
                place = np.maximum(of, 1) - 1
                z = np.take_along_axis((x @ each.T).reshape(-1, *shape), place[:, None, :, None], 3)[..., 0]
                e = np.exp(-np.abs(z))
                fitted = np.where(z >= 0, 1, e) / (1 + e)
                out = np.full((len(x), len(order), layout.repeats), np.nan)
                for j, (_, population, evaluated) in enumerate(order):
                    told = tests[int(cell)][flags_of.index(evaluated)][np.arange(layout.repeats), place]
                    out[:, j] = np.where(told & (of > 0) & flags[evaluated][:, None], fitted[:, names.index(population)], np.nan)
                width = len(order) * layout.repeats
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, width), pa.int32()), pa.array(out.ravel()))
                kept = some.drop_columns(["x", "n", *[f"in_{c}" for c in flags_of]])
                yield pa.RecordBatch.from_arrays([*kept.columns, lists], names=[*kept.schema.names, "p"])

    kept = rows.drop("x", *[f"in_{c}" for c in flags_of]).withColumn("p", F.array(F.lit(0.0)))
    return rows.withColumn("n", F.lit(1.0)).mapInArrow(score, kept.schema)


def panel_of(scored: DataFrame, layout: Layout) -> DataFrame:
    """The scored panel, in the columns of models.benchmark."""
    name: Callable[[int], Column] = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in layout.protocols]), (F.col("nth") / layout.repeats).cast("int") + 1)
    rows = scored.select("*", F.posexplode("p").alias("nth", "p_success")).where("NOT isnan(p_success)").withColumn("repeat", F.col("nth") % layout.repeats + 1)
    return rows.select(
        "dataset", "week", name(0).alias("protocol"), name(1).alias("train_protocol"), name(2).alias("eval_protocol"), "model", *KEY, "y", "risk", "has_activity", "no_activity", "outcome_realized", F.col("valid").alias("cutoff_valid"), "membership_class",
        group_id("presentation").alias("cluster_id"), F.lit("presentation").alias("cluster_unit"), "repeat", F.element_at("folds", F.col("repeat")).alias("fold"), "p_success", (1 - F.col("p_success")).alias("risk_score"),
    )


def benchmark_all(models: dict[str, DataFrame], folds: DataFrame, weeks: list[int], layout: Layout) -> DataFrame:
    """Scored panel of logistic models at any number of landmarks: what models.benchmark gives for each of them.

    A model's base has KEY, label, the membership columns, its landmark as week, and its features as the array x, which is of
    one length at a landmark. The rows are stored once.
    """
    lists = stored(fold_lists(folds, layout.repeats), "fold-lists")
    rows = stored_all([model_rows(base, lists, weeks, k, name, layout) for k, (name, base) in enumerate(models.items())], "logistic")
    weights, tests = fit_all(rows, layout)
    if not weights:
        raise ValueError("no fold has two classes to train on")
    return panel_of(score_all(rows, layout, weights, tests), layout)
