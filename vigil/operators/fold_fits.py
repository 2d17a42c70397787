"""Preparation and logistic fits of many training sets at once (L2-L4 for L8, L9).

Rows carry a ``cell`` (a small integer: the fold whose test rows they are, or a finer cut), and a training
set is a set of cells, so forward-chained folds are prefixes and the final fit is all cells. The rows are stored
once as matrix blocks (``Matrix``); everything that fitting needs is taken from them per cell and merged:

* ``preps_of``: counts, moments and quantile sketches per cell in one pass; the sketches bracket every set's
  medians, and one more pass ranks the values inside the brackets, so medians are exact;
* ``fit_logits``: Newton steps for all sets from one pass over the blocks each, in which a task adds up gradient
  and Hessian of every set.

What the tasks hand on is merged in a tree, so no step collects more than one row per cell or set. The Hessian has
a number per pair of columns: for thousands of columns use ``models.fit_logit_lbfgs``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.cumulative import running_totals
from vigil.operators.prep import Prepared, encoders_for, scale_of, split_columns
from vigil.session import cut_lineage

QUANTILES = 201             # points of a cell's sketch
MARGIN = 3.0 / QUANTILES    # of rank on either side of a quantile, within which its bracket lies
HELD = 16                   # sketches that are merged at once
BLOCK_ROWS = 1024
FAN_IN = 64                 # sums that one task adds up
NEWTON_STEPS = 100
TOLERANCE = 1e-9            # of the largest change of a coefficient, relative to the largest coefficient


class Moments:
    """Counts, means, squared deviations and sketch points per column of some rows; NaN is NULL."""

    def __init__(self, rows: int, counts, means, squares, points):
        self.rows, self.counts, self.means, self.squares, self.points = rows, counts, means, squares, points

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        known = ~np.isnan(x)
        counts = known.sum(axis=0).astype(np.float64)
        safe = np.maximum(counts, 1)
        means = np.where(known, x, 0).sum(axis=0) / safe
        squares = (np.where(known, x - means, 0) ** 2).sum(axis=0)
        places = np.rint(np.linspace(0, 1, QUANTILES)[:, None] * np.maximum(counts - 1, 0)).astype(np.int64)
        return cls(len(x), counts, means, squares, np.take_along_axis(np.sort(x, axis=0), places, axis=0))     # NaN sorts last

    @classmethod
    def merged(cls, parts: list[Moments]) -> Moments:
        if len(parts) == 1:
            return parts[0]
        counts = sum(p.counts for p in parts)
        safe = np.maximum(counts, 1)
        means = sum(p.counts * p.means for p in parts) / safe
        squares = sum(p.squares + p.counts * (p.means - means) ** 2 for p in parts)
        values = np.concatenate([p.points for p in parts])
        weights = np.repeat(np.array([p.counts / QUANTILES for p in parts]), QUANTILES, axis=0)
        order = np.argsort(values, axis=0, kind="stable")
        values, weights = np.take_along_axis(values, order, 0), np.take_along_axis(weights, order, 0)
        upto = np.cumsum(weights, axis=0)
        wanted = np.linspace(0, 1, QUANTILES)
        places = np.stack([np.searchsorted(upto[:, c], wanted * counts[c] * (1 - 1e-12)) for c in range(len(counts))], axis=1)
        return cls(sum(p.rows for p in parts), counts, means, squares, np.take_along_axis(values, np.minimum(places, len(values) - 1), 0))

    def packed(self) -> bytes:
        return np.concatenate([[self.rows], self.counts, self.means, self.squares, self.points.ravel()]).astype("<f8").tobytes()

    @classmethod
    def unpacked(cls, raw: bytes) -> Moments:
        held = np.frombuffer(raw, "<f8")
        rest = held[1:].reshape(QUANTILES + 3, -1)
        return cls(int(held[0]), rest[0], rest[1], rest[2], rest[3:])


def tree_merged(parts: DataFrame, tasks: int, merge: Callable[[list[bytes]], bytes]) -> dict[int, bytes]:
    """Per ``fit`` the merged ``body`` of all tasks, in groups of ``FAN_IN`` until one is left."""
    def add(table: pa.Table) -> pa.Table:
        return pa.table({"fit": table.column("fit").slice(0, 1), "part": table.column("part").slice(0, 1),
                         "body": pa.array([merge(table.column("body").to_pylist())], pa.binary())})

    schema = "fit int, part int, body binary"
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        parts = (parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
                 .groupBy("fit", "part").applyInArrow(add, schema))
    parts = parts.withColumn("part", F.lit(0)).groupBy("fit", "part").applyInArrow(add, schema)
    return {r["fit"]: bytes(r["body"]) for r in parts.collect()}       # one row per fit


class Matrix:
    """Rows as stored blocks of a raw double matrix (NaN: null; categories by their place), labels and cells."""

    def __init__(self, rows: DataFrame, columns, cell: str = "cell", label: str | None = None):
        self.spark = rows.sparkSession
        self.numeric, self.categorical = split_columns(rows, columns)
        self.seen: dict[tuple, dict] = {}       # (cell, place of the column) -> category counts
        if self.categorical:
            each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(self.categorical)]))
            for r in (rows.select(F.col(cell).alias("cell"), each.alias("x")).filter("x.v IS NOT NULL")
                      .groupBy("cell", "x.i", "x.v").count().collect()):        # a row per (cell, column, category)
                self.seen.setdefault((r["cell"], r["i"]), {})[r["v"]] = r["count"]
        self.labels = {c: sorted({v for (_, k), held in self.seen.items() if k == i for v in held})
                       for i, c in enumerate(self.categorical)}
        nan = F.lit(float("nan"))

        def code(c: str):
            if not self.labels[c]:
                return nan
            place = F.array_position(F.array(*[F.lit(v) for v in self.labels[c]]), F.col(c))
            return F.when(place > 0, place.cast("double") - 1).otherwise(nan)

        raw = F.array(*[F.coalesce(F.col(c).cast("double"), nan) for c in self.numeric], *[code(c) for c in self.categorical])
        flat = rows.select(raw.alias("x"), (F.col(label).cast("int") if label else F.lit(0)).alias("y"), F.col(cell).cast("int").alias("cell"))
        # Stored as a checkpoint, which keeps the partitions and their order: boosted trees sample by them.
        self.blocks = cut_lineage(flat.mapInArrow(_blocks, "n int, size int, x binary, y binary, cells binary"))
        self.tasks = self.blocks.rdd.getNumPartitions()

    def moments(self) -> dict[int, Moments]:
        """Per cell the moments and sketches of the numeric columns, in one pass."""
        width = len(self.numeric)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[Moments]] = {}
            for raw, _, cells in _opened(batches):
                for c in np.unique(cells).tolist():
                    own = held.setdefault(c, [])
                    own.append(Moments.of(raw[cells == c, :width]))
                    if len(own) >= HELD:
                        held[c] = [Moments.merged(own)]
            for c, own in held.items():
                yield _sent(c, Moments.merged(own).packed())

        merged = tree_merged(self.blocks.mapInArrow(run, "fit int, part int, body binary"), self.tasks,
                             lambda bodies: Moments.merged([Moments.unpacked(b) for b in bodies]).packed())
        return {c: Moments.unpacked(b) for c, b in merged.items()}

    def near(self, ends: dict[int, tuple[float, float]]) -> DataFrame:
        """(i, v, cell, cnt): values of column i within its ends and, where v is null, the number of values below them."""
        places = np.array(sorted(ends))
        low, high = (np.array([ends[i][k] for i in sorted(ends)]) for k in (0, 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            below: dict[int, np.ndarray] = {}
            for raw, _, cells in _opened(batches):
                x = raw[:, places]
                for c in np.unique(cells).tolist():
                    below[c] = below.get(c, 0) + (x[cells == c] < low).sum(axis=0)
                at, i = np.nonzero((x >= low) & (x <= high))
                yield _rows(places[i], x[at, i], cells[at], np.ones(len(at), dtype=np.int64))
            for c, counts in below.items():
                yield _rows(places, None, np.full(len(places), c), counts)

        return self.blocks.mapInArrow(run, "i int, v double, cell int, cnt long")

    def design(self, prep: Prepared) -> Design:
        return Design(prep, self.numeric, self.categorical, self.labels)

    def vectors(self, design: Design, cells: set) -> DataFrame:
        """(_x, _y): the prepared rows of the cells as ``prep.transform`` gives them, made from the blocks when they are read."""
        wanted = sorted(cells)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for raw, y, own in _opened(batches):
                rows = np.isin(own, wanted)
                if rows.any():
                    x = np.ascontiguousarray(design.matrix(raw[rows])[:, :-1])
                    ends = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x.ravel())),
                                                      pa.array(y[rows], pa.float64())], ["x", "y"])

        made = self.blocks.mapInArrow(run, "x array<double>, y double")
        return made.select(array_to_vector("x").alias("_x"), F.col("y").alias("_y"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            x = part.column(0).flatten().to_numpy(zero_copy_only=False).astype("<f8")
            # columns one after another: lagged columns of sorted rows repeat each other, which zstd finds
            body = x.reshape(part.num_rows, -1).T.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.num_rows], pa.int32()), pa.array([len(body)], pa.int32()),
                 pa.array([pa.compress(body, codec="zstd", asbytes=True)], pa.binary()),
                 *[pa.array([part.column(c).to_numpy(zero_copy_only=False).astype("<i4").tobytes()], pa.binary()) for c in (1, 2)]],
                ["n", "size", "x", "y", "cells"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for r in range(batch.num_rows):
            raw = np.frombuffer(pa.decompress(batch.column(2)[r].as_buffer(), batch.column(1)[r].as_py(), codec="zstd"), "<f8")
            y, cells = (np.frombuffer(batch.column(c)[r].as_buffer(), "<i4") for c in (3, 4))
            yield raw.reshape(-1, len(y)).T, y, cells


def _sent(fit: int, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([fit], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()),
                                       pa.array([body], pa.binary())], ["fit", "part", "body"])


def _rows(i, v, cells, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.nulls(len(i), pa.float64()) if v is None else pa.array(v, pa.float64()),
         pa.array(cells, pa.int32()), pa.array(counts, pa.int64())], ["i", "v", "cell", "cnt"])


def _medians(matrix: Matrix, moments: dict[int, Moments], sets: Sequence[set], margin: float = MARGIN) -> list[list[float | None]]:
    """Per training set the exact median of every numeric column (None for an all-NULL column).

    Sketches bracket the medians of all sets; the values inside are counted and ranked. Should a bracket miss, which
    the counts show, all are widened and the values taken again."""
    width = len(matrix.numeric)
    sizes, ends = {}, {}
    for s, cells in enumerate(sets):
        own = [moments[c] for c in cells if c in moments]
        if own:
            whole = Moments.merged(own)
            lo, hi = max(0, int((0.5 - margin) * (QUANTILES - 1))), min(QUANTILES - 1, int(np.ceil((0.5 + margin) * (QUANTILES - 1))))
            for i in np.flatnonzero(whole.counts).tolist():
                sizes[s, i] = int(whole.counts[i])
                low = whole.points[lo, i] if margin < 0.5 else -np.inf
                high = whole.points[hi, i] if margin < 0.5 else np.inf
                before = ends.get(i, (np.inf, -np.inf))
                ends[i] = (min(low, before[0]), max(high, before[1]))
    if not ends:
        return [[None] * width for _ in sets]
    member = [F.sum(F.when(F.col("cell").isin(*cells), F.col("cnt")).otherwise(0)).alias(f"n{s}") for s, cells in enumerate(sets)]
    held = cut_lineage(matrix.near(ends).groupBy("i", "v").agg(*member))
    sums = [f"n{s}" for s in range(len(sets))]
    under = {r["i"]: r for r in held.filter("v IS NULL").collect()}                        # a row per column
    inside = {r["i"]: r for r in held.filter("v IS NOT NULL").groupBy("i").agg(*[F.sum(c).alias(c) for c in sums]).collect()}
    for (s, i), n in sizes.items():
        first = under[i][sums[s]]
        if first > (n - 1) // 2 or first + (inside[i][sums[s]] if i in inside else 0) <= n // 2:
            return _medians(matrix, moments, sets, margin * 4)
    ranked = running_totals(held.filter("v IS NOT NULL"), ["i"], "v", sums)
    wanted, aggs = [], []
    for s in range(len(sets)):
        places = F.create_map(*[x for i in ends for x in (F.lit(i), F.array(*[
            F.lit(at - under[i][sums[s]]).cast("long") for at in ((sizes.get((s, i), 0) - 1) // 2, sizes.get((s, i), 0) // 2)]))])
        wanted.append(places[F.col("i")].alias(f"at{s}"))
        last, first = F.col(f"cum_n{s}"), F.col(f"cum_n{s}") - F.col(f"n{s}")
        aggs += [F.max(F.when((first <= F.col(f"at{s}")[k]) & (F.col(f"at{s}")[k] < last), F.col("v"))).alias(f"m{s}_{k}") for k in (0, 1)]
    found = {r["i"]: r for r in ranked.select("*", *wanted).groupBy("i").agg(*aggs).collect()}     # a row per column
    out = []
    for s in range(len(sets)):
        ends_of = [(found[i][f"m{s}_0"], found[i][f"m{s}_1"]) if (s, i) in sizes else (None, None) for i in range(width)]
        out.append([a if a is None or a == b else b - (b - a) * 0.5 for a, b in ends_of])
    return out


def preps_of(matrix: Matrix, sets: Sequence[set]) -> list[Prepared]:
    """L2 + L3 of every training set from the matrix."""
    sets = [set(s) for s in sets]
    moments = matrix.moments()
    medians = _medians(matrix, moments, sets)
    out = []
    for cells, med in zip(sets, medians):
        own = [moments[c] for c in cells if c in moments]
        median = dict(zip(matrix.numeric, med))
        mean, std = {}, {}
        for i, c in enumerate(matrix.numeric):
            if med[i] is None:
                continue
            parts = [(m.counts[i], m.means[i], m.squares[i]) for m in own if m.counts[i]]
            parts += [(m.rows - m.counts[i], med[i], 0.0) for m in own if m.rows > m.counts[i]]
            n = sum(p[0] for p in parts)
            at = sum(p[0] * p[1] for p in parts) / n
            var = sum(p[2] + p[0] * (p[1] - at) ** 2 for p in parts) / n
            mean[c], std[c] = float(at), scale_of(float(at), float(var) ** 0.5)
        mode, labels = {}, {}
        for i, c in enumerate(matrix.categorical):
            total: dict[str, int] = {}
            for k in cells:
                for v, n in matrix.seen.get((k, i), {}).items():
                    total[v] = total.get(v, 0) + n
            if total:
                mode[c] = min(total, key=lambda v: (-total[v], v))
                labels[c] = sorted(total)
        prep = Prepared([c for c in matrix.numeric if c in mean], [c for c in matrix.categorical if c in mode], median, mean, std, mode)
        prep.encoders = encoders_for(matrix.spark, prep.categorical, [labels[c] for c in prep.categorical])
        out.append(prep)
    return out


def fit_preps(rows: DataFrame, columns, sets: Sequence[set], cell: str = "cell") -> list[Prepared]:
    """L2 + L3 of every training set: what ``fit_prep`` gives on the rows of its cells."""
    return preps_of(Matrix(rows, columns, cell), sets)


class Design:
    """A training set's design matrix from raw blocks: imputed, scaled, one-hot, and a constant."""

    def __init__(self, prep: Prepared, numeric: list[str], categorical: list[str], labels: dict[str, list[str]]):
        self.places = [numeric.index(c) for c in prep.numeric]
        self.median, self.mean, self.std = (np.array([d[c] for c in prep.numeric], dtype=np.float64)
                                            for d in (prep.median, prep.mean, prep.std))
        self.coded = []
        for c, (idx, _) in zip(prep.categorical, prep.encoders):
            codes = np.array([labels[c].index(v) for v in idx.labels], dtype=np.float64)
            self.coded.append((len(numeric) + categorical.index(c), codes, float(labels[c].index(prep.mode[c]))))
        self.width = len(self.places) + sum(len(c) for _, c, _ in self.coded) + 1

    def matrix(self, raw: np.ndarray) -> np.ndarray:
        x = np.empty((len(raw), self.width), order="F")      # as the blocks are stored
        k = len(self.places)
        x[:, :k] = raw[:, self.places]
        x[:, :k] = (np.where(np.isnan(x[:, :k]), self.median, x[:, :k]) - self.mean) / self.std
        for at, codes, mode in self.coded:
            code = raw[:, at]
            x[:, k:k + len(codes)] = np.where(np.isnan(code), mode, code)[:, None] == codes
            k += len(codes)
        x[:, k] = 1.0
        return x


def _summed(bodies: list[bytes]) -> bytes:
    total = np.frombuffer(bodies[0], "<f8").copy()
    for b in bodies[1:]:
        total += np.frombuffer(b, "<f8")
    return total.tobytes()


def newton_sums(matrix: Matrix, fits: dict[int, tuple]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per fit (weighted loss, gradient, Hessian) at its coefficients, from one pass over the blocks.

    ``fits``: number -> (cells, design, coefficients, weight of class 0, weight of class 1).
    """
    sent = matrix.spark.sparkContext.broadcast(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        held = {f: np.zeros(1 + d.width + d.width ** 2) for f, (_, d, *_) in own.items()}
        for raw, y, cells in _opened(batches):
            for f, (wanted, design, beta, w0, w1) in own.items():
                rows = np.isin(cells, list(wanted))
                if not rows.any():
                    continue
                x, target = design.matrix(raw if rows.all() else raw[rows]), y[rows].astype(np.float64)
                margin = x @ beta
                p = np.exp(-np.logaddexp(0, -margin))
                w = np.where(target > 0, w1, w0)
                scaled = x * np.sqrt(w * p * (1 - p))[:, None]
                held[f][0] += (w * (np.logaddexp(0, margin) - target * margin)).sum()
                held[f][1:1 + design.width] += (w * (p - target)) @ x
                held[f][1 + design.width:] += (scaled.T @ scaled).ravel()
        for f, sums in held.items():
            yield _sent(f, sums.astype("<f8").tobytes())

    total = tree_merged(matrix.blocks.mapInArrow(run, "fit int, part int, body binary"), matrix.tasks, _summed)
    sent.unpersist()
    out = {}
    for f, (_, d, *_) in fits.items():
        sums = np.frombuffer(total[f], "<f8")
        out[f] = float(sums[0]), sums[1:1 + d.width].copy(), sums[1 + d.width:].reshape(d.width, d.width).copy()
    return out


def newton(matrix: Matrix, designs: dict[int, tuple], penalty: np.ndarray | float = 1.0, free_intercept: bool = False,
           steps: int = NEWTON_STEPS, tolerance: float = TOLERANCE) -> dict[int, np.ndarray]:
    """Coefficients (constant last) of every fit: minimum of the weighted loss + penalty / 2 * |b|^2.

    A step that does not lower the objective is halved. Fits that have settled leave the later passes.
    """
    beta = {f: np.zeros(d.width) for f, (_, d, _, _) in designs.items()}
    best = dict.fromkeys(beta, (np.inf, None))
    move: dict[int, np.ndarray] = {}
    waiting = set(beta)
    for _ in range(steps):
        sums = newton_sums(matrix, {f: (c, d, beta[f], w0, w1) for f, (c, d, w0, w1) in designs.items() if f in waiting})
        for f, (loss, gradient, hessian) in sums.items():
            weight = np.full(len(beta[f]), penalty)
            if free_intercept:
                weight[-1] = 0.0
            value = loss + 0.5 * float(weight @ beta[f] ** 2)
            if value > best[f][0] + 1e-9 * abs(best[f][0]):
                move[f] = move[f] / 2
                beta[f] = best[f][1] + move[f]
            else:
                best[f] = (value, beta[f])
                hessian[np.diag_indices_from(hessian)] += weight if not free_intercept else np.maximum(weight, 1e-12)
                move[f] = -np.linalg.solve(hessian, gradient + weight * beta[f])
                beta[f] = beta[f] + move[f]
            if np.abs(move[f]).max() <= tolerance * max(1.0, np.abs(beta[f]).max()):
                waiting.discard(f)
        if not waiting:
            break
    return beta


def fit_logits(rows: DataFrame, features, label: str, sets: Sequence[set], cell: str = "cell", c: float = 1.0,
               penalize_intercept: bool = True, max_iter: int = NEWTON_STEPS) -> list:
    """L2 + L3 + L4 of every training set: balanced class weights, penalty 1 / c, all fitted together."""
    from vigil.operators.models import LogitModel
    sets = [set(s) for s in sets]
    matrix = Matrix(rows, features, cell, label)
    preps = preps_of(matrix, sets)
    sizes = {(r["cell"], r["y"]): r["count"] for r in rows.groupBy(F.col(cell).alias("cell"), F.col(label).cast("int").alias("y"))
             .count().collect()}                                        # two rows per cell
    designs = {}
    for f, (cells, prep) in enumerate(zip(sets, preps)):
        n0, n1 = (sum(sizes.get((k, y), 0) for k in cells) for y in (0, 1))
        classes = (n0 > 0) + (n1 > 0)
        w0, w1 = ((n0 + n1) / (classes * m) if m else 0.0 for m in (n0, n1))
        designs[f] = (cells, matrix.design(prep), w0, w1)
    beta = newton(matrix, designs, 1.0 / c, not penalize_intercept, max_iter)
    return [LogitModel(prep, beta[f][:-1].tolist(), float(beta[f][-1])) for f, prep in enumerate(preps)]
