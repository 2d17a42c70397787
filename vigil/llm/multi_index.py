"""What the operators over an inverted multi-index share: valid rows, two half-space codebooks, the traversal.

A vector is cut into two halves, each with a codebook of its own; the pairs of codes form a
product grid of cells. Codebooks are fitted on a bounded sample (``SAMPLE`` rows, those with the
smallest hashes of their content); every row is indexed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 16_384             # rows that codebooks (and the traversal's depth) are fitted on
ROUNDS = 8                  # of Lloyd's algorithm
CELL_ROWS = 32              # rows a cell of the grid is meant to hold
CODES = (4, 1024)           # least and most codes of a half
SEED = 20240311


def component_type(vectors: DataFrame, column: str = "embedding") -> str:
    """``float`` where the vectors hold floats (half the bytes to move), else ``double``."""
    return "float" if isinstance(vectors.schema[column].dataType.elementType, T.FloatType) else "double"


def is_vector(vec) -> F.Column:
    """Neither null nor empty, and without null, NaN or infinite components."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & finite, F.lit(False))


def commonest_length(vectors: DataFrame) -> int:
    """Length of most vectors (the longer on ties), 0 without any; one row per length is summed."""
    sizes = vectors.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return sizes[0]["n"] if sizes else 0


def matrix_of(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def sampled(vectors: DataFrame, rows: int = SAMPLE) -> np.ndarray:
    """At most ``rows`` vectors, those with the smallest hashes of their content (ties by id)."""
    table = vectors.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(rows).toArrow()
    if not table.num_rows:
        return np.zeros((0, 0))
    return matrix_of(table.column("vec").combine_chunks(), table.num_rows)


def codes_for(rows: int) -> int:
    """Codes per half, so that the grid has a cell for about ``CELL_ROWS`` rows."""
    return int(min(max(2 ** round(np.log2(max(rows / CELL_ROWS, 1)) / 2), CODES[0]), CODES[1]))


def squared_gaps(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    gaps = (points ** 2).sum(axis=1)[:, None] - 2 * (points @ centres.T) + (centres ** 2).sum(axis=1)
    return np.maximum(gaps, 0)


def fit_codebook(points: np.ndarray, codes: int, seed: int = SEED) -> np.ndarray:
    distinct = np.unique(points, axis=0)
    codes = min(codes, len(distinct))
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), codes, replace=False)]
    for _ in range(ROUNDS):
        home = squared_gaps(points, centres).argmin(axis=1)
        held = np.bincount(home, minlength=codes)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, points)
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    return centres


class MultiIndex:
    """Two codebooks and the cells (first code * codes of the second half + second code) of vectors."""

    def __init__(self, sample: np.ndarray, codes: int):
        self.cut = sample.shape[1] // 2
        self.books = fit_codebook(sample[:, :self.cut], codes), fit_codebook(sample[:, self.cut:], codes)

    @property
    def sizes(self) -> tuple[int, int]:
        return len(self.books[0]), len(self.books[1])

    def half_gaps(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared_gaps(vectors[:, :self.cut], self.books[0]), squared_gaps(vectors[:, self.cut:], self.books[1])

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        first, second = self.half_gaps(vectors)
        return first.argmin(axis=1) * self.sizes[1] + second.argmin(axis=1)


def nearest_cells(first: np.ndarray, second: np.ndarray, visits: int) -> np.ndarray:
    """(rows, visits) cells in the order of their summed half distances, for all rows at once.

    This is the multi-sequence traversal: the cell at places (a, b) of the two sorted lists comes
    after the (a + 1)(b + 1) - 1 cells that have no later place in either, so only
    places with (a + 1)(b + 1) <= visits can be among the first ``visits``.
    """
    visits = min(visits, first.shape[1] * second.shape[1])
    a, b = np.array(list(chain.from_iterable(
        ((i, j) for j in range(min(second.shape[1], visits // (i + 1)))) for i in range(min(first.shape[1], visits))))).T
    one, two = np.argsort(first, axis=1, kind="stable"), np.argsort(second, axis=1, kind="stable")
    sums = np.take_along_axis(first, one, 1)[:, a] + np.take_along_axis(second, two, 1)[:, b]
    chosen = np.argsort(sums, axis=1, kind="stable")[:, :visits]
    return np.take_along_axis(one, a[chosen], 1) * second.shape[1] + np.take_along_axis(two, b[chosen], 1)


def multi_sequence(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) of all pairs in decreasing order of first[i] + second[j], one at a time from a heap."""
    one, two = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    top, low = first[one].tolist(), second[two].tolist()
    heap = [(-(top[0] + low[0]), 0, 0)] if one and two else []
    while heap:
        total, a, b = heapq.heappop(heap)
        yield -total, one[a], two[b]
        if b + 1 < len(two):
            heapq.heappush(heap, (-(top[a] + low[b + 1]), a, b + 1))
        if b == 0 and a + 1 < len(one):
            heapq.heappush(heap, (-(top[a + 1] + low[0]), a + 1, 0))
