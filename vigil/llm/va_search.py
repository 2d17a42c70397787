"""Exact top-k inner product over vector-approximation files.

The index keeps, per shard of rows, an approximation file (one byte per component: the
cell of an even grid between the component's smallest and largest value) and the exact
integer vectors. A search scans the cells only, which bounds every score from both
sides: the k-th largest lower bound rules out all vectors with a smaller upper bound. The rest
are read exactly in the order of their upper bounds until the k-th exact score is above
every bound still unread (ties are read too). Shards give their own k best; the k best of
those are the answer.

Components are floor(scale * x). Defined results: vectors that are null, hold null or
non-finite components, or differ in length from the rest take no part; rows with the
query's own vec_id are not its candidates, of rows with the same vec_id one takes part (the
smallest vector); vectors with a component so large that a score may not fit a long take no part; fewer than k candidates give fewer rows;
an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import stored
from vigil.llm.vectors import (QUERY_BLOCK, QUERY_EVERY, SHARD_ROWS, best_per_query, search_all, shard_rows,
                               valid_vectors)

CELLS = 256
SCORE_BITS = 62             # that a sum of products may have
READ_AT_ONCE = 64           # exact vectors read between two looks at the k-th score
SCAN_ROWS = 2048            # approximations bounded at once
INDEX_SCHEMA = "slot int, n int, ids binary, cells binary, exact binary"


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    v = valid_vectors(vectors, drop_zero=False)
    fits = F.forall("vec", lambda x: F.abs(x) * F.lit(float(scale)) <= F.sqrt(F.lit(2.0 ** SCORE_BITS) / F.size("vec")))
    return v.filter(fits).select("vec_id", F.transform("vec", lambda x: F.floor(x * F.lit(scale)).cast("double")).alias("vec"))


def build_va_files(integers: DataFrame, rows: int = SHARD_ROWS) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(index, smallest value per component, cell width per component)."""
    spread = (integers.select(F.posexplode("vec").alias("d", "x")).groupBy("d")
              .agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("d").collect())   # one row per component
    low = np.array([r["lo"] for r in spread], dtype=np.float64)
    high = np.array([r["hi"] for r in spread], dtype=np.float64)
    width = np.maximum(1.0, np.ceil((high - low + 1) / CELLS)) if len(spread) else high

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, matrix in shard_rows(batches, rows):
            cells = np.floor((matrix - low) / width).clip(0, CELLS - 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([len(ids)], pa.int32()),
                 pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([cells.tobytes()], pa.binary()),
                 pa.array([matrix.astype("<i8").tobytes()], pa.binary())], ["slot", "n", "ids", "cells", "exact"])

    return stored(integers.mapInArrow(build, INDEX_SCHEMA), "va-files"), low, width


def score_bounds(cells: np.ndarray, low, width, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest inner product a vector of these cells can have with each query."""
    least = low + cells * width
    most = least + (width - 1)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    lower, upper = up @ least.T + down @ most.T, up @ most.T + down @ least.T
    if np.abs(queries).max(initial=0) * np.maximum(np.abs(least), np.abs(most)).max(initial=0) * queries.shape[1] >= 2 ** 52:
        slack = 2.0 ** -50 * (np.abs(queries) @ np.maximum(np.abs(least), np.abs(most)).T) + 1      # sums that doubles round
        return lower - slack, upper + slack
    return lower, upper


def search_shard(ids, cells, exact, low, width, query_ids, queries, k) -> Iterator[tuple]:
    """(query_id, vec_id, score) of each query's k best in one shard."""
    n = len(ids)
    lower, upper = np.empty((len(queries), n)), np.empty((len(queries), n))
    for at in range(0, n, SCAN_ROWS):
        part = slice(at, at + SCAN_ROWS)
        lower[:, part], upper[:, part] = score_bounds(cells[part], low, width, queries)
    whole = queries.astype(np.int64)
    for q, own in enumerate(query_ids):
        others = np.flatnonzero(ids != own)
        if len(others) > k:
            certain = np.partition(lower[q, others], len(others) - k)[len(others) - k]
            others = others[upper[q, others] >= certain]
        others = others[np.argsort(-upper[q, others], kind="stable")]
        kept_scores, kept_ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for at in range(0, len(others), READ_AT_ONCE):
            if len(kept_ids) == k and upper[q, others[at]] < kept_scores[-1]:
                break
            read = others[at:at + READ_AT_ONCE]
            kept_scores = np.concatenate([kept_scores, exact[read] @ whole[q]])
            kept_ids = np.concatenate([kept_ids, ids[read]])
            best = np.lexsort((kept_ids, -kept_scores))[:k]
            kept_scores, kept_ids = kept_scores[best], kept_ids[best]
        yield own, kept_ids, kept_scores


def exact_top_k(spark: SparkSession, vectors: DataFrame, k: int = 10, scale: int = 1024,
                every: int = QUERY_EVERY, rows: int = SHARD_ROWS, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of every query."""
    integers = stored(integer_vectors(vectors, scale), "integer-vectors")
    index, low, width = build_va_files(integers, rows)

    def search(shard: dict, query_ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple]:
        n = shard["n"]
        return search_shard(np.frombuffer(shard["ids"], "<i8"), np.frombuffer(shard["cells"], np.uint8).reshape(n, -1),
                            np.frombuffer(shard["exact"], "<i8").reshape(n, -1), low, width, query_ids, queries, k)

    found = search_all(index, integers, "query_id long, vec_id long, score long", search, every, block)
    return best_per_query(found, k, descending=True)
