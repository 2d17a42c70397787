"""Approximate nearest neighbours with a forest of hash-prefix trees.

Every tree hashes a vector to a long string of sign bits of random projections and keeps
the strings as a sorted array, so the vectors that share a prefix of any length are one
run of it. A query descends each tree to its longest matching prefix by binary search,
then all trees ascend together, one bit at a time, until the runs together hold enough
candidates; those are measured exactly. The index is cut into shards of bounded rows,
each with its own forest, and every row is indexed; shards give their own k nearest, the k
nearest of those are the answer.

Nearness is the Euclidean distance in double precision. Trees of sign bits follow angles,
which order vectors as distances do when norms are alike. ``share`` is the part of a
shard's rows that the runs must hold together before the ascent ends (``LEAST`` rows at
least); data without clusters needs a large one.

Defined results: vectors that are null, zero, hold null or non-finite components, or differ
in length from the rest take no part; rows with the query's own vec_id are not its
candidates, of rows with the same vec_id one takes part (the smallest vector); fewer than k candidates give fewer rows; an empty table gives none; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from vigil.llm.common import stored
from vigil.llm.vectors import (QUERY_BLOCK, QUERY_EVERY, SHARD_ROWS, best_per_query, search_all, shard_rows,
                               valid_vectors)

TREES = 40
BITS = 32                   # length of a hash string
SHARE = 0.6
LEAST = 2000                # candidates the runs hold together at least, in shards that have them
SEED = 20240229
INDEX_SCHEMA = "slot int, n int, ids binary, vectors binary, strings binary, places binary"


@lru_cache(maxsize=4)
def projections(dim: int, trees: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, trees * bits))


def hash_strings(matrix: np.ndarray, trees: int, bits: int, seed: int) -> np.ndarray:
    """(trees, rows) hash strings as integers, first bit highest."""
    out = np.empty((trees, len(matrix)), dtype=np.uint64)
    weights = np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)
    planes = projections(matrix.shape[1], trees, bits, seed)
    for t in range(trees):
        out[t] = ((matrix @ planes[:, t * bits:(t + 1) * bits]) > 0) @ weights
    return out


def build_forest(vectors: DataFrame, trees: int = TREES, bits: int = BITS, seed: int = SEED,
                 rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: ids, vectors, and per tree the sorted strings with their rows' places."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, matrix in shard_rows(batches, rows):
            strings = hash_strings(matrix, trees, bits, seed)
            places = np.argsort(strings, axis=1, kind="stable")
            strings = np.take_along_axis(strings, places, axis=1)
            row = (ids.astype("<i8"), matrix.astype("<f8"), strings.astype("<u8"), places.astype("<u2" if rows <= 65536 else "<u4"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([len(ids)], pa.int32()),
                 *[pa.array([a.tobytes()], pa.binary()) for a in row]], ["slot", "n", "ids", "vectors", "strings", "places"])
    return stored(vectors.mapInArrow(build, INDEX_SCHEMA), "prefix-forest")


def prefix_runs(strings: np.ndarray, queries: np.ndarray, bits: int, enough: float) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every query's run in every tree, at the longest common prefix length where
    the runs of all trees together hold at least ``enough`` rows."""
    trees, n_queries = queries.shape
    start, end = np.zeros((trees, n_queries), dtype=np.int64), np.zeros((trees, n_queries), dtype=np.int64)
    waiting = np.arange(n_queries)
    for length in range(bits, -1, -1):
        rest = np.uint64((1 << (bits - length)) - 1)
        for t in range(trees):
            q = queries[t, waiting]
            start[t, waiting] = np.searchsorted(strings[t], q & ~rest, side="left")
            end[t, waiting] = np.searchsorted(strings[t], q | rest, side="right")
        held = (end[:, waiting] - start[:, waiting]).sum(axis=0)
        waiting = waiting[held < enough]
        if not len(waiting):
            break
    return start, end


def nearest_in_shard(ids, matrix, strings, places, query_ids, queries, query_strings, bits, k, share):
    start, end = prefix_runs(strings, query_strings, bits, max(k + 1, LEAST, share * len(ids)))
    chosen = np.zeros(len(ids), dtype=bool)
    for q, own in enumerate(query_ids):
        chosen[:] = False
        for t in range(len(strings)):
            chosen[places[t, start[t, q]:end[t, q]]] = True
        rows = np.flatnonzero(chosen & (ids != own))
        gap = matrix[rows] - queries[q]
        score = np.sqrt((gap * gap).sum(axis=1))
        if len(rows) > k:
            near = score <= np.partition(score, k - 1)[k - 1]
            rows, score = rows[near], score[near]
        best = np.lexsort((ids[rows], score))[:k]
        yield own, ids[rows[best]], score[best]


def forest_neighbours(spark: SparkSession, vectors: DataFrame, k: int = 10, every: int = QUERY_EVERY,
                      trees: int = TREES, bits: int = BITS, share: float = SHARE, seed: int = SEED,
                      rows: int = SHARD_ROWS, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every query."""
    valid = stored(valid_vectors(vectors, drop_zero=True), "valid-vectors")
    index = build_forest(valid, trees, bits, seed, rows)

    def search(shard: dict, query_ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple]:
        n = shard["n"]
        return nearest_in_shard(
            np.frombuffer(shard["ids"], "<i8"), np.frombuffer(shard["vectors"], "<f8").reshape(n, -1),
            np.frombuffer(shard["strings"], "<u8").reshape(trees, n),
            np.frombuffer(shard["places"], "<u2" if rows <= 65536 else "<u4").reshape(trees, n),
            query_ids, queries, hash_strings(queries, trees, bits, seed), bits, k, share)

    found = search_all(index, valid, "query_id long, vec_id long, score double", search, every, block)
    return best_per_query(found, k, descending=False)
