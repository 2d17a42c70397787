"""What the two vector searches share: valid rows, index shards, query blocks, the final merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import stored

QUERY_EVERY = 100       # rows whose id is divisible by this are the queries
QUERY_BLOCK = 1024      # queries a task holds at once
SHARD_ROWS = 16_384     # vectors an index row holds


def valid_vectors(vectors: DataFrame, drop_zero: bool) -> DataFrame:
    """(vec_id, vec array<double>) without null ids, null vectors, and null or non-finite components.

    Vectors whose length is not the commonest one (the longer on ties) take no part either:
    no measure is defined between different lengths. ``drop_zero`` leaves out zero vectors. Of
    rows with the same vec_id the one with the smallest vector takes part.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                       F.col("embedding").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & finite)
    if drop_zero:
        v = v.filter(F.exists("vec", lambda x: x != 0))
    sizes = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    v = v.filter(F.size("vec") == (sizes[0]["n"] if sizes else 0))
    return v.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def shard_rows(batches: Iterator[pa.RecordBatch], rows: int = SHARD_ROWS) -> Iterator[tuple]:
    """(ids, float64 matrix) of at most ``rows`` vectors each, from (vec_id, vec) batches."""
    ids, mats, held = [], [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ids.append(part.column(0).to_numpy(zero_copy_only=False))
            mats.append(flat.reshape(part.num_rows, -1))
            held += part.num_rows
            if held >= rows:
                all_ids, all_rows = np.concatenate(ids), np.concatenate(mats)
                yield all_ids[:rows], all_rows[:rows]
                ids, mats, held = [all_ids[rows:]], [all_rows[rows:]], held - rows
    if held:
        yield np.concatenate(ids), np.concatenate(mats)


def query_blocks(vectors: DataFrame, every: int = QUERY_EVERY, block: int = QUERY_BLOCK) -> DataFrame:
    """(n, ids, vectors): the queries, the rows whose vec_id is divisible by ``every``, in packed blocks."""
    queries = vectors.filter(F.col("vec_id") % every == 0).select("vec_id", "vec")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, matrix in shard_rows(batches, block):
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(ids)], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                 pa.array([matrix.astype("<f8").tobytes()], pa.binary())], ["n", "ids", "vectors"])

    width = max(1, -(-queries.count() // block))
    return stored(queries.repartition(width).mapInArrow(build, "n int, ids binary, vectors binary"), "query-blocks")


def search_all(index: DataFrame, vectors: DataFrame, schema: str, search: Callable[[dict, np.ndarray, np.ndarray], Iterator[tuple]],
               every: int, block: int) -> DataFrame:
    """``search(shard, query ids, query matrix)`` -> (own id, found ids, scores) of each query, for all shards and blocks at once."""
    types = [pa.float64() if f.split()[1] == "double" else pa.int64() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                shard, held = (batch.column(c)[r].as_py() for c in (0, 1))
                ids = np.frombuffer(held["ids"], "<i8")
                parts = list(search(shard, ids, np.frombuffer(held["vectors"], "<f8").reshape(held["n"], -1)))
                columns = (np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]),
                           *(np.concatenate([p[k] for p in parts]) for k in (1, 2)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)],
                                                 [f.split()[0] for f in schema.split(", ")])

    return meet(index, query_blocks(vectors, every, block)).mapInArrow(run, schema)


def best_per_query(found: DataFrame, k: int, descending: bool) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of the shards' own k best, ties to the smaller vec_id."""
    order = F.desc("score") if descending else F.asc("score")
    w = Window.partitionBy("query_id").orderBy(order, "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def meet(shards: DataFrame, blocks: DataFrame) -> DataFrame:
    """(shard, block): a stated set of query blocks against all index shards, in one equi-join.

    ``shards`` has a ``slot``, the task that wrote it; a copy of every block goes to each slot.
    """
    last = shards.agg(F.max("slot")).first()[0]
    dealt = shards.select("slot", F.struct(*[c for c in shards.columns if c != "slot"]).alias("shard"))
    spread = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(last or 0))).alias("slot"), F.struct("*").alias("block"))
    return dealt.join(spread, "slot").select("shard", "block")
