"""Hard-negative mining over an inverted multi-index.

Rows are filed under the cells of a product grid of two half-space codebooks. For an anchor a, no row
of cell (i, j) scores more than a1 . c_i + |a1| r_i + a2 . c_j + |a2| r_j, with a shard's own radius
r of every code. A heap hands out the cells in the order of these sums, and their rows are scored exactly, until
the next bound is below what is still looked for: for positives the k-th best score; for negatives, in
every window of every positive, its lower end or the k-th best score already in it. What a search
returns is therefore certain. Shards give their own best, the best of those are the answer.

Anchors go in blocks, as one table, and meet every shard in one join (``meet``); nothing is collected.

Defined results: components are floor(scale * x); rows without id, label or vector, with null or
non-finite components, or of another length than most, take no part, nor do those with a component
beyond ``largest`` after scaling (their scores need not fit a long); of rows with the same vec_id the one with
the smallest (label, vector) takes part; an anchor's own vec_id is never its positive or negative; a
negative positive_score has an empty window; fewer candidates give fewer rows; an empty table gives
none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import stored
from vigil.llm.multi_index import (MultiIndex, codes_for, commonest_length, is_vector, matrix_of, multi_sequence,
                                   sampled)
from vigil.llm.vectors import meet

ANCHOR_EVERY = 100
SCALE = 256
POSITIVES = 5
NEGATIVES = 5
WINDOW = (80, 100)          # percent of the positive's score, both ends within
SHARD_ROWS = 16_384
BLOCK = 256                 # anchors that a task holds at once
READ_AT_ONCE = 512          # rows scored between two looks at the bound
BITS = 62                   # that a sum of products may have

SHARD = "slot int, n int, ids binary, labels binary, rows binary, cells binary, starts binary, first binary, second binary"
BLOCKS = "n int, ids binary, labels binary, vectors binary, wanted binary"
FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def largest(dimensions: int) -> int:
    """The largest size of a component for which every inner product fits a long."""
    return min(int((2 ** BITS / max(dimensions, 1)) ** 0.5), 2 ** 31 - 1)


def integer_rows(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, vec array<int>) of the rows that take part, one per vec_id."""
    vec = F.col("vec")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.col("embedding").cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & is_vector(vec))
    length = commonest_length(rows)
    whole = F.transform(vec, lambda x: F.floor(x * F.lit(float(scale)) + F.lit(0.0)))
    near = F.forall(vec, lambda x: F.abs(x) < F.lit(largest(length) / scale))
    rows = rows.filter((F.size("vec") == length) & near).select("vec_id", "label", whole.cast("array<int>").alias("vec"))
    return (rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r"))
            .select("vec_id", "r.label", "r.vec"))


def packed(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    batch = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
    return (batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False),
            matrix_of(batch.column(2), batch.num_rows))


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            held.append(batch.slice(at, most))
            if sum(b.num_rows for b in held) >= most:
                yield held
                held = []
    if held:
        yield held


def build_shards(rows: DataFrame, index: MultiIndex, n: int) -> DataFrame:
    """Shards of about ``SHARD_ROWS`` rows of neighbouring cells, each with its codes' radii."""
    codes = index.sizes[1]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = index.cells(matrix_of(batch.column(2), batch.num_rows))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], ["vec_id", "label", "vec", "cell"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(batches, SHARD_ROWS):
            ids, labels, matrix = packed(held)
            home = index.cells(matrix)
            cells, starts = np.unique(home, return_index=True)      # rows come sorted by cell
            one, two = index.half_gaps(matrix)
            at = np.arange(len(ids))
            radii = []
            for gaps, code in ((one, home // codes), (two, home % codes)):
                reach = np.full(gaps.shape[1], -1.0)                # -1: no row of this shard has the code
                np.maximum.at(reach, code, np.sqrt(gaps[at, code]))
                radii.append(reach)
            row = (ids.astype("<i8"), labels.astype("<i8"), matrix.astype("<i4"), cells.astype("<i4"),
                   np.append(starts, len(ids)).astype("<i4"), *(r.astype("<f8") for r in radii))
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([len(ids)], pa.int32()),
                 *[pa.array([x.tobytes()], pa.binary()) for x in row]], [c.split()[0] for c in SHARD.split(", ")])

    ordered = rows.mapInArrow(coded, "vec_id long, label long, vec array<int>, cell int").repartitionByRange(
        max(1, -(-n // SHARD_ROWS)), "cell", "vec_id").sortWithinPartitions("cell", "vec_id")
    return stored(ordered.mapInArrow(build, SHARD), "cell-shards")


def anchor_blocks(anchors: DataFrame) -> DataFrame:
    """(vec_id, label, vec, wanted array of (positive_id, positive_score)) rows as blocks."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(batches, BLOCK):
            ids, labels, matrix = packed(held)
            wanted = [[(p["positive_id"], p["score"]) for p in w] for b in held for w in b.column(3).to_pylist()]
            most = max(map(len, wanted))
            table = np.zeros((len(ids), most, 3), dtype="<i8")      # 1 in the third place: a positive stands here
            for i, some in enumerate(wanted):
                for j, (positive, score) in enumerate(some):
                    table[i, j] = positive, score, 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(ids)], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (
                    ids.astype("<i8"), labels.astype("<i8"), matrix.astype("<i4"), table)]], [c.split()[0] for c in BLOCKS.split(", ")])
    return stored(anchors.mapInArrow(build, BLOCKS), "anchor-blocks")


class CellShard:
    """The rows of a shard by cell, and the cells in the order of their score bounds for an anchor."""

    def __init__(self, shard: dict, index: MultiIndex):
        n = shard["n"]
        self.index = index
        self.ids, self.labels = np.frombuffer(shard["ids"], "<i8"), np.frombuffer(shard["labels"], "<i8")
        self.rows = np.frombuffer(shard["rows"], "<i4").reshape(n, -1).astype(np.int64)
        cells, starts = np.frombuffer(shard["cells"], "<i4").tolist(), np.frombuffer(shard["starts"], "<i4").tolist()
        self.spans = {c: (lo, hi) for c, lo, hi in zip(cells, starts[:-1], starts[1:])}
        self.reach = np.frombuffer(shard["first"], "<f8"), np.frombuffer(shard["second"], "<f8")
        self.codes = [np.flatnonzero(r >= 0) for r in self.reach]
        # where no sum of products can leave the integers that doubles hold, scores are taken in doubles
        self.peak = int(np.abs(self.rows).max(initial=0))
        self.doubles = self.rows.astype(np.float64)

    def scores(self, places: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.peak * int(np.abs(anchor).max(initial=0)) * len(anchor) < 2 ** 53:
            return (self.doubles[places] @ anchor.astype(np.float64)).astype(np.int64)
        return self.rows[places] @ anchor

    def in_order(self, anchor: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(bound of what has not been handed out, places of rows handed out), best cells first."""
        cut = self.index.cut
        bounds = []
        for half, book, reach, codes in zip((anchor[:cut], anchor[cut:]), self.index.books, self.reach, self.codes):
            half = half.astype(np.float64)
            top = book[codes] @ half + np.sqrt(half @ half) * reach[codes]
            bounds.append(top + 1e-9 * (np.abs(book[codes]) @ np.abs(half) + np.abs(top)) + 1)      # rounding
        one, two = (c.tolist() for c in self.codes)
        held, count, last = [], 0, self.index.sizes[1]
        for bound, i, j in multi_sequence(*bounds):
            span = self.spans.get(one[i] * last + two[j])
            if span is None:
                continue
            if count >= READ_AT_ONCE:
                yield bound, np.concatenate(held)
                held, count = [], 0
            held.append(np.arange(*span))
            count += span[1] - span[0]
        yield -np.inf, np.concatenate(held) if held else np.zeros(0, dtype=np.int64)

    def best(self, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]

    def positives(self, own: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for bound, places in self.in_order(anchor):
            places = places[(self.labels[places] == label) & (self.ids[places] != own)]
            ids, scores = self.best(np.concatenate([ids, self.ids[places]]),
                                    np.concatenate([scores, self.scores(places, anchor)]), k)
            if len(ids) == k and bound < scores[-1]:
                break
        return ids, scores

    def negatives(self, own: int, label: int, anchor: np.ndarray, highs: list[int], window: tuple[int, int],
                  k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per positive score the k best rows of another label in its window."""
        ends = [(-(-window[0] * h // 100), window[1] * h // 100) for h in highs]
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(ends)
        waiting = [w for w, (lo, hi) in enumerate(ends) if lo <= hi]
        for bound, places in self.in_order(anchor) if waiting else ():
            places = places[(self.labels[places] != label) & (self.ids[places] != own)]
            scores, ids = self.scores(places, anchor), self.ids[places]
            for w in waiting:
                lo, hi = ends[w]
                inside = (scores >= lo) & (scores <= hi)
                if inside.any():
                    found[w] = self.best(np.concatenate([found[w][0], ids[inside]]),
                                         np.concatenate([found[w][1], scores[inside]]), k)
            waiting = [w for w in waiting if bound >= ends[w][0] and not (len(found[w][0]) == k and bound < found[w][1][-1])]
            if not waiting:
                break
        return found


def searched(shards: DataFrame, blocks: DataFrame, index: MultiIndex, k: int, window: tuple[int, int] | None) -> DataFrame:
    """``FOUND`` rows: every shard's k best positives of every anchor or, with a window, negatives of every positive."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                shard, block = CellShard(batch.column(0)[r].as_py(), index), batch.column(1)[r].as_py()
                n = block["n"]
                ids, labels = np.frombuffer(block["ids"], "<i8").tolist(), np.frombuffer(block["labels"], "<i8").tolist()
                vectors = np.frombuffer(block["vectors"], "<i4").reshape(n, -1).astype(np.int64)
                wanted = np.frombuffer(block["wanted"], "<i8").reshape(n, -1, 3) if block["wanted"] else np.zeros((n, 0, 3))
                out = []
                for own, label, anchor, pairs in zip(ids, labels, vectors, wanted):
                    if window is None:
                        out.append((own, None, None, *shard.positives(own, label, anchor, k)))
                    else:
                        pairs = [(p, s) for p, s, there in pairs.tolist() if there]
                        found = shard.negatives(own, label, anchor, [s for _, s in pairs], window, k)
                        out += [(own, p, s, *f) for (p, s), f in zip(pairs, found)]
                each = [len(o[3]) for o in out]
                if sum(each):
                    repeated = [pa.array([x for o, m in zip(out, each) for x in [o[c]] * m], pa.int64()) for c in range(3)]
                    yield pa.RecordBatch.from_arrays(
                        [*repeated, *[pa.array(np.concatenate([o[c] for o in out]), pa.int64()) for c in (3, 4)]],
                        [c.split()[0] for c in FOUND.split(", ")])
    return meet(shards, blocks).mapInArrow(run, FOUND)


def hard_negatives(spark: SparkSession, vectors: DataFrame, every: int = ANCHOR_EVERY, scale: int = SCALE,
                   positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive."""
    rows = stored(integer_rows(vectors, scale), "integer-rows")
    n = rows.count()
    result = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    index = MultiIndex(sampled(rows), codes_for(n))
    shards = build_shards(rows, index, n)
    anchors = rows.filter(F.col("vec_id") % every == 0)
    width = max(1, -(-n // (every * BLOCK)))
    none = F.array().cast("array<struct<positive_id: bigint, score: bigint>>").alias("wanted")
    first = anchor_blocks(anchors.select("vec_id", "label", "vec", none).repartition(width))
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    near = (searched(shards, first, index, positives, None).withColumn("place", F.row_number().over(best))
            .filter(F.col("place") <= positives).select("anchor_id", "vec_id", "score"))
    near = stored(near, "positives")
    wanted = near.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("vec_id").alias("positive_id"), "score")).alias("wanted"))
    second = anchor_blocks(anchors.join(wanted, F.col("vec_id") == F.col("anchor_id"))
                           .select("vec_id", "label", "vec", "wanted").repartition(width))
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    return (searched(shards, second, index, negatives, window).withColumn("rank", F.row_number().over(best).cast("int"))
            .filter(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")).select(*result))
