"""Best-fit decreasing packing of documents into fixed-length sequences.

Best-fit decreasing looks only at lengths, and lengths are integers from 1 to
the capacity. So the placement is decided once over the histogram of lengths
(at most ``capacity`` rows, whatever the corpus size): documents of one length
are placed in runs, each run into bins of one remaining capacity, which a segment
tree over the remaining capacities finds in logarithmic time. The decision is a
list of intervals (length, rank range -> bin range, offset); every piece gets its
rank among the pieces of its length by distributed counting and looks up its
interval. This is the exact best-fit-decreasing packing of the whole corpus.

Defined results: null text counts as empty (one end id); an empty table gives no
rows; repeated rows are packed once each; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import offsets_before, release_memory, small, stored, text_or_empty
from vigil.llm.tokens import CACHE_CHUNKS, chunk_tokenizer

CAPACITY = 4096
PIECE_SCHEMA = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
                "shard int, rank_in_shard long")
ARROW_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                         ("length", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32()),
                         ("rank_in_shard", pa.int64())])


class OpenBins:
    """Open bins by remaining capacity, with a segment tree to find the tightest fit."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.filled = np.zeros(2 * self.size, dtype=bool)
        self.runs: dict[int, list[tuple[int, int]]] = {}   # remaining -> [(first bin, number of bins)]

    def tightest(self, need: int) -> int:
        """Smallest remaining capacity >= need that has an open bin, or -1."""
        node = need + self.size
        if self.filled[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.filled[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.filled[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return -1

    def add(self, remaining: int, first: int, count: int) -> None:
        if remaining <= 0 or count <= 0:
            return
        self.runs.setdefault(remaining, []).append((first, count))
        self._set(remaining, True)

    def take(self, remaining: int, most: int) -> tuple[int, int]:
        """Up to ``most`` bins of this remaining capacity, consecutive in number."""
        first, count = self.runs[remaining].pop()
        if count > most:
            self.runs[remaining].append((first + most, count - most))
            count = most
        if not self.runs[remaining]:
            del self.runs[remaining]
            self._set(remaining, False)
        return first, count

    def _set(self, remaining: int, value: bool) -> None:
        node = remaining + self.size
        self.filled[node] = value
        while node > 1:
            node //= 2
            self.filled[node] = self.filled[2 * node] or self.filled[2 * node + 1]


def best_fit_plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Best-fit decreasing over a length histogram.

    Returns ([(length, rank_from, rank_to, bin_from, per_bin, base_offset)], number of
    bins): the pieces of ``length`` with ranks in [rank_from, rank_to) go, ``per_bin`` at
    a time, to consecutive bins from ``bin_from``, the first at ``base_offset``.
    """
    bins, plan, used = OpenBins(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = bins.tightest(length)
            fresh = room < 0
            room = capacity if fresh else room
            per = room // length                # a bin that took one piece is the tightest for the next
            if left >= per:
                want = left // per
                first, count = (used, want) if fresh else bins.take(room, want)
                placed = count * per
                bins.add(room - per * length, first, count)
            else:
                first, count = (used, 1) if fresh else bins.take(room, 1)
                placed = left
                bins.add(room - left * length, first, 1)
            used += count if fresh else 0
            plan.append((length, rank, rank + placed, first, per, capacity - room))
            rank, left = rank + placed, left - placed
    return plan, used


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, keeps_blanks: bool,
               capacity: int = CAPACITY, added_tokens: bool = False, cache_chunks: int = CACHE_CHUNKS) -> DataFrame:
    """One row per piece of every document, with its rank among the shard's pieces of that length."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        tok = chunk_tokenizer(tokenizer_path, keeps_blanks, added_tokens, cache_chunks)
        shard, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):    # few texts at once as Python strings
                part = batch.slice(lo, 256)
                keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows = []
                for key, ids in zip(keys, tok.encode(texts)):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        n = len(part) // 4
                        rows.append((key, piece, at // 4, n, zlib.crc32(part), shard, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), ARROW_PIECE.types)], schema=ARROW_PIECE)
        if cache_chunks < CACHE_CHUNKS:     # memory is short: an idle worker must not hold the cache
            tok.forget()
            release_memory()

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(cut, PIECE_SCHEMA)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, keeps_blanks: bool = False,
                   capacity: int = CAPACITY, added_tokens: bool = False, cache_chunks: int = CACHE_CHUNKS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of ``docs``.

    ``added_tokens``: strings of added tokens in a text become their ids, as the library does by default.
    ``cache_chunks``: encoded chunks that a Python worker remembers; with fewer than the default it
    forgets them at the end of each task.
    """
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, tokenizer_path, end_id, keeps_blanks, capacity, added_tokens, cache_chunks), "pieces")
    per_shard = pieces.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in
                 per_shard.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    plan, _ = best_fit_plan(histogram, capacity)
    # a few rows per length, so the histogram's size bounds it; joined by shuffle beyond the common bound
    places = small(spark.createDataFrame(
        plan, "length long, rank_from long, rank_to long, bin_from long, per_bin long, base long"))
    ranked = (pieces.join(offsets_before(per_shard, "shard", "n", "earlier", ["length"]).drop("n"),
                          ["shard", "length"])
              .withColumn("rank", F.col("earlier") + F.col("rank_in_shard")).alias("p"))
    nth = F.col("rank") - F.col("rank_from")
    return (ranked.join(places.alias("q"), (F.col("p.length") == F.col("q.length"))
                        & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
            .select("doc_id", "piece", "start", F.col("p.length").alias("length"), "ids_crc32",
                    (F.col("bin_from") + F.floor(nth / F.col("per_bin"))).cast("long").alias("sequence_id"),
                    (F.col("base") + nth % F.col("per_bin") * F.col("p.length")).cast("long").alias("offset")))
