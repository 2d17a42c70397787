"""Near-duplicate documents by order MinHash, verified by banded alignment.

A document is its sequence of five-word shingles; a shingle that comes again is another
item (shingle, occurrence). Each of ``SKETCHES`` hash functions picks the ``PICKS`` items
with the smallest hashes and lists their shingles in text order, so a sketch agrees only
where shingles and their order agree. Documents that share a sketch are candidates. A
candidate pair is verified exactly: the items both hold are aligned in text order within
the band that a similar pair cannot leave, and the pair is linked when
aligned / (items of both - aligned) is at least ``THRESHOLD``. Linked documents form a group.

Exact copies (equal word sequences) are collapsed first, so a group of copies counts once.
In each sketch bucket every document is compared with the bucket's most central one (the one
that shares most buckets, so most likely the text the others were copied from); those that are
then still in another group than their buckets' pivots are compared with a pivot drawn anew in
every bucket. Documents of a bucket that are in different groups even so are compared pairwise,
where the parity bitmaps of their items allow the similarity at all. So no link between
different groups of a bucket is lost, and a large group costs a few comparisons per member.

Words are runs of letters, digits and non-ASCII characters, lower case. Defined results: null
text counts as empty; a document without words is in no group but its own; one with fewer than
five words has a single shingle of all its words; rows without a doc_id are kept and in no group;
rows that repeat a doc_id are versions of one document, each in the group of its own text, and
exact repeats are all kept or all not; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import small, stored, text_or_empty
from vigil.llm.groups import connected_components

WORDS = 5
THRESHOLD = 0.8
SKETCHES = 32
PICKS = 4
SEED = 77
PARITY_BITS = 512           # a bit per hash value of an item: set for an odd number of such items

# ASCII characters other than letters and digits end a word; capitals become small.
_WORD_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 1 << 16), _BASE, dtype=np.uint64)
        more[0] = 1
        _powers = np.cumprod(more)
    return _powers[:n]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word of the text, in order."""
    raw = np.frombuffer(text.lower().encode().translate(_WORD_BYTES), dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = raw != 32
    edges = np.flatnonzero(np.diff(inside))
    start, end = edges[0::2], edges[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    # polynomial of a word's bytes, counted back from its last byte: needs no division
    longest = int((end - start).max())
    power = _power_table(longest)
    place = np.repeat(end, end - start) - 1 - np.flatnonzero(inside[1:-1])
    terms = (raw[inside[1:-1].astype(bool)].astype(np.uint64) + np.uint64(1)) * power[place]
    sums = np.add.reduceat(terms, np.concatenate([[0], np.cumsum(end - start)[:-1]]))
    return _mix(sums)


def shingle_items(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(items, shingles): 64-bit hashes of (shingle, occurrence) and of the shingle, in text order."""
    if not len(words):
        return words, words
    n = max(1, len(words) - WORDS + 1)
    shingles = np.zeros(n, dtype=np.uint64)
    for i in range(min(WORDS, len(words))):
        shingles = _mix(shingles * np.uint64(_BASE) + words[i:i + n])
    order = np.argsort(shingles, kind="stable")
    held = shingles[order]
    first = np.concatenate([[True], held[1:] != held[:-1]])
    if first.all():
        return shingles, shingles
    run = np.flatnonzero(first)
    nth = np.arange(n) - np.repeat(run, np.diff(np.append(run, n)))
    occurrence = np.empty(n, dtype=np.uint64)
    occurrence[order] = nth.astype(np.uint64)
    items = np.where(occurrence == 0, shingles, _mix(shingles ^ (occurrence * np.uint64(0xD6E8FEB86659FD93))))
    return items, shingles


def sketch(items: np.ndarray, shingles: np.ndarray, factors: np.ndarray, picks: int) -> np.ndarray:
    """One 64-bit value per hash function: its smallest items' shingles in text order.

    The shortest documents, where hashes would miss too often, also get every choice of ``picks`` items.
    """
    n = len(items)
    if n <= picks:
        chosen = np.broadcast_to(np.arange(n), (len(factors), n))
    else:
        chosen = np.empty((len(factors), picks), dtype=np.int64)
        step = max(1, 262_144 // n)
        for at in range(0, len(factors), step):
            hashes = items[None, :] * factors[at:at + step, None]
            chosen[at:at + step] = np.argpartition(hashes, picks - 1, axis=1)[:, :picks]
        chosen.sort(axis=1)
    value = np.zeros(len(factors), dtype=np.uint64)
    for i in range(chosen.shape[1]):
        value = _mix(value * np.uint64(_BASE) + shingles[chosen[:, i]])
    if picks <= n <= picks + 1:
        value = np.concatenate([value, _without_one(shingles, picks)])
    return value


def _without_one(shingles: np.ndarray, picks: int) -> np.ndarray:
    """One value per place left out of ``picks`` + 1 items; ``picks`` items have theirs at every place."""
    value = np.zeros(picks + 1, dtype=np.uint64)
    for i in range(picks):
        at = i + (np.arange(picks + 1) <= i) if len(shingles) > picks else np.full(picks + 1, i)
        value = _mix(value * np.uint64(_BASE) + shingles[at])
    return value


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Most items of ``a`` and ``b`` (distinct within each) that align in order within the band."""
    common, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(at_a - at_b) <= band
    order = np.argsort(at_a[near], kind="stable")
    line = at_b[near][order]
    if len(line) < 2 or (np.diff(line) > 0).all():
        return len(line)
    ends: list[int] = []                        # ends[i]: smallest end of an ascending run of i + 1
    for x in line.tolist():
        at = bisect_left(ends, x)
        if at == len(ends):
            ends.append(x)
        else:
            ends[at] = x
    return len(ends)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """aligned / (all - aligned) of two item sequences; 0 when they cannot reach the threshold."""
    total = len(a) + len(b)
    band = int(total * (1 - threshold) / (1 + threshold) + 1e-9)    # items a similar pair may leave unaligned
    if not len(a) or not len(b) or abs(len(a) - len(b)) > band:
        return 0.0
    both = aligned(a, b, band)
    return both / (total - both)


def sketch_documents(docs: DataFrame, sketches: int = SKETCHES, picks: int = PICKS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_items, copy_a, copy_b, sketch array, parity array).

    copy_* is a 128-bit hash of the word sequence, ``parity`` the bitmap of its items in longs.
    """
    factors = np.random.default_rng(seed).integers(1, 2 ** 63, sketches, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                n_items, copies, values, parity = [], ([], []), [], []
                for text in part.column(1).to_pylist():
                    words = word_hashes(text)
                    items, shingles = shingle_items(words)
                    n_items.append(len(items))
                    place = np.arange(1, len(words) + 1, dtype=np.uint64)
                    for i, c in enumerate(copies):
                        total = _mix(words + place * np.uint64(_BASE + 2 * i)).sum(dtype=np.uint64)
                        c.append(int(total.astype(np.int64)))
                    odd = np.bincount((items >> np.uint64(20)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) % 2
                    parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                    values.append(sketch(items, shingles, factors, picks).view(np.int64) if len(items) else empty)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_items, pa.int64()), pa.array(copies[0], pa.int64()),
                     pa.array(copies[1], pa.int64()), pa.array(values, pa.list_(pa.int64())),
                     pa.array(parity, pa.list_(pa.int64()))],
                    ["doc_id", "n_items", "copy_a", "copy_b", "sketch", "parity"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, n_items long, copy_a long, copy_b long, sketch array<long>, parity array<long>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The (left, right) rows of ``pairs`` whose texts align to the threshold; texts: (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, items = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                keep = []
                for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if a != last:               # rows come sorted by left
                        last, items = a, shingle_items(word_hashes(a))[0]
                    keep.append(similarity(items, shingle_items(word_hashes(b))[0], threshold) >= threshold)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["left", "right"]).filter(
                    pa.array(keep, pa.bool_()))

    left = texts.select(F.col("doc_id").alias("left"), F.col("text").alias("left_text"))
    right = texts.select(F.col("doc_id").alias("right"), F.col("text").alias("right_text"))
    return (pairs.join(right, "right").join(left, "left")
            .select("left", "right", "left_text", "right_text").mapInArrow(run, "left long, right long").distinct())


def similar_lengths(a, b, threshold: float):
    """What any pair at the threshold fulfils: no sequence is shorter than threshold times the other."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(threshold - 1e-9)


def shared_buckets(distinct: DataFrame) -> DataFrame:
    """(h, value, doc_id, n_items, central) of buckets with several documents.

    ``central``: how many documents the document meets in all its buckets.
    """
    buckets = distinct.select("doc_id", "n_items", F.posexplode("sketch").alias("h", "value"))
    sizes = buckets.groupBy("h", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    shared = stored(buckets.join(sizes, ["h", "value"]), "buckets")
    central = shared.groupBy("doc_id").agg(F.sum("n").alias("central"))
    return stored(shared.drop("n").join(central, "doc_id"), "buckets")


def _in_groups(shared: DataFrame, groups: DataFrame | None) -> DataFrame:
    if groups is None:
        return shared.withColumn("component", F.col("doc_id"))
    return (shared.join(groups, F.col("doc_id") == F.col("node"), "left")
            .withColumn("component", F.coalesce("component", "doc_id")).drop("node"))


def pivot_pairs(shared: DataFrame, groups: DataFrame | None, order: Column, threshold: float) -> DataFrame:
    """(left, right): every document with its buckets' first one by ``order``, if in another group."""
    placed = _in_groups(shared, groups)
    first = placed.groupBy("h", "value").agg(F.min(F.struct(order.alias("o"), "doc_id", "n_items", "component")).alias("p"))
    pivots = first.select("h", "value", F.col("p.doc_id").alias("pivot"), F.col("p.n_items").alias("pivot_items"),
                          F.col("p.component").alias("pivot_component"))
    return (placed.join(pivots, ["h", "value"])
            .filter((F.col("component") != F.col("pivot_component"))
                    & similar_lengths(F.col("pivot_items"), F.col("n_items"), threshold))
            .select(F.least("pivot", "doc_id").alias("left"), F.greatest("pivot", "doc_id").alias("right")).distinct())


def rest_pairs(shared: DataFrame, groups: DataFrame, distinct: DataFrame, threshold: float) -> DataFrame:
    """Pairs of one bucket that are in different groups and that lengths and bitmaps do not rule out.

    A pair that meets in several buckets comes from the first of them.
    """
    placed = _in_groups(shared, groups)
    split = (placed.groupBy("h", "value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .filter(F.col("lo") != F.col("hi")).select("h", "value"))
    left_over = stored(placed.join(split, ["h", "value"], "left_semi")
                       .join(distinct.select("doc_id", "sketch", "parity"), "doc_id"), "open-buckets")
    a, b = left_over.alias("a"), left_over.alias("b")
    odd = sum((F.bit_count(F.get("a.parity", i).bitwiseXOR(F.get("b.parity", i))) for i in range(PARITY_BITS // 64)), F.lit(0))
    unaligned = (F.col("a.n_items") + F.col("b.n_items")) * ((1 - threshold) / (1 + threshold)) + 1e-6
    meet = F.array_position(F.zip_with("a.sketch", "b.sketch", lambda x, y: x == y), True) - 1
    return (a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.value") == F.col("b.value"))
                   & (F.col("a.doc_id") < F.col("b.doc_id")) & (F.col("a.component") != F.col("b.component"))
                   & similar_lengths(F.col("a.n_items"), F.col("b.n_items"), threshold) & (odd <= unaligned)
                   & (F.col("a.h") == meet))
            .select(F.col("a.doc_id").alias("left"), F.col("b.doc_id").alias("right")).distinct())


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, sketches: int = SKETCHES,
                    picks: int = PICKS) -> DataFrame:
    """(doc_id, class_id, class_size, keep) for every row: class_id is the smallest doc_id of its
    group, ``keep`` is true on that document."""
    rows = stored(sketch_documents(docs, sketches, picks), "sketches")
    taking_part = rows.filter((F.col("n_items") > 0) & F.col("doc_id").isNotNull())
    distinct = stored(taking_part.groupBy("copy_a", "copy_b")
                      .agg(F.min(F.struct("doc_id", "n_items", "sketch", "parity")).alias("r"))
                      .select("copy_a", "copy_b", "r.*"), "distinct-texts")
    shared = shared_buckets(distinct)
    # Texts of the documents that share a bucket with another text.
    texts = stored(docs.select("doc_id", text_or_empty().alias("text"))
                   .join(small(stored(shared.select("doc_id").distinct(), "sharing")), "doc_id", "left_semi"),
                   "candidate-texts")
    groups = None
    for order in (-F.col("central"), F.xxhash64("doc_id", "h"), None):
        pairs = (pivot_pairs(shared, groups, order, threshold) if order is not None
                 else rest_pairs(shared, groups, distinct, threshold))
        links = stored(verified(stored(pairs, "pairs"), texts, threshold), "links")
        if groups is not None:
            links = groups.select(F.col("node").alias("left"), F.col("component").alias("right")).unionByName(links)
        groups = connected_components(links)

    per_text = (distinct.select("copy_a", "copy_b", F.col("doc_id").alias("node")).join(groups, "node", "left")
                .select("copy_a", "copy_b", F.coalesce("component", "node").alias("component")))
    placed = rows.select("doc_id", "copy_a", "copy_b", (F.col("n_items") > 0).alias("worded")).join(
        per_text.withColumn("worded", F.lit(True)), ["copy_a", "copy_b", "worded"], "left")
    placed = placed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component"))
    sizes = (placed.filter(F.col("component").isNotNull()).groupBy("component").agg(F.count(F.lit(1)).alias("class_size")))
    return (placed.join(sizes, "component", "left")
            .select("doc_id", F.coalesce("component", "doc_id").alias("class_id"),
                    F.coalesce("class_size", F.lit(1)).alias("class_size"))
            .withColumn("keep", F.col("doc_id").eqNullSafe(F.col("class_id"))))
