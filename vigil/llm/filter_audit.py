"""Interaction audit of quality filters through relations of failing ids.

Every filter leaves one table of the rows that fail it. What a filter removes after a set of
others is its table left-anti joined with theirs; what it would have removed but finds gone
already is the left-semi join; the survivors of a set are the failing rows that the anti join
leaves, and the rows that fail nothing. All sets of earlier filters are taken at once: a failing row is listed
once per set and meets the other relations by its row id, with "the other filter is in the
set" as the second join condition, so the relations are dealt by row id once. Counts per
(part, set, filter) are summed before they are shuffled; orders of filters are then looked up, since
what a step removes depends on the set before it only.

Defined results: a null text is empty; a null lang is the part ''; every row of ``docs`` is a
document of its own, also where a doc_id is null or repeated; a row is a later copy if a smaller
doc_id has its text (rows without a doc_id are never copies, and make none); a label of any row
of ``labels`` with the document's id counts; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import small, stored, text_or_empty

WORDS_LEAST = 100           # A
DISTINCT_PERCENT = 80       # B
CAPITALS_PERCENT = 10       # C
SYMBOLS = "[#$%&*|]"        # D
COPIES = "E"                # not a row filter: needs the whole table
COPY_SALTS = 16             # tasks that the rows of one copied text are dealt to, where they must be shuffled

STATISTICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides."""
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < WORDS_LEAST, "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n,
            "C": 100 * capitals > CAPITALS_PERCENT * F.length(text), "D": text.rlike(SYMBOLS)}


def later_copies(rows: DataFrame) -> DataFrame:
    """``row`` of every row whose text (by its digest) a smaller doc_id has."""
    known = rows.filter(F.col("doc_id").isNotNull())
    first = (known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
             .filter(F.col("last") > F.col("first")).select("digest", "first"))
    first = stored(first, "copied-texts")
    marked = small(first)
    if marked is not first:
        return known.join(marked, "digest").filter(F.col("doc_id") > F.col("first")).select("row")
    # one text may be a third of all rows, so its rows are dealt to several tasks
    salt = F.pmod(F.xxhash64("row"), F.lit(COPY_SALTS)).cast("int")
    spread = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(COPY_SALTS - 1))))
    return (known.withColumn("salt", salt).join(spread, ["digest", "salt"])
            .filter(F.col("doc_id") > F.col("first")).select("row"))


def failing_relations(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(every document's row, part and labels; filter letter -> (row, part, good, toxic) of the rows that fail it)."""
    text = text_or_empty()
    lit = {k: F.coalesce(c, F.lit(False)) for k, c in text_filters(F.col("text")).items()}
    # row numbers are stored with the rows, so they are the same for every use
    rows = (docs.select("doc_id", text.alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
            .select(F.monotonically_increasing_id().alias("row"), "doc_id", "part",
                    F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), *[c.alias(f"fails_{k}") for k, c in lit.items()]))
    rows = stored(rows, "audited-rows")
    marks = (labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    every = (rows.join(marks, "doc_id", "left")
             .select("row", "part", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")],
                     *[f"fails_{k}" for k in lit]))
    every = stored(every, "audited-labels")
    columns = ["row", "part", "good", "toxic"]
    failing = {k: every.filter(f"fails_{k}").select(*columns) for k in lit}
    failing[COPIES] = every.join(later_copies(rows), "row", "left_semi").select(*columns)
    return every.select(*columns), {k: stored(f, f"failing-{k}") for k, f in failing.items()}


def _sets(letters: list[str], without: str | None = None) -> list[int]:
    """Bit sets of filters that do not hold ``without``."""
    own = 1 << letters.index(without) if without is not None else 0
    return [s for s in range(1 << len(letters)) if not s & own]


def set_statistics(documents: DataFrame, failing: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(part, set, filter, removed, redundant, good_lost, toxic_lost) and (part, set, kept)."""
    letters = sorted(failing)
    tagged = None
    for k in letters:
        own = failing[k].select(F.lit(1 << letters.index(k)).alias("bit"), "*")
        tagged = own if tagged is None else tagged.unionByName(own)
    width = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = tagged.repartition(width, "row")       # the only shuffle of the relations: the joins below keep it
    others = tagged.select(F.col("row").alias("other"), F.col("bit").alias("other_bit"))
    earlier = F.explode(F.filter(F.array(*[F.lit(s) for s in _sets(letters)]), lambda s: s.bitwiseAND(F.col("bit")) == 0))
    steps = tagged.select("*", earlier.alias("set"))
    gone = (F.col("row") == F.col("other")) & (F.col("set").bitwiseAND(F.col("other_bit")) != 0)
    here = steps.join(others, gone, "left_anti").groupBy("part", "set", "bit").agg(
        F.count(F.lit(1)).alias("removed"), F.count(F.when(F.col("good"), 1)).alias("good_lost"),
        F.count(F.when(F.col("toxic"), 1)).alias("toxic_lost"))
    before = steps.join(others, gone, "left_semi").groupBy("part", "set", "bit").agg(F.count(F.lit(1)).alias("redundant"))
    by_step = here.join(before, ["part", "set", "bit"], "full")

    clean = documents.join(others, F.col("row") == F.col("other"), "left_anti").groupBy("part").agg(F.count(F.lit(1)).alias("clean"))
    once = tagged.groupBy("row").agg(F.first("part").alias("part"))
    after = once.select("*", F.explode(F.array(*[F.lit(s) for s in _sets(letters)])).alias("set"))
    left = after.join(others, gone, "left_anti").groupBy("part", "set").agg(F.count(F.lit(1)).alias("spared"))
    parts = documents.select("part").distinct()
    sets = parts.select("part", F.explode(F.array(*[F.lit(s) for s in _sets(letters)])).alias("set"))
    kept = (sets.join(left, ["part", "set"], "left").join(clean, "part", "left")
            .select("part", "set", (F.coalesce("spared", F.lit(0)) + F.coalesce("clean", F.lit(0))).alias("kept")))
    return by_step, kept


def audit_filters(spark: SparkSession, documents: DataFrame, failing: Mapping[str, DataFrame]) -> DataFrame:
    """One row per part, order of the filters and step; ``documents`` and the relations as of ``failing_relations``."""
    letters = sorted(failing)
    n = len(letters)
    by_step, kept = set_statistics(documents, failing)
    by_step, kept = stored(by_step, "audit-steps"), stored(kept, "audit-kept")
    rows = []
    for order in permutations(letters):
        before = 0
        for i, k in enumerate(order):
            bit = 1 << letters.index(k)
            rows.append(("".join(order), i + 1, before, bit, before | bit))
            before |= bit
    # n * n! rows: a number fixed by the filters, not by the data
    orders = spark.createDataFrame(rows, "filter_order string, step int, set int, bit int, after int")
    bits = F.array(*[F.lit(1 << i) for i in range(n)])
    cells = (kept.select("part", "set").select("part", "set", F.explode(bits).alias("bit"))
             .filter(F.col("set").bitwiseAND(F.col("bit")) == 0))
    counts = cells.join(by_step, ["part", "set", "bit"], "left").na.fill(0)
    others = F.lit((1 << n) - 1) - F.col("bit")
    ways = F.element_at(F.array(*[F.lit(factorial(i) * factorial(n - 1 - i)) for i in range(n)]), F.bit_count("set") + 1)
    overall = counts.groupBy("part", "bit").agg(
        F.sum(F.when(F.col("set") == others, F.col("removed")).otherwise(0)).alias("unique_fails"),
        F.sum(F.col("removed") * ways).alias("shapley"))
    return (counts.join(overall, ["part", "bit"]).join(F.broadcast(orders), ["set", "bit"])
            .join(kept.select("part", F.col("set").alias("after"), "kept"), ["part", "after"])
            .select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in STATISTICS]))
