"""Embedding near-duplicates over an inverted multi-index.

Unit vectors are filed under the cells of a product grid of two half-space codebooks. Every vector
visits the cells nearest to it in multi-sequence order, as many as the target recall needs, and all
vectors filed there are verified by their cosine in double precision.

*Depth of the visit.* On the sample that the codebooks are fitted on, each vector gets a partner in a
random direction at exactly the link threshold, the farthest a link can be; the depth is the
``recall`` quantile of the place of the partner's cell. Closer pairs are found more often. A pair is
looked for from the side with the smaller cell (then the smaller ball), so it is met once.

*Balls.* Within a shard of a cell, vectors within a third of the link angle of a leader form a ball, so
any two of its members are linked. Balls, not vectors, are filed and compared: where the angle between
two leaders and the two radii settles all pairs at once, only sizes are added. Other pairs of balls are
compared member by member. A group of near copies of any size is thus a few balls, and no pairs
within a group are ever listed. Each comparison task hands on sums per ball and a spanning forest of its links.

*Hot cells.* Blocks of at most ``BLOCK`` balls of a first code meet blocks of visitors of that code; codes
with many blocks are dealt to a grid of tasks on both sides.

Defined results: every row is a vector of its own, also where a vec_id is repeated; vectors that are null,
empty, zero, hold null or non-finite components or differ in length from most link with nothing; rows
without a vec_id too, they come back with a null component_id and are kept; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import small, stored
from vigil.llm.groups import connected_components
from vigil.llm.multi_index import (SEED, MultiIndex, codes_for, commonest_length, component_type, is_vector, matrix_of,
                                   nearest_cells, sampled)

THRESHOLD = 0.9
RECALL = 0.99               # of pairs at exactly the threshold, by the depth of the visit
PARTNERS = 4096             # pairs that the depth is measured on
SHARD_ROWS = 16_384         # vectors of neighbouring cells that a task holds at once
RUN_ROWS = 4096             # vectors of one cell that balls are formed among
BLOCK = 1024                # balls that are compared at once
TASK_BLOCKS = 16            # blocks on either side that one task compares
SLACK = 1e-6                # radians by which a bound must settle a pair of balls

FILED = """kind string, row long, vec_id long, ball long, size long, least long, vec array<{kind}>,
code int, n int, balls binary, sizes binary, radii binary, leaders binary, homes binary, visited binary"""


def unit(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)     # no overflow in the squares
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def numbered_rows(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, vec, ok) of every row; row numbers are stored with the rows, so they stay."""
    kind = component_type(vectors)
    vec = F.col("vec")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vec"))
    valid = is_vector(vec) & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec", valid.alias("ok")), "vectors")
    return rows.withColumn("ok", F.col("ok") & (F.size("vec") == commonest_length(rows.filter("ok"))))


def visits_for(index: MultiIndex, vectors: np.ndarray, cosine: float, recall: float, seed: int = SEED) -> int:
    """Cells to visit so that a partner at exactly ``cosine`` is found with probability ``recall``."""
    if vectors.shape[1] < 2:
        return index.sizes[0] * index.sizes[1]
    vectors = np.resize(vectors, (PARTNERS, vectors.shape[1]))      # few vectors get several partners each
    away = np.random.default_rng(seed).standard_normal(vectors.shape)
    away = unit(away - (away * vectors).sum(axis=1, keepdims=True) * vectors)
    first, second = index.half_gaps(vectors)
    home = index.cells(cosine * vectors + np.sqrt(1 - cosine * cosine) * away)
    at = np.arange(len(vectors))
    gap = first[at, home // index.sizes[1]] + second[at, home % index.sizes[1]]
    second.sort(axis=1)
    before = [sum(np.searchsorted(s, g - x, side="left") for x in f) for f, s, g in zip(first, second, gap)]
    return int(np.quantile(before, recall, method="higher")) + 1


def form_balls(units: np.ndarray, cells: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """(leader's place, angle to the leader) of every row; rows are sorted by cell, balls stay within one."""
    leader, gap = np.arange(len(units)), np.zeros(len(units))
    cuts = np.flatnonzero(np.diff(cells)) + 1
    for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(cells)]])):
        for at in range(lo, hi, RUN_ROWS):
            own = units[at:min(at + RUN_ROWS, hi)]
            free = np.ones(len(own), dtype=bool)
            for i in range(len(own)):
                if free[i]:
                    cosine = own @ own[i]
                    taken = free & (cosine >= np.cos(angle))
                    taken[i] = True
                    free &= ~taken
                    leader[at:at + len(own)][taken] = at + i
                    gap[at:at + len(own)][taken] = np.arccos(np.minimum(cosine[taken], 1))
                    gap[at + i] = 0
    return leader, gap


def filed(rows: DataFrame, index: MultiIndex, n: int, visits: int, angle: float) -> DataFrame:
    """Member rows, blocks of filed balls by their first code, and blocks of visiting balls by the first code they visit."""
    kind = dict(rows.dtypes)["vec"][6:-1]
    exact = np.dtype("<f4" if kind == "float" else "<f8")
    schema = FILED.format(kind=kind)
    second = index.sizes[1]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = index.cells(unit(matrix_of(batch.column(2), batch.num_rows)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], ["row", "vec_id", "vec", "cell"])

    def blocks(what: str, codes, balls, sizes, radii, leaders, homes, masks) -> Iterator[pa.RecordBatch]:
        order = np.argsort(codes, kind="stable")
        cuts = np.flatnonzero(np.diff(codes[order])) + 1
        for some in np.split(order, cuts):
            for at in range(0, len(some), BLOCK):
                part = some[at:at + BLOCK]
                packed = [balls[part].astype("<i8"), sizes[part].astype("<i8"), radii[part].astype("<f8"),
                          leaders[part].astype(exact), homes[part].astype("<i4")]
                yield table(kind=[what], code=[codes[part[0]]], n=[len(part)], **dict(zip(
                    ("balls", "sizes", "radii", "leaders", "homes"), ([x.tobytes()] for x in packed))),
                    visited=[masks[part].tobytes() if masks is not None else b""])

    types = {"kind": pa.string(), "row": pa.int64(), "vec_id": pa.int64(), "ball": pa.int64(), "size": pa.int64(), "least": pa.int64(),
             "vec": pa.list_(pa.float32() if kind == "float" else pa.float64()), "code": pa.int32(), "n": pa.int32(),
             **dict.fromkeys(("balls", "sizes", "radii", "leaders", "homes", "visited"), pa.binary())}

    def table(**columns) -> pa.RecordBatch:
        rows = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([
            (columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], t)).cast(t) if c in columns else pa.nulls(rows, t)
            for c, t in types.items()], list(types))

    def shard(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = batch.num_rows
        row, vec_id, cells = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
        raw = matrix_of(batch.column(2), m)
        units = unit(raw)
        leader, gap = form_balls(units, cells, angle)
        heads, ball = np.unique(leader, return_inverse=True)
        sizes = np.bincount(ball)
        radii, least = np.zeros(len(heads)), np.full(len(heads), np.iinfo(np.int64).max)
        np.maximum.at(radii, ball, gap)
        np.minimum.at(least, ball, vec_id)
        names = row[heads]
        yield table(kind=["member"] * m, row=row, vec_id=vec_id, ball=names[ball], size=sizes[ball], least=least[ball],
                    vec=batch.column(2))
        yield from blocks("filed", cells[heads] // second, names, sizes, radii, raw[heads], cells[heads], None)
        pairs = []
        for at in range(0, m, 2048):
            part = slice(at, at + 2048)
            near = nearest_cells(*index.half_gaps(units[part]), visits)
            keep = near > cells[part, None]
            pairs.append(np.stack([np.repeat(ball[part], keep.sum(axis=1)), near[keep]]))
        pairs.append(np.stack([np.arange(len(heads)), cells[heads]]))      # its own cell, in any case
        who, cell = np.unique(np.concatenate(pairs, axis=1), axis=1)
        group, at = np.unique(who.astype(np.int64) * index.sizes[0] + cell // second, return_inverse=True)
        masks = np.zeros((len(group), second), dtype=bool)
        masks[at, cell % second] = True
        who, code = group // index.sizes[0], group % index.sizes[0]
        yield from blocks("visit", code, names[who], sizes[who], radii[who], raw[heads][who], cells[heads][who],
                          np.packbits(masks, axis=1))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SHARD_ROWS:
                yield from shard(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
        held = [b for b in held if b.num_rows]
        if held:
            yield from shard(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    cell_rows = rows.select("row", "vec_id", "vec").mapInArrow(coded, f"row long, vec_id long, vec array<{kind}>, cell int")
    parts = max(1, -(-n // SHARD_ROWS))
    ordered = cell_rows.repartitionByRange(parts, "cell", "row").sortWithinPartitions("cell", "row")
    return stored(ordered.mapInArrow(shards, schema), "filed-vectors")


def spanning_forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """(row, column) links that join what all of ``linked`` joins, at most rows + columns of them."""
    new_rows, new_columns = linked.any(axis=1), linked.any(axis=0)
    for start in np.flatnonzero(new_rows):
        if not new_rows[start]:
            continue
        new_rows[start] = False
        todo = [(start, True)]
        while todo:
            at, is_row = todo.pop()
            fresh = np.flatnonzero((linked[at] & new_columns) if is_row else (linked[:, at] & new_rows))
            (new_columns if is_row else new_rows)[fresh] = False
            for other in fresh.tolist():
                yield (at, other) if is_row else (other, at)
                todo.append((other, not is_row))


def compare(visit: dict, stay: dict, second: int, threshold: float) -> tuple[list, list, list]:
    """(balls and what each member of them gains, forest of links, pairs of balls to compare by member)."""
    met = visit["visited"][:, stay["homes"] % second]
    met &= (visit["homes"][:, None] < stay["homes"]) | (
        (visit["homes"][:, None] == stay["homes"]) & (visit["balls"][:, None] < stay["balls"]))
    rows, columns = np.flatnonzero(met.any(axis=1)), np.flatnonzero(met.any(axis=0))
    if not len(rows):
        return [], [], []
    met = met[np.ix_(rows, columns)]
    one = {k: v[rows] for k, v in visit.items()}
    two = {k: v[columns] for k, v in stay.items()}
    cosine = one["units"] @ two["units"].T
    spread = one["radii"][:, None] + two["radii"]
    linked = met & (cosine >= threshold)
    open_pairs = np.zeros_like(met)
    if spread.any():
        gap, most = np.arccos(np.clip(cosine, -1, 1)), np.arccos(threshold)
        wide = met & (spread > 0)
        linked = np.where(wide, gap + spread <= most - SLACK, linked)
        open_pairs = wide & ~linked & (gap - spread <= most + SLACK)
    gains = [(one["balls"], linked @ two["sizes"]), (two["balls"], one["sizes"] @ linked)]
    gains = [(int(b), int(g)) for balls, sums in gains for b, g in zip(balls, sums) if g]
    links = [(int(one["balls"][i]), int(two["balls"][j])) for i, j in spanning_forest(linked)]
    return gains, links, [(int(one["balls"][i]), int(two["balls"][j])) for i, j in zip(*np.nonzero(open_pairs))]


def compared(blocks: DataFrame, second: int, exact: str, threshold: float) -> DataFrame:
    """(kind, a, b, n): "gain" of ball a, "link" of balls a and b, or "open" pair of balls a and b."""
    names = ("n", "balls", "sizes", "radii", "leaders", "homes")
    counts = (blocks.filter(F.col("kind") != "member").groupBy("code").pivot("kind", ["filed", "visit"]).count().na.fill(0)
              .select("code", F.ceil(F.col("filed") / TASK_BLOCKS).cast("int").alias("s"),
                      F.ceil(F.col("visit") / TASK_BLOCKS).cast("int").alias("t")))     # a row per code
    counts = F.broadcast(counts)

    def dealt(kind: str, own: str, other: str) -> DataFrame:
        salt = F.pmod(F.xxhash64("balls"), F.col(own)).cast("int").alias(own)
        return (blocks.filter(F.col("kind") == kind).join(counts, "code").filter((F.col("s") > 0) & (F.col("t") > 0))
                .select("code", *names, *(["visited"] if kind == "visit" else []), salt,
                        F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)))

    def opened(table: pa.Table) -> dict:
        """The balls of all blocks of a task, one after another."""
        joined = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
        balls = joined("balls", "<i8")
        out = {"balls": balls, "sizes": joined("sizes", "<i8"), "radii": joined("radii", "<f8"), "homes": joined("homes", "<i4"),
               "units": unit(joined("leaders", exact).astype(np.float64).reshape(len(balls), -1))}
        if "visited" in table.column_names:
            out["visited"] = joined("visited", np.uint8).reshape(len(balls), -1)
        return out

    def part(balls: dict, at: int) -> dict:
        some = {k: v[at:at + BLOCK] for k, v in balls.items()}
        if "visited" in some:
            some["visited"] = np.unpackbits(some["visited"], axis=1, count=second).astype(bool)
        return some

    def run(stay: pa.Table, visit: pa.Table) -> pa.Table:
        rows = []
        if stay.num_rows and visit.num_rows:
            stay, visit = opened(stay), opened(visit)
            for at in range(0, len(visit["balls"]), BLOCK):
                some = part(visit, at)
                for to in range(0, len(stay["balls"]), BLOCK):
                    gains, links, open_pairs = compare(some, part(stay, to), second, threshold)
                    rows += ([("gain", a, None, n) for a, n in gains] + [("link", a, b, None) for a, b in links]
                             + [("open", a, b, None) for a, b in open_pairs])
        columns = list(zip(*rows)) if rows else [()] * 4
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                        names=["kind", "a", "b", "n"])

    keys = ("code", "s", "t")
    visits = dealt("visit", "t", "s")
    visits = visits.toDF(*visits.columns)           # columns of their own beside those of the same table
    met = dealt("filed", "s", "t").groupBy(*keys).cogroup(visits.groupBy(*keys))
    return stored(met.applyInArrow(run, "kind string, a long, b long, n long"), "compared-balls")


def member_links(open_pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(a, b, row, other) of the linked members of open pairs of balls, verified one by one."""
    # values named more than once are bound through one-element arrays, so that each is computed once a row
    bound = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    wide = F.transform("vec", lambda x: x.cast("double"))
    scaled = bound(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double")))), lambda peak: F.transform(wide, lambda x: x / peak))
    flat = members.join(small(open_pairs.select(F.explode(F.array("a", "b")).alias("ball")).distinct()), "ball", "left_semi")
    flat = stored(flat.select("ball", "row", bound(scaled, lambda v: F.struct(v.alias("vec"), F.sqrt(F.aggregate(
        v, F.lit(0.0), lambda s, x: s + x * x)).alias("norm"))).alias("u")).select("ball", "row", "u.vec", "u.norm"), "open-members")
    side = lambda k: flat.select(F.col("ball").alias(k), F.struct("row", "vec", "norm").alias(f"of_{k}"))
    both = open_pairs.join(side("a"), "a").join(side("b"), "b")
    dot = F.aggregate(F.zip_with("of_a.vec", "of_b.vec", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return (both.filter(dot >= F.lit(threshold) * F.col("of_a.norm") * F.col("of_b.norm"))
            .select("a", "b", F.col("of_a.row").alias("row"), F.col("of_b.row").alias("other")))


def near_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = numbered_rows(vectors)
    valid = rows.filter("ok")
    n = valid.count()
    alone = rows.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if n:
        sample = unit(sampled(valid))
        index = MultiIndex(sample, codes_for(n))
        blocks = filed(valid, index, n, visits_for(index, sample, threshold, recall), 0.31 * np.arccos(threshold))
        members = blocks.filter(F.col("kind") == "member")
        exact = "<f4" if component_type(rows, "vec") == "float" else "<f8"
        found = compared(blocks, index.sizes[1], exact, threshold)
        gains = found.filter(F.col("kind") == "gain").groupBy(F.col("a").alias("ball")).agg(F.sum("n").alias("gain"))
        links = found.filter(F.col("kind") == "link").select(F.col("a").alias("left"), F.col("b").alias("right"))
        open_pairs = found.filter(F.col("kind") == "open").select("a", "b")
        own = None
        if not open_pairs.isEmpty():
            single = member_links(open_pairs, members.select("ball", "row", "vec"), threshold)
            own = (single.select(F.explode(F.array("row", "other")).alias("row")).groupBy("row")
                   .agg(F.count(F.lit(1)).alias("own")))
            links = links.unionByName(single.select(F.col("a").alias("left"), F.col("b").alias("right")).distinct())
        groups = connected_components(links)
        heads = members.filter(F.col("row") == F.col("ball")).select("ball", "least")
        heads = heads.join(groups.select(F.col("node").alias("ball"), "component"), "ball", "left").join(gains, "ball", "left")
        heads = stored(heads.select("ball", "least", F.coalesce("component", "ball").alias("group"),
                                    F.coalesce("gain", F.lit(0)).alias("gain")), "ball-groups")
        # a ball in no link is its own group, so only linked ones need the smallest id of their group
        first = groups.select(F.col("node").alias("ball")).join(heads, "ball").groupBy("group").agg(F.min("least").alias("first"))
        heads = heads.join(small(stored(first, "group-ids")), "group", "left").select(
            "ball", "gain", F.coalesce("first", "least").alias("component_id"))
        out = members.select("row", "vec_id", "ball", "size").join(heads, "ball")
        if own is not None:
            out = out.join(own, "row", "left")
        total = F.col("size") - 1 + F.col("gain") + (F.coalesce("own", F.lit(0)) if own is not None else F.lit(0))
        alone = alone.unionByName(out.select("vec_id", total.cast("long").alias("n_links"), "component_id"))
    return alone.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
