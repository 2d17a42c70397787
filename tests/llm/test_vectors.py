import numpy as np
import pytest

from vigil.llm.prefix_forest import forest_neighbours, hash_strings, prefix_runs
from vigil.llm.va_search import exact_top_k, score_bounds

SCHEMA = "vec_id long, embedding array<float>, label string, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0.0) for i, v in rows], SCHEMA)


def odd_rows(rng, n=400, dim=6):
    rows = [(i, rng.standard_normal(dim).astype(np.float32).tolist()) for i in range(n)]
    rows[7] = (7, rows[300][1])                         # a tie with another row
    rows[100] = (100, rows[300][1])                     # a query equal to two others
    rows += [(1000, None), (1100, []), (1200, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1300, [float("nan")] * dim),
             (1400, [float("inf")] * dim), (1500, [1.0, 2.0]), (1600, [0.0] * dim), (-100, rows[5][1]), (None, rows[6][1])]
    return rows


def usable(rows, dim, zero):
    return [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows
            if i is not None and v and len(v) == dim and None not in v and np.isfinite(v).all() and (zero or any(v))]


@pytest.mark.parametrize("shard,block", [(16_384, 1024), (37, 2)])
def test_exact_search_equals_brute_force(spark, shard, block):
    rows = odd_rows(np.random.default_rng(3))
    got = {(r.query_id, r.rank): (r.vec_id, r.score)
           for r in exact_top_k(spark, table(spark, rows).repartition(3), rows=shard, block=block).collect()}
    good = [(i, np.floor(1024 * v).astype(np.int64)) for i, v in usable(rows, 6, True)]
    want = {}
    for q, x in good:
        if q % 100 == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q)[:10]
            want.update({(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)})
    assert got == want


def test_bounds_hold_every_score():
    rng = np.random.default_rng(0)
    x, q = rng.integers(-3000, 3000, (500, 8)).astype(float), rng.integers(-3000, 3000, (20, 8)).astype(float)
    low, width = x.min(0), np.maximum(1, np.ceil((x.max(0) - x.min(0) + 1) / 256))
    least, most = score_bounds(np.floor((x - low) / width), low, width, q)
    assert (least <= q @ x.T).all() and (q @ x.T <= most).all()


def test_forest_recall_scores_and_ties(spark):
    rng = np.random.default_rng(5)
    rows = odd_rows(rng, 6000, 16)
    got = forest_neighbours(spark, table(spark, rows).repartition(3), rows=3000, block=7).collect()
    good = usable(rows, 16, False)
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(found) == {i for i in ids.tolist() if i % 100 == 0}
    hits = 0
    for q, rows_of in found.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        best = [i for _, i in sorted((a, b) for a, b in zip(d, ids.tolist()) if b != q)[:10]]
        hits += len({v for _, _, v in rows_of} & set(best))
        assert [k for k, _, _ in sorted(rows_of)] == list(range(1, 11))
        assert [v for _, _, v in sorted(rows_of)] == [v for _, v in sorted((s, v) for _, s, v in rows_of)]
        assert all(abs(d[ids == v][0] - s) < 1e-12 for _, s, v in rows_of)
    assert hits / (10 * len(found)) >= 0.9
    assert sorted(found[100])[0][1:] == (0.0, 7) and sorted(found[100])[1][1:] == (0.0, 300)


def test_prefix_runs_are_the_shared_prefixes():
    rng = np.random.default_rng(1)
    strings = np.sort(hash_strings(rng.standard_normal((200, 5)), 3, 12, 9), axis=1)
    queries = hash_strings(rng.standard_normal((10, 5)), 3, 12, 9)
    start, end = prefix_runs(strings, queries, 12, 25)
    for q in range(10):
        for length in range(12, -1, -1):
            runs = [(strings[t] >> np.uint64(12 - length)) == (queries[t, q] >> np.uint64(12 - length)) for t in range(3)]
            if sum(r.sum() for r in runs) >= 25:
                break
        for t in range(3):
            assert np.flatnonzero(runs[t]).tolist() == list(range(start[t, q], end[t, q]))


def test_few_rows_and_none(spark):
    few = table(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])])
    assert [(r.rank, r.vec_id) for r in exact_top_k(spark, few).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert [(r.rank, r.vec_id) for r in forest_neighbours(spark, few).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    for empty in (few.limit(0), table(spark, [(0, None)]), table(spark, [(0, [1.0])])):
        assert exact_top_k(spark, empty).count() == 0 and forest_neighbours(spark, empty).count() == 0


def test_repeated_rows_and_huge_components(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(4).astype(np.float32).tolist()) for i in range(150)]
    again = rows + [rows[0], rows[100], rows[3], rows[3], (7, [9.0, 9.0, 9.0, 9.0])]
    key = lambda r: (r.query_id, r.rank)
    for search in (exact_top_k, forest_neighbours):
        one = sorted(search(spark, table(spark, rows)).collect(), key=key)
        two = sorted(search(spark, table(spark, again + [(200, [1e30, 0.0, 0.0, 0.0])] * (search is exact_top_k))).collect(), key=key)
        assert [tuple(r) for r in one] == [tuple(r) for r in two]
        assert len({(r.query_id, r.vec_id) for r in two}) == len(two) == 20


def test_scores_that_doubles_round_are_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in np.float32(rng.integers(-2 ** 17, 2 ** 17, 5) + rng.random(5))]) for i in range(300)]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in exact_top_k(spark, table(spark, rows), rows=90).collect()}
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    for q, x in whole[::100]:
        best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in whole if i != q)[:10]
        assert [got[q, k + 1] for k in range(10)] == [(i, -s) for s, i in best]
