from math import floor

import numpy as np
import pytest

from vigil.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, cell string, score int, rank int, slot int"


def brute_force(rows, every=10, scale=256):
    ok = [(i, [floor(scale * x) for x in v], lab) for i, v, lab in rows
          if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for anchor, a, label in ok:
        if anchor % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i, lab) for i, v, lab in ok if i != anchor)
        for ps, positive, _ in [s for s in scored if s[2] == label][:5]:
            inside = [s for s in scored if s[2] != label and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:5]
            out += [(anchor, positive, rank, i, -ps, -s) for rank, (s, i, _) in enumerate(inside, 1)]
    return sorted(out)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, lab, "c", 1, 2, 3) for i, v, lab in rows], SCHEMA)
    return sorted(tuple(r) for r in hn.hard_negatives(spark, frame, every=10, **options).collect())


def made_up(n, d, seed, whole=False):
    dealt = np.random.default_rng(seed)
    vectors = dealt.integers(-2, 3, (n, d)).astype(float) if whole else dealt.standard_normal((n, d))
    vectors[: n // 3] = vectors[0] + (0 if whole else 0.05) * dealt.standard_normal((n // 3, d))       # a large group
    order = dealt.permutation(n)
    return [(int(i), [float(x) for x in vectors[k]], int(dealt.integers(0, 4))) for i, k in enumerate(order)]


@pytest.mark.parametrize("whole", [False, True])      # whole numbers: many ties
def test_equals_all_pairs(spark, monkeypatch, whole):
    monkeypatch.setattr(hn, "SHARD_ROWS", 150)
    monkeypatch.setattr(hn, "BLOCK", 16)
    monkeypatch.setattr(hn, "READ_AT_ONCE", 20)
    rows = made_up(700, 6, 4, whole)
    got = found(spark, rows)
    assert len(got) > 300 and got == brute_force(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.5], 1), (2, [1.0, 2.0], 2), (3, [0.9, 2.0], None), (4, None, 2), (5, [], 1),
            (6, [None, 1.0], 2), (7, [float("inf"), 1.0], 2), (10, [0.0, 0.0], 2), (11, [0.0, 0.0], 3), (12, [-1.0, 0.0], 1),
            (None, [1.0, 2.0], 2), (20, [-1.0, -2.0], 5)]
    assert found(spark, rows) == brute_force(rows)
    assert found(spark, rows + [rows[0], rows[2], rows[2]]) == brute_force(rows)        # repeated rows count once
    assert found(spark, rows + [(13, [1e30, 1.0], 2), (14, [1.0], 2)]) == brute_force(rows)
    assert found(spark, []) == [] and found(spark, [(1, None, 1)]) == []
    assert found(spark, [(0, [1.0], 1), (1, [2.0], 1), (2, [1.9], 0)]) == [(0, 1, 1, 2, 256 * 512, 256 * 486)]


def test_scores_beyond_doubles_are_exact(spark):
    dealt = np.random.default_rng(2)
    rows = [(i, [float(x) for x in dealt.integers(-2 ** 20, 2 ** 20, 4) + dealt.random(4)], int(i % 3)) for i in range(120)]
    assert found(spark, rows, scale=1024) == brute_force(rows, scale=1024)


def test_bounds_hold_and_searches_stop_early():
    dealt = np.random.default_rng(1)
    centres = 40 * dealt.standard_normal((30, 8))
    rows = np.floor((centres[dealt.integers(0, 30, 3000)] + dealt.standard_normal((3000, 8))) * 16)
    index = hn.MultiIndex(rows, 16)
    home = index.cells(rows)
    order = np.argsort(home, kind="stable")
    rows, home = rows[order], home[order]
    cells, starts = np.unique(home, return_index=True)
    one, two = index.half_gaps(rows)
    at = np.arange(len(rows))
    reach = [np.full(16, -1.0), np.full(16, -1.0)]
    np.maximum.at(reach[0], home // 16, np.sqrt(one[at, home // 16]))
    np.maximum.at(reach[1], home % 16, np.sqrt(two[at, home % 16]))
    shard = hn.CellShard(dict(n=3000, ids=np.arange(3000, dtype="<i8").tobytes(), labels=np.zeros(3000, dtype="<i8").tobytes(),
                              rows=rows.astype("<i4").tobytes(), cells=cells.astype("<i4").tobytes(),
                              starts=np.append(starts, 3000).astype("<i4").tobytes(), first=reach[0].tobytes(),
                              second=reach[1].tobytes()), index)
    read = []
    for anchor in rows[::300].astype(np.int64):
        scores = rows.astype(np.int64) @ anchor
        seen = np.zeros(3000, dtype=bool)
        for bound, places in shard.in_order(anchor):
            seen[places] = True
            assert not (~seen).any() or scores[~seen].max() <= bound
        assert seen.all()
        best = np.partition(scores, -5)[-5]
        read.append(sum(len(p) for b, p in zip([np.inf, *(b for b, _ in shard.in_order(anchor))],
                                               (p for _, p in shard.in_order(anchor))) if b >= best))
    assert np.mean(read) < 1500
