import numpy as np
import pytest

from vigil.llm.multi_index import multi_sequence, nearest_cells
from vigil.llm.near_vectors import form_balls, near_vectors, spanning_forest

SCHEMA = "vec_id long, embedding array<float>, label int, row string, ball string, size int, kind int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", 1, 2) for i, v in rows], SCHEMA)


def brute_force(rows, threshold=0.9):
    """[(vec_id, n_links, component_id)] over all pairs."""
    ok = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    m = np.array([np.float32(rows[k][1]) for k in ok], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    linked = m @ m.T >= threshold
    np.fill_diagonal(linked, False)
    label = [rows[k][0] for k in ok]
    while True:
        new = [min([label[a], *(label[b] for b in np.flatnonzero(linked[a]))]) for a in range(len(ok))]
        if new == label:
            break
        label = new
    out = [(i, 0, i) for k, (i, _) in enumerate(rows) if k not in set(ok)]
    return sorted(out + [(rows[k][0], int(linked[a].sum()), label[a]) for a, k in enumerate(ok)], key=repr)


def found(spark, rows, **options):
    got = near_vectors(spark, frame(spark, rows), **options).collect()
    assert all(r.kept == (r.component_id is None or r.vec_id == r.component_id) for r in got)
    return sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=repr)


def test_clusters_of_all_widths(spark):
    dealt = np.random.default_rng(3)
    rows = []
    for width in (0.0, 0.02, 0.06, 0.1, 0.3):
        for centre in dealt.standard_normal((12, 16)):
            rows += [(centre / np.linalg.norm(centre) + width * dealt.standard_normal(16)) for _ in range(dealt.integers(1, 25))]
    rows += list(dealt.standard_normal((300, 16)))
    order = dealt.permutation(len(rows))
    rows = [(int(i), [float(x) for x in rows[k]]) for i, k in enumerate(order)]
    want = brute_force(rows)
    got = found(spark, rows)
    links = sum(w[1] for w in want)
    assert links > 2000 and links * 0.98 <= sum(g[1] for g in got) <= links
    assert np.mean([g == w for g, w in zip(got, want)]) > 0.97
    assert sum(g[1] for g in found(spark, rows, recall=1.0)) >= 0.999 * links


def test_odd_rows(spark):
    a = [1.0, 2.0, 3.0, 4.0]
    rows = [(7, a), (7, a), (3, [2.0, 4.0, 6.0, 8.0]), (1, None), (2, []), (4, [0.0] * 4), (5, [1.0, None, 0.0, 0.0]), (None, a),
            (6, [float("nan")] * 4), (8, [float("inf"), 0.0, 0.0, 0.0]), (9, [-1.0, -2.0, -3.0, -4.0]), (10, [3e38, 0.0, 0.0, 1e38]),
            (11, [1e-40, 0.0, 0.0, 0.0])]
    assert found(spark, rows) == brute_force(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == [(1, 0, 1)]
    assert found(spark, [(2, [1.0]), (1, [5.0]), (3, [-1.0])]) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
    assert found(spark, [(1, a), (2, a), (3, [1.0, 2.0])]) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_one_large_group_of_near_copies(spark):
    dealt = np.random.default_rng(5)
    centre = dealt.standard_normal(32)
    copies = centre / np.linalg.norm(centre) + 0.01 * dealt.standard_normal((1500, 32))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*copies, *dealt.standard_normal((1500, 32))])]
    got = found(spark, rows)
    assert got == brute_force(rows)


def test_balls_hold_only_vectors_that_are_all_linked():
    dealt = np.random.default_rng(6)
    units = dealt.standard_normal((400, 3))
    units /= np.linalg.norm(units, axis=1)[:, None]
    cells = np.sort(dealt.integers(0, 3, 400))
    leader, gap = form_balls(units, cells, 0.14)
    assert (cells[leader] == cells).all() and len(set(leader)) < 400 and (leader[leader] == leader).all()
    for k in set(leader):
        own = units[leader == k]
        assert np.arccos(np.clip(own @ own.T, -1, 1)).max() <= np.arccos(0.9)
    assert np.allclose(np.cos(gap), (units * units[leader]).sum(axis=1))


def test_traversals_follow_the_summed_order():
    dealt = np.random.default_rng(7)
    first, second = dealt.random((20, 9)), dealt.random((20, 5))
    for visits in (1, 7, 45, 99):
        cells = nearest_cells(first, second, visits)
        for f, s, got in zip(first, second, cells):
            sums = (f[:, None] + s).ravel()
            assert got.tolist() == np.argsort(sums, kind="stable")[:visits].tolist()
    seen = list(multi_sequence(first[0], second[0]))
    assert len({(i, j) for _, i, j in seen}) == 45
    assert [t for t, *_ in seen] == sorted((t for t, *_ in seen), reverse=True)
    assert all(t == first[0][i] + second[0][j] for t, i, j in seen)


@pytest.mark.parametrize("share", [0.02, 0.2, 1.0])
def test_forest_joins_what_the_links_join(share):
    linked = np.random.default_rng(9).random((30, 40)) < share

    def parts(links):
        name = list(range(70))
        for i, j in links:
            a, b = name[i], name[30 + j]
            name = [a if x == b else x for x in name]
        return [[x == y for y in name] for x in name]

    forest = list(spanning_forest(linked))
    assert len(forest) < 70 and all(linked[i, j] for i, j in forest)
    assert parts(forest) == parts(zip(*np.nonzero(linked)))
