import numpy as np
import pytest

from vigil.llm.groups import connected_components
from vigil.llm.order_minhash import aligned, near_duplicates, shingle_items, similarity, word_hashes


def by_hand(rows, threshold=0.8):
    """Groups by aligned shingles of every pair: {position of row: smallest doc_id of its group}."""
    items = [shingle_items(word_hashes(t or ""))[0] for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if len(items[i]) and len(items[j]) and similarity(items[i], items[j], threshold) >= threshold:
                root[find(i)] = find(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(key)
    return [min(groups[find(i)]) for i in range(len(rows))]


def prose(rng, n, words=400):
    return " ".join(f"w{x}" for x in rng.integers(0, words, n))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        at = int(rng.integers(0, len(words)))
        kind = rng.integers(0, 3)
        if kind == 0:
            words[at] = f"new{rng.integers(0, 10 ** 6)}"
        elif kind == 1:
            words.insert(at, f"more{rng.integers(0, 10 ** 6)}")
        elif len(words) > 1:
            del words[at]
    return " ".join(words)


def test_groups_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, key = [], 0
    passage = prose(rng, 60)
    for _ in range(40):
        base = prose(rng, int(rng.integers(8, 300)))
        for _ in range(int(rng.integers(1, 6))):
            rows.append((key, edited(rng, base, int(rng.integers(0, 1 + len(base.split()) // 30)))))
            key += 1
    rows += [(key + i, f"{prose(rng, 80)} {passage} {prose(rng, 80)}") for i in range(30)]      # one shared passage
    hub = prose(rng, 200)
    rows += [(2000 + i, edited(rng, hub, 2)) for i in range(40)]                                # many near copies
    rows += [(3000, rows[0][1].upper().replace(" ", ",  ")), (3001, rows[0][1])]                 # other case and marks
    rows += [(4000, "same line\n" * 300), (4001, "same line\n" * 290), (4002, "only four words here"), (4003, "Only FOUR words here!"),
             (4004, "one"), (4005, "one"), (4006, "two")]
    got = {r.doc_id: r for r in near_duplicates(
        spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, keep int").repartition(4)).collect()}
    want = by_hand(rows)
    assert [got[k].class_id for k, _ in rows] == want
    assert all(r.keep == (r.doc_id == r.class_id) for r in got.values())
    assert all(got[k].class_size == want.count(c) for (k, _), c in zip(rows, want))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " .,\n"), (None, "a b c d e f"), (None, None), (5, "a b c d e f"), (6, "A b c d e f"),
            (6, "A b c d e f"), (7, "q " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.keep) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (None, None, True), (None, None, True), (5, 5, True),
                          (6, 5, False), (6, 5, False), (7, 7, True)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_alignment():
    a = np.arange(100, dtype=np.uint64)
    assert aligned(a, a, 0) == 100
    assert aligned(a, a[::-1].copy(), 100) == 1
    assert aligned(a, np.roll(a, 10), 10) == 90
    assert aligned(a, np.roll(a, 10), 9) == 0
    assert similarity(a, a[:70]) == 0
    assert similarity(a, np.concatenate([a[:90], a[90:] + np.uint64(1000)])) == pytest.approx(90 / 110)


def test_words_and_items():
    assert (word_hashes("The cat, the CAT") [:2] == word_hashes("the-cat")).all()
    assert len(word_hashes("")) == 0 and len(word_hashes(" \n.")) == 0
    assert len(word_hashes("été ça")) == 2
    items, shingles = shingle_items(word_hashes("a b c d e " * 4))
    assert len(items) == 16 and len(set(items.tolist())) == 16 and len(set(shingles.tolist())) == 5


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(120)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "left long, right long")).collect()}
    root = {n: n for p in pairs for n in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    assert got == {n: find(n) for p in pairs if p[0] != p[1] for n in p}
    assert connected_components(spark.createDataFrame([], "left long, right long")).count() == 0
