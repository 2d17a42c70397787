import random
import re
from itertools import permutations

import pytest

from vigil.llm import common
from vigil.llm.filter_audit import STATISTICS, audit_filters, failing_relations

DOCS = "doc_id long, text string, lang string, row string, part int, digest long, bit int"


def brute_force(docs, labels):
    """{(part, order, step): statistics} by walking every order over every document."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for d, text, lang, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 100:
            fails.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if d is not None and any(o is not None and o < d and (t or "") == text for o, t, *_ in docs):
            fails.add("E")
        rows.append((lang or "", fails, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        taken = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for i, k in enumerate(order):
                gone = [r for r in left if k in r[1]]
                left = [r for r in left if k not in r[1]]
                taken[k] += len(gone)
                out[part, "".join(order), i + 1] = [
                    len(left), len(gone), sum(k in r[1] and bool(r[1] & set(order[:i])) for r in mine),
                    sum(r[1] == {k} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(taken[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def made_up():
    dealt = random.Random(8)
    texts = [None, "", "a b c", "AB CD $", " ".join(f"w{i}" for i in range(120)), "w\x0bx\x0cy z\x85" * 40,
             " ".join(["same", "thing"] * 80), " ".join(f"Word{i}" for i in range(150)) + " #", "ÀÉ " * 50, "X" * 3000]
    docs = []
    for i in range(300):
        docs.append((None if i % 29 == 0 else i // 2 if i % 13 == 0 else i, dealt.choice(texts),
                     dealt.choice(["en", "de", "", None]), "x", 1, 2, 3))
    docs += docs[:10]
    labels = [(d, dealt.choice([0, 1, None]), dealt.choice([0, 1, None])) for d in [None, *range(0, 310, 2), 4, 4, 8]]
    return docs, labels


@pytest.mark.parametrize("broadcast_rows", [common.BROADCAST_ROWS, 0])
def test_equals_walking_every_order(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast_rows)
    docs, labels = made_up()
    got = audit_filters(spark, *failing_relations(
        spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    want = brute_force(docs, labels)
    assert len(got) == len(want) == 3 * 600
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in STATISTICS) for r in got} == want


def test_no_documents_and_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(spark, *failing_relations(spark.createDataFrame([], DOCS), labels)).count() == 0
    one = spark.createDataFrame([(1, "hello", None, "", 1, 1, 1)], DOCS)
    rows = audit_filters(spark, *failing_relations(one, labels)).collect()
    assert len(rows) == 600 and {(r.step, r.removed) for r in rows if r.filter_order == "ABCDE"} == {
        (1, 1), (2, 0), (3, 0), (4, 0), (5, 0)}


def test_relations_are_dealt_by_row_once(spark):
    docs, labels = made_up()
    every, failing = failing_relations(spark.createDataFrame(docs, DOCS),
                                       spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert set(failing) == set("ABCDE") and every.count() == len(docs)
    assert all(set(f.columns) == {"row", "part", "good", "toxic"} for f in failing.values())
