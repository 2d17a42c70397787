import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm.common import stored
from vigil.llm.cotraining import (META_SIZE, TEXT_SIZE, CoTrained, _held_out, _information, classify, featurise, fit, keep_good,
                                  meta_features, text_features)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def corpus(n=1500, seed=0):
    """Prose and three kinds of junk; bad pages come from bad sources more often."""
    rng = np.random.default_rng(seed)
    rows, quality = [], {}
    for key in range(n):
        words = [f"{''.join(rng.choice(list('aeiorstln'), rng.integers(2, 8)))}" for _ in range(int(rng.integers(20, 120)))]
        good = rng.random() < 0.75
        if good:
            text = ". ".join(" ".join(words[i:i + 9]).capitalize() for i in range(0, len(words), 9)) + "."
        else:
            text = [lambda: "!! ".join(words).upper(), lambda: "$$$ ".join(words), lambda: " ".join([words[0]] * len(words))][key % 3]()
        source = f"s{rng.integers(0, 5) if (rng.random() < 0.8) == good else rng.integers(5, 10)}"
        rows.append((key, text, "en", source, len(text), "clash"))
        quality[key] = int(good)
    return rows, quality


@pytest.fixture(scope="module")
def trained(spark):
    rows, quality = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    labels = spark.createDataFrame([(k, q) for k, q in quality.items() if k % 4 == 0], "doc_id long, quality int")
    features = stored(featurise(docs, labels), "views")
    return docs, labels, quality, fit(features)


def test_held_out_accuracy(trained):
    docs, labels, quality, model = trained
    rows = classify(docs, labels).collect()
    unseen = [r for r in rows if r.doc_id % 4]          # no label of these was seen
    assert np.mean([r.keep == bool(quality[r.doc_id]) for r in unseen]) > 0.98
    assert np.mean([(r.meta_score >= 0.5) == bool(quality[r.doc_id]) for r in unseen]) > 0.74
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 1500
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.keep}


def test_views_exchange_labels(spark, trained):
    """With very few labels, the other view's confident labels change both models."""
    docs, _, quality, _ = trained
    few = spark.createDataFrame([(k, quality[k]) for k in range(0, 400)], "doc_id long, quality int")
    features = stored(featurise(docs, few), "views")
    alone, together = fit(features, rounds=0), fit(features, rounds=3, confident=0.9)
    assert not np.allclose(alone.meta.weights, together.meta.weights)
    assert not np.allclose(alone.text.weights, together.text.weights)
    assert not np.allclose(alone.meta.weights, 0) and together.fitted


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_both_views_label_real_documents(spark, sf):
    """On the given tables, where the metadata says little, each view still labels a share and moves the other."""
    folder = f"/root/testdata/{sf}"
    features = stored(featurise(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")), "views")
    alone, together = fit(features, rounds=0), fit(features)
    for view in ("text", "meta"):
        a, b = getattr(alone, view), getattr(together, view)
        assert np.abs(a.weights - b.weights).max() > 1e-4
        rows = features.filter(F.col("label").isNull()).select(f"{view}_view").collect()
        x = np.array([np.frombuffer(bytes(r[0]), "<f4") for r in rows], dtype=float)
        odds = b.log_odds(x)
        assert ((odds >= b.high) | (odds <= b.low)).mean() > 0.1


def test_information_of_a_label():
    p = np.array([0.0, 0.2, 0.8, 0.9, 1.0])
    got = _information(p, 0.8)
    assert np.allclose(got[[0, 2, 4]], [1, 0, 1], atol=1e-9) and 0 < got[3] < 0.2 and 0 < got[1] < 1


def test_newton_fit_equals_a_direct_solution(trained):
    """The distributed sums give the ridge logistic fit of the true labels (before any exchange)."""
    docs, labels, _, _ = trained
    features = stored(featurise(docs, labels), "views")
    rows = [r for r in features.filter(F.col("label").isNotNull()).collect()
            if not _held_out(np.array([r.doc_id]))[0]]
    x = np.array([np.frombuffer(bytes(r.meta_view), "<f4") for r in rows], dtype=float)
    y, w = np.array([r.label for r in rows]), np.zeros(META_SIZE)
    for _ in range(6):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(META_SIZE), x.T @ (y - p) - w)
    assert np.allclose(fit(features, rounds=0).meta.weights, w, atol=1e-8)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None, "x"), (None, "", "en", "s", -5, "x"), (2, "a " * 100_000, "en", "s", 2 ** 62, "x"),
            (3, "ok", "en", "s", 2, "x"), (3, "ok", "en", "s", 2, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 0), (3, 1)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):              # one class only, and none: everything is kept
        got = classify(docs, some).collect()
        assert len(got) == 5 and all(r.keep for r in got)
        assert keep_good(docs, some).count() == 5
    assert classify(docs.limit(0), labels).count() == 0 and keep_good(docs.limit(0), labels).count() == 0


def test_features():
    assert text_features("").tolist() == [1.0] + [0.0] * (TEXT_SIZE - 1)
    assert np.isfinite(text_features("é" * 10)).all() and np.isfinite(text_features("a")).all()
    assert len(meta_features(None, None, None)) == META_SIZE and meta_features("a", "b", 3).sum() == 4
    assert CoTrained().combined(np.zeros((2, TEXT_SIZE)), np.zeros((2, META_SIZE)))[2].tolist() == [0.5, 0.5]
