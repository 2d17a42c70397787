"""Quality classifier by co-training two views of a document.

One view is the text (character classes and their transitions, word repetition, line
shape), the other the page metadata (source, language, size). Each view has its own logistic
model. In every round the two models, calibrated on labelled rows that neither is trained on,
label the unlabelled documents they are most confident about, a share of either class in proportion
to the class, and each trains on the other's labels besides the true ones. A pseudo-label is the
calibrated probability, and weighs as much as it says beyond the prior (its divergence from the
prior, against that of certainty), so a weak view teaches little but never nothing. At the end the calibrated views are combined: their log-odds
add, less the prior's, which both contain.

Fitting is exact Newton steps over all labelled and confidently labelled rows: every task sums its
rows' gradient and curvature, the sums are added in a tree, and the driver solves one small system. Nothing is sampled.

Defined results: null text, source or language count as empty, a null size as 0; a null or
missing label is unlabelled, several labels of one document are averaged; without labels
of both classes every document scores the prior and is kept; repeated rows are scored each; a
null doc_id is scored and never labelled; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import stored, text_or_empty
from vigil.llm.order_minhash import word_hashes
from vigil.operators.fold_fits import tree_merged

ROUNDS = 3                  # exchanges of pseudo-labels
FIRST_STEPS, LATER_STEPS = 6, 2     # Newton steps of the first fit and of each round
CONFIDENT = 0.98            # calibrated probability from which a pseudo-label is given in any case
SHARE = 0.2                 # of the unlabelled documents that a view labels at least, both classes together
PSEUDO_WEIGHT = 0.5         # of a pseudo-label against a true one
RIDGE = 1.0
HELD_OUT = 5                # one in so many labelled documents calibrates and does not train
ACCEPT = 0.5
BINS = np.linspace(-12, 12, 97)     # log-odds bins of the calibration

# Character classes: 0 other, 1 small, 2 capital, 3 digit, 4 blank, 5 line end, 6 sentence mark, 7 non-ASCII.
CLASSES = 8
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[c for c in range(97, 123)]] = 1
_CLASS[[c for c in range(65, 91)]] = 2
_CLASS[[c for c in range(48, 58)]] = 3
_CLASS[[32, 9]] = 4
_CLASS[[10, 13]] = 5
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 6
_CLASS[128:] = 7
SYMBOLS = [c for c in range(33, 127) if not chr(c).isalnum()]
TEXT_SIZE = 1 + CLASSES + CLASSES * CLASSES + len(SYMBOLS) + 8
SOURCES, LANGUAGES, SIZES = 64, 16, 24
META_SIZE = 1 + SOURCES + LANGUAGES + SIZES


def text_features(text: str) -> np.ndarray:
    out = np.zeros(TEXT_SIZE, dtype=np.float32)
    out[0] = 1
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    n = len(raw)
    if not n:
        return out
    kind = _CLASS[raw]
    at = 1
    out[at:at + CLASSES] = np.bincount(kind, minlength=CLASSES) / n
    at += CLASSES
    if n > 1:
        step = np.bincount(kind[:-1] * CLASSES + kind[1:], minlength=CLASSES * CLASSES)
        out[at:at + CLASSES * CLASSES] = np.sqrt(step / (n - 1))
    at += CLASSES * CLASSES
    out[at:at + len(SYMBOLS)] = np.sqrt(np.bincount(raw, minlength=256)[SYMBOLS] / n)
    at += len(SYMBOLS)
    words = word_hashes(text)
    if len(words):
        _, counts = np.unique(words, return_counts=True)
        lines = np.bincount(kind, minlength=CLASSES)[5] + 1
        out[at:] = (len(counts) / len(words), counts.max() / len(words),
                    (words[1:] == words[:-1]).mean() if len(words) > 1 else 0,
                    (words[2:] == words[:-2]).mean() if len(words) > 2 else 0,
                    np.log1p(len(words)) / 10, min(4, n / len(words) / 10), min(2, np.log1p(n / lines) / 6),
                    (counts * np.log(len(words) / counts)).sum() / len(words) / 10)
    return out


def meta_features(source: str | None, lang: str | None, size: int | None) -> np.ndarray:
    out = np.zeros(META_SIZE, dtype=np.float32)
    out[0] = 1
    out[1 + crc32((source or "").encode()) % SOURCES] = 1
    out[1 + SOURCES + crc32((lang or "").encode()) % LANGUAGES] = 1
    out[1 + SOURCES + LANGUAGES + min(SIZES - 1, max(0, int(size or 0)).bit_length())] = 1
    return out


@dataclass
class View:
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    high: float = np.inf        # log-odds from which it labels documents good
    low: float = -np.inf        # and up to which bad

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Calibrated."""
        return self.slope * self.raw(x) + self.shift


@dataclass
class CoTrained:
    text: View = field(default_factory=lambda: View(np.zeros(TEXT_SIZE)))
    meta: View = field(default_factory=lambda: View(np.zeros(META_SIZE)))
    prior: float = 0.0          # log-odds of a good document
    fitted: bool = False

    def combined(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of quality: by text, by metadata, by both."""
        a, b = self.text.log_odds(text), self.meta.log_odds(meta)
        return sigmoid(a), sigmoid(b), sigmoid(a + b - self.prior)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def featurise(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(doc_id, label, text_view, meta_view): the views as packed 32-bit floats, label null if unknown."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                text = [text_features(t).tobytes() for t in part.column(1).to_pylist()]
                meta = [meta_features(*m).tobytes() for m in
                        zip(*(part.column(c).to_pylist() for c in (2, 3, 4)))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.binary()),
                                                  pa.array(meta, pa.binary())], ["doc_id", "text_view", "meta_view"])

    made = (docs.select("doc_id", text_or_empty().alias("text"), "source", "lang", F.col("n_chars").cast("long"))
            .mapInArrow(run, "doc_id long, text_view binary, meta_view binary"))
    if labels is None:
        return made.withColumn("label", F.lit(None).cast("double"))
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
             .groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label")))
    return made.join(known, "doc_id", "left")


def _views(batch: pa.RecordBatch, lo: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    part = batch.slice(lo, size)
    text = np.frombuffer(b"".join(part.column("text_view").to_pylist()), "<f4").reshape(part.num_rows, -1)
    meta = np.frombuffer(b"".join(part.column("meta_view").to_pylist()), "<f4").reshape(part.num_rows, -1)
    return text.astype(np.float64), meta.astype(np.float64)


def _held_out(doc_ids: np.ndarray) -> np.ndarray:
    return ((doc_ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(HELD_OUT) == 0


def _summed(rows: DataFrame, size: int, add, tasks: int) -> np.ndarray:
    """Sum over all rows of ``add(text, meta, label, held_out)``, arrays of ``size`` numbers: one sum per
    task, added in a tree, of which the driver gets one."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                text, meta = _views(batch, lo, 4096)
                part = batch.slice(lo, 4096)
                label = part.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
                ids = np.nan_to_num(part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
                total += add(text, meta, label, _held_out(ids))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()),
                                          pa.array([total.tobytes()], pa.binary())], ["fit", "part", "body"])

    def together(bodies: list[bytes]) -> bytes:
        return sum((np.frombuffer(b) for b in bodies), np.zeros(size)).tobytes()

    parts = rows.select("doc_id", "label", "text_view", "meta_view").mapInArrow(partial, "fit int, part int, body binary")
    total = tree_merged(parts, tasks, together)
    return np.frombuffer(total[0]) if total else np.zeros(size)


def _newton_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, weights: np.ndarray) -> np.ndarray:
    rows = w > 0
    x, y, w = x[rows], y[rows], w[rows]
    p = sigmoid(x @ weights)
    curve = (x * (w * p * (1 - p))[:, None]).T @ x
    return np.concatenate([x.T @ (w * (y - p)), curve.reshape(-1)])


def _newton_step(weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    n = len(weights)
    ridge = np.full(n, RIDGE)
    return weights + np.linalg.solve(sums[n:].reshape(n, n) + np.diag(ridge), sums[:n] - ridge * weights)


def _information(p: np.ndarray, prior: float) -> np.ndarray:
    """Divergence of a probability from the prior, as a part of that of certainty on its side."""
    p = np.clip(p, 1e-12, 1 - 1e-12)
    gain = p * np.log(p / prior) + (1 - p) * np.log((1 - p) / (1 - prior))
    return np.clip(gain / np.where(p > prior, -np.log(prior), -np.log(1 - prior)), 0, 1)


def _targets(label: np.ndarray, held: np.ndarray, view: View | None, teacher: np.ndarray | None, prior: float):
    """(target, weight) of a view's training rows; ``teacher``: the other view's calibrated log-odds."""
    known = ~np.isnan(label)
    y, w = np.where(known, label, 0.0), np.where(known & ~held, 1.0, 0.0)
    if teacher is not None:
        sure = ~known & ((teacher >= view.high) | (teacher <= view.low))
        p = sigmoid(teacher)
        y, w = np.where(sure, p, y), np.where(sure, PSEUDO_WEIGHT * _information(p, prior), w)
    return y, w


def _confident(view: View, unlabelled: np.ndarray, prior: float, confident: float, share: float) -> View:
    """The view with its limits: the most confident ``share`` of the unlabelled documents, per class as the prior says."""
    total = unlabelled.sum()
    certain = float(np.log(confident / (1 - confident)))
    if not total or not view.slope:
        return View(view.weights, view.slope, view.shift, certain, -certain)
    edges = view.slope * np.concatenate([[-np.inf], BINS, [np.inf]]) + view.shift
    above, below = np.cumsum(unlabelled[::-1])[::-1], np.cumsum(unlabelled)
    high = edges[np.flatnonzero(above >= share * prior * total)[-1]]
    low = edges[np.flatnonzero(below >= share * (1 - prior) * total)[0] + 1]
    middle = float(np.log(prior / (1 - prior)))
    return View(view.weights, view.slope, view.shift, min(certain, max(high, middle)), max(-certain, min(low, middle)))


def _calibrate(view: View, counts: np.ndarray) -> View:
    """Slope and shift from (bin, class) counts of held-out raw scores, with smoothed targets."""
    good, bad = counts[:, 0], counts[:, 1]
    n_good, n_bad = good.sum(), bad.sum()
    if not n_good or not n_bad:
        return View(view.weights)
    z = np.concatenate([[BINS[0]], (BINS[:-1] + BINS[1:]) / 2, [BINS[-1]]])
    x = np.stack([np.concatenate([z, z]), np.ones(2 * len(z))], axis=1)
    y = np.concatenate([np.full(len(z), (n_good + 1) / (n_good + 2)), np.full(len(z), 1 / (n_bad + 2))])
    w = np.concatenate([good, bad])
    ab = np.array([1.0, 0.0])
    for _ in range(25):
        p = sigmoid(x @ ab)
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag([0.1, 0.001])
        ab = ab + np.clip(np.linalg.solve(curve, x.T @ (w * (y - p)) - np.array([0.1, 0.001]) * (ab - [1, 0])), -2, 2)
    return View(view.weights, max(0.0, float(ab[0])), float(ab[1]))


def fit(rows: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, share: float = SHARE) -> CoTrained:
    """Co-train over the stored feature table."""
    tasks = (rows.select(F.spark_partition_id().alias("task")).agg(F.max("task")).first()[0] or 0) + 1
    seen = _summed(rows, 2, lambda t, m, y, h: np.array([(y >= 0.5).sum(), (y < 0.5).sum()]), tasks)
    model = CoTrained(prior=float(np.log((seen[0] + 1) / (seen[1] + 1))))
    if not seen.all():
        return model
    model.fitted = True
    prior = float((seen[0] + 1) / (seen.sum() + 2))
    sizes = (TEXT_SIZE * (TEXT_SIZE + 1), META_SIZE * (META_SIZE + 1))
    for r in range(rounds + 1):
        teachers = (model.text, model.meta) if r else None
        text, meta = model.text.weights, model.meta.weights
        for _ in range(LATER_STEPS if r else FIRST_STEPS):
            def add(t, m, y, h, text=text, meta=meta):
                by_text, by_meta = (teachers[0].log_odds(t), teachers[1].log_odds(m)) if teachers else (None, None)
                of_text, of_meta = teachers or (None, None)
                return np.concatenate([_newton_sums(t, *_targets(y, h, of_meta, by_meta, prior), text),
                                       _newton_sums(m, *_targets(y, h, of_text, by_text, prior), meta)])
            sums = _summed(rows, sum(sizes), add, tasks)
            text, meta = _newton_step(text, sums[:sizes[0]]), _newton_step(meta, sums[sizes[0]:])

        def tally(t, m, y, h, text=text, meta=meta):
            known, out = ~np.isnan(y), np.zeros((2, len(BINS) + 1, 3))
            column = np.where(known, y < 0.5, 2).astype(int)            # good, bad, unlabelled
            counted = h | ~known
            for v, raw in enumerate((t @ text, m @ meta)):
                np.add.at(out[v], (np.digitize(raw[counted], BINS), column[counted]), 1)
            return out.reshape(-1)
        counts = _summed(rows, 6 * (len(BINS) + 1), tally, tasks).reshape(2, len(BINS) + 1, 3)
        model.text, model.meta = (_confident(_calibrate(View(w), c[:, :2]), c[:, 2], prior, confident, share)
                                  for w, c in zip((text, meta), counts))
    return model


SCORES = "text_score double, meta_score double, score double, keep boolean"


def _scored(model: CoTrained, text: np.ndarray, meta: np.ndarray, accept: float) -> list[pa.Array]:
    a, b, both = model.combined(text, meta)
    keep = both >= accept if model.fitted else np.ones(len(both), dtype=bool)
    return [pa.array(a), pa.array(b), pa.array(both), pa.array(keep)]


def score_features(rows: DataFrame, model: CoTrained, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) from the feature table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                yield pa.RecordBatch.from_arrays(
                    [batch.slice(lo, 4096).column(0), *_scored(model, *_views(batch, lo, 4096), accept)],
                    ["doc_id", "text_score", "meta_score", "score", "keep"])
    return rows.select("doc_id", "text_view", "meta_view").mapInArrow(run, f"doc_id long, {SCORES}")


def classify(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) of every document."""
    rows = stored(featurise(docs, labels), "views")
    return score_features(rows, fit(rows, rounds), accept)


def keep_good(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns as they are.

    Rows are scored where they are read; no join brings the decision back to the text.
    """
    model = fit(stored(featurise(docs, labels), "views"), rounds)
    names = docs.columns
    at = [names.index(c) for c in ("text", "source", "lang", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                text, source, lang, size = (part.column(c).to_pylist() for c in at)
                if text:
                    t = np.array([text_features(x or "") for x in text], dtype=np.float64)
                    m = np.array([meta_features(*x) for x in zip(source, lang, size)], dtype=np.float64)
                    yield part.filter(_scored(model, t, m, accept)[3])
    return docs.mapInArrow(run, docs.schema)
