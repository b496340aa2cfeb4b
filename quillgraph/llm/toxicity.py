"""Severity of toxic text by cumulative-link (proportional-odds) regression on sparse word features.

Grades are 0 (none), 1 (mild) and 2 (severe). The labels only say toxic or not, so toxic training documents are split
at the median of their number of marked words: those found at least ``marked_odds`` times as often in toxic
documents as elsewhere. The model is ``P(grade <= k) = sigmoid(theta_k - w.x)`` with one weight vector for all
thresholds, fitted by proximal gradient steps with an L1 penalty, so that only words that carry evidence keep a weight.
The output is the expected severity and the grade; a document is toxic if the model finds grade >= 1 likelier than not.

``max_train`` (per class) bounds the labelled rows that are fetched for the fit; scoring covers whole texts of all rows.

Edge cases: null and empty texts have no features (grade of the intercept, never rejected); null labels are not used;
several labels of one document count as toxic if any is. Without labelled rows of both classes nothing is toxic and the
severity is 0. Repeated rows and null ids are carried through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text, documents_of, slices, small_batches, staged, utf8

SCHEMA = "doc_id long, severity double, grade int, p_mild double, p_severe double, toxic boolean, kept boolean"
_fold = bytearray(range(256))
for _c in range(128):
    _fold[_c] = ord(chr(_c).lower()) if chr(_c).isalpha() else 32
_fold = bytes(_fold)


STEMS = (4, 5, 6, 7, 8)


def features(text: str | None) -> set[bytes]:
    """Distinct words (runs of letters, ASCII ones in lower case), and their beginnings of 4 to 8 bytes, marked by a hyphen."""
    words = set(utf8(text).lower().translate(_fold).split())
    return words.union(*[{w[:n] + b"-" for w in words if len(w) > n} for n in STEMS])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class SeverityModel:
    weights: dict[bytes, float] = field(default_factory=dict)
    theta: tuple[float, float] = (40.0, 80.0)

    def probabilities(self, text: str | None) -> tuple[float, float]:
        """P(grade >= 1) and P(grade >= 2)."""
        z = sum(map(self.weights.__getitem__, features(text) & self.weights.keys()))
        return tuple(float(1 - sigmoid(t - z)) if t < 39 else 0.0 for t in self.theta)


def fit(rows: list[tuple[Collection[bytes], int]], marked_odds: float = 20.0, min_docs: int = 5, l1: float = 1e-3, steps: int = 400) -> SeverityModel:
    """rows: the features and 0/1 label of each training document."""
    y = np.array([bool(t) for _, t in rows])
    if not len(y) or y.all() or not y.any():
        return SeverityModel()
    seen: dict[bytes, list[int]] = {}
    for words, t in rows:
        for w in words:
            seen.setdefault(w, [0, 0])[bool(t)] += 1
    n0, n1 = int((~y).sum()), int(y.sum())
    odds = lambda c: (c[1] + 0.5) / n1 / ((c[0] + 0.5) / n0)
    vocabulary = sorted(w for w, c in seen.items() if sum(c) >= min_docs)
    marked = {w for w in vocabulary if odds(seen[w]) >= marked_odds}
    column = {w: i for i, w in enumerate(vocabulary)}
    count = np.array([len(marked.intersection(words)) for words, _ in rows])
    middle = np.median(count[y])
    grade = np.where(y, np.where(count > middle, 2, 1), 0)
    pairs = [(r, column[w]) for r, (words, _) in enumerate(rows) for w in words if w in column]
    if not pairs:
        return SeverityModel()
    at, of = np.array(pairs).T
    size = np.bincount(at, minlength=len(rows)) + 1.0
    value = np.ones(len(at))
    # rows of the rarer class weigh as much as those of the other
    share = np.where(y, 0.5 / n1, 0.5 / n0)
    w, theta = np.zeros(len(vocabulary)), np.array([1.0, 3.0])
    look, before, pace = w.copy(), w.copy(), 1.0
    step = 4.0 / max(1.0, np.average(size, weights=share) / 20)
    for i in range(steps):
        z = np.bincount(at, weights=value * look[of], minlength=len(rows))
        c = np.stack([np.zeros_like(z), sigmoid(theta[0] - z), sigmoid(theta[1] - z), np.ones_like(z)])
        d = c * (1 - c)
        low, high = c[grade, np.arange(len(z))], c[grade + 1, np.arange(len(z))]
        p = np.maximum(high - low, 1e-9)
        dlow, dhigh = d[grade, np.arange(len(z))], d[grade + 1, np.arange(len(z))]
        g = share * (dhigh - dlow) / p  # of the loss by z
        gw = np.bincount(of, weights=value * g[at], minlength=len(w))
        gt = np.array([-np.sum(share * np.where(grade == k, dhigh, np.where(grade == k + 1, -dlow, 0)) / p) for k in (0, 1)])
        w = look - step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        theta = theta - 2.0 * gt
        theta[1] = max(theta[1], theta[0] + 0.1)
        faster = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        look, before, pace = w + (pace - 1) / faster * (w - before), w, faster
    return SeverityModel({v: float(x) for v, x in zip(vocabulary, w, strict=True) if abs(x) > 1e-6}, (float(theta[0]), float(theta[1])))


def telling_features(rows: DataFrame, min_docs: int, odds: float) -> list[bytes]:
    """Features found ``odds`` times as often in one class as in the other; their number is bounded by the training sample.

    Counted on the executors, batch by batch, over the training documents only.
    """
    sizes = {bool(r.toxic): r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: dict[bytes, list[int]] = {}
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                for w in features(text):
                    n.setdefault(w, [0, 0])[int(toxic > 0)] += 1
            yield pd.DataFrame({"feature": list(n), "n0": [c[0] for c in n.values()], "n1": [c[1] for c in n.values()]})

    total = rows.mapInPandas(counts, "feature binary, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= min_docs)
    ratio = F.log((F.col("n1") + 0.5) / (sizes.get(True, 0) + 1.0) / ((F.col("n0") + 0.5) / (sizes.get(False, 0) + 1.0)))
    kept = total.withColumn("ratio", ratio).where(F.abs("ratio") >= float(np.log(odds)))
    return [bytes(r.feature) for r in kept.select("feature").collect()]


def train(docs: DataFrame, labels: DataFrame, max_train: int = 2000, min_docs: int = 5, odds: float = 4.0) -> SeverityModel:
    """Fit on at most ``max_train`` labelled documents of each class, chosen by the hash of their id.

    Only the telling features of the training documents come to the driver.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for flag in (F.col("toxic") >= 1, F.col("toxic") < 1):
        part = marks.where(flag).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
        picked = part if picked is None else picked.unionByName(part)
    rows = staged(documents_of(docs, "doc_id", "text").join(picked.select("doc_id", (F.col("toxic") >= 1).cast("int").alias("toxic")), "doc_id").select("text", "toxic"), "labelled")
    vocabulary = frozenset(telling_features(rows, min_docs, odds))

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"words": [b" ".join(sorted(features(t) & vocabulary)) for t in pdf["text"]], "toxic": pdf["toxic"].astype(int)})

    return fit(sorted((bytes(r.words).split(), r.toxic) for r in rows.mapInPandas(words_of, "words binary, toxic int").toLocalIterator()), min_docs=min_docs)


def toxicity(docs: DataFrame, model: SeverityModel, threshold: float = 0.5) -> DataFrame:
    """Severity of every document; the model travels with the task (its size is bounded by the training sample)."""

    def judge(texts: list[str | None]) -> list[tuple]:
        out = []
        for mild, severe in map(model.probabilities, texts):
            toxic = mild > threshold
            out.append((mild + severe, int(toxic) + int(toxic and severe > 0.5), mild - severe, severe, toxic, not toxic))
        return out

    return by_text(docs, judge, SCHEMA)


def harmless(docs: DataFrame, model: SeverityModel, threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that the model doesn't reject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array([model.probabilities(t)[0] <= threshold for t in part.column("text").to_pylist()], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
