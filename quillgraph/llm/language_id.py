"""Language identification by error-correcting output codes.

Every language has a codeword of +1/-1 bits. One binary logistic classifier per bit reads hashed byte n-grams of the
text and predicts that bit; decoding sums the logistic loss of all bits against each codeword and takes the nearest.
A document whose two best codewords are almost equally near is flagged as ambiguous.

The fit fetches about ``max_train`` documents in all, spread evenly over the languages by the hash of their id (with very
many languages ``least`` of each); prediction covers whole texts of all rows.

Edge cases: ``und`` with score 0 for a text that is null or has no letter, and for every text if there is no language
to learn; a single learned language is predicted for all other texts. Null ids are never trained on but predicted;
repeated rows are predicted each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_text, documents_of

DIM = 1 << 13
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean, bits_off int"
_maybe = re.compile(r"[^\W\d_]")
_plain = np.arange(256, dtype=np.uint32)
_plain[[i for i in range(128) if not chr(i).isalpha()]] = 32


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: str) -> bool:
    """Whether any character is a letter; numerals such as fractions and Roman numbers are none."""
    return any(m[0].isalpha() for m in _maybe.finditer(text))


def ngram_counts(text: str, dim: int = DIM) -> np.ndarray:
    """Counts of hashed 1- to 4-byte windows of the lower-cased text; anything but letters counts as a space."""
    b = _plain[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    counts = np.zeros(dim, np.int64)
    code = b.copy()
    for n in range(1, 5):
        if n > 1:
            code = code[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :]
        if len(code):
            counts += np.bincount(((code * np.uint32(2654435761) + np.uint32(n)) >> np.uint32(19)).astype(np.int64) % dim, minlength=dim)
    return counts


def vector(counts: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts.astype(np.float32))
    return v / max(float(np.linalg.norm(v)), 1e-9)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +1/-1: all splits into two for up to 5 languages, else random columns kept if they separate best."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        return np.array([[1, *bits] for bits in itertools.product((1, -1), repeat=k - 1) if -1 in bits]).T
    draw = np.random.default_rng(seed)
    length = int(np.ceil(10 * np.log2(k)))
    best, apart = None, -1
    for _ in range(200):
        c = draw.choice([-1, 1], size=(k, length))
        c = c[:, np.abs(c.sum(1 - 1)) < k]  # every bit splits the languages
        d = min(int((a != b).sum()) for a, b in itertools.combinations(c, 2))
        if d > apart:
            best, apart = c, d
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray  #: languages x bits
    weights: np.ndarray  #: features x bits
    bias: np.ndarray

    def predict(self, text: str | None, margin: float = 0.15) -> tuple[str, float, bool, int]:
        """Language, score, ambiguity, and how many bits disagree with the chosen codeword."""
        if not self.languages or not text or not has_letter(text):
            return "und", 0.0, False, 0
        f = vector(ngram_counts(text)) @ self.weights + self.bias
        loss = np.logaddexp(0, -self.codes * f).sum(1)
        order = np.argsort(loss, kind="stable")
        p = np.exp(loss[order[0]] - loss)
        score = float(1 / p.sum())
        close = len(order) > 1 and float(loss[order[1]] - loss[order[0]]) < margin * self.codes.shape[1]
        return self.languages[order[0]], score, close, int((np.sign(f) != self.codes[order[0]]).sum())


def fit(x: np.ndarray, y: list[str], steps: int = 300, rate: float = 8.0, l2: float = 1e-5) -> LanguageModel:
    """All bit classifiers at once by gradient steps with momentum; each language weighs the same."""
    languages = sorted(set(y))
    codes = codewords(len(languages)).astype(float)
    at = np.array([languages.index(v) for v in y], int)
    n_bits = codes.shape[1] if len(languages) else 1
    w, b = np.zeros((x.shape[1], n_bits), np.float32), np.zeros(n_bits)
    if len(languages) > 1:
        share = (1 / np.bincount(at)[at] / len(languages))[:, None]
        target, vw, vb = codes[at], np.zeros_like(w), np.zeros_like(b)
        for _ in range(steps):
            f = x @ w + b
            g = (-target * share / (1 + np.exp(np.clip(target * f, -40, 40)))).astype(np.float32)
            vw = 0.9 * vw - rate * (x.T @ g + l2 * w)
            vb = 0.9 * vb - 0.1 * rate * g.sum(0)
            w, b = w + vw, b + vb
    elif languages:
        b += 5
    return LanguageModel(languages, codes, w.astype(np.float32), b)


def train(docs: DataFrame, max_train: int = 2000, least: int = 20) -> LanguageModel:
    """Learn from text and lang of the documents that are not held out.

    The sample holds about ``max_train`` documents, and about ``least`` of each language if that is more. It is drawn by the
    hash of the id in the scan itself: the share of each language (from counts over the whole table, one row per
    language) is a literal, so no text is shuffled.
    """
    rows = documents_of(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit(np.zeros((0, DIM), np.float32), [])
    each = max(least, max_train / len(counts))
    share = F.element_at(F.create_map(*[F.lit(x) for v, n in sorted(counts.items()) for x in (v, int(min(1.0, each / n) * (1 << 20)))]), F.col("lang"))
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)

    def counted(texts: list[str | None]) -> list[tuple]:
        out = []
        for t in texts:
            c = ngram_counts(t)
            at = np.flatnonzero(c)
            out.append((has_letter(t), at.astype("<u2").tobytes(), c[at].astype("<u4").tobytes()))
        return out

    sample = by_text(picked, counted, "lang string, lettered boolean, at binary, n binary", ("lang",)).where("lettered").collect()
    sample.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["n"])))
    x = np.zeros((len(sample), DIM), np.float32)
    for i, r in enumerate(sample):
        c = np.zeros(DIM)
        c[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<u4")
        x[i] = vector(c)
    return fit(x, [r["lang"] for r in sample])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Predict every document; a narrow map. The model is DIM x bits floats, whatever the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return by_text(rows, lambda texts: [shared.value.predict(t) for t in texts], SCHEMA, ("doc_id", "held_out"))
