"""Quality by a regularised quadratic discriminant over document statistics.

Twenty statistics of a whole text (lengths, character classes, repetition of words, word
triples and lines, marks hung on words) are transformed so that they are closer to normal:
counts by logarithm, shares by the arcsine of their root. Each class gets a mean and a
covariance shrunk towards the pooled one and towards its diagonal; the amounts are chosen on a
part of the fitting rows. A score is the logistic of the difference of the two log densities,
each a Mahalanobis distance through a Cholesky factor that is computed once, plus the log
prior, tempered on the same part.

The fit uses at most ``SAMPLE_ROWS`` labelled texts per class outside the held-out fold; every
text is scored whole. A null text counts as empty, an empty text has statistics of zero and a
score like any other; without labels of both classes every score is 0.5. Repeated rows score
alike, an empty table gives an empty result.
"""

from __future__ import annotations

import operator
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lagline.llm import labelled
from lagline.llm.common import narrow

FOLDS, FOLD = 3, 1
SAMPLE_ROWS = 4000
LONGEST = 200_000
SHRINKAGE = (0.02, 0.1, 0.3, 0.6, 0.9)
DIAGONAL = (0.01, 0.1, 0.3)

_RUN = re.compile(rb"[!-/:-@\[-`{-~]{2,}(?=\s|$)")
_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK &= ~(_UPPER | _LOWER | _DIGIT)


def statistics(text: bytes) -> np.ndarray:
    """The transformed statistics of one text."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(20)
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = int(kinds.sum())
    upper, lower, digit, mark = (int(kinds[k].sum()) for k in (_UPPER, _LOWER, _DIGIT, _MARK))
    high, breaks = int(kinds[128:].sum()), int(kinds[10])
    letters = max(1, upper + lower)
    often = Counter(words)
    distinct = len(often)
    top = often.most_common(1)[0][1]
    same = sum(map(operator.eq, words, words[1:]))
    triples = max(1, n - 2)
    kept_triples = len(set(zip(words, words[1:], words[2:]))) if n > 2 else 1
    lines = [line for line in text.split(b"\n") if line]
    runs = len(_RUN.findall(text))
    longest = max(map(len, often))
    shares = (
        upper / letters, digit / size, mark / size, high / size, distinct / n, top / n, same / max(1, n - 1),
        1 - kept_triples / triples, runs / n, 1 - len(set(lines)) / len(lines), kinds[124] / n,
        (kinds[46] + kinds[33] + kinds[63]) / n, kinds[44] / n,
        sum(v for w, v in often.items() if len(w) <= 3) / n,
    )
    counts = (n, size / n, breaks, n / len(lines), longest, distinct / np.sqrt(n))
    return np.r_[np.arcsin(np.sqrt(np.clip(shares, 0, 1))), np.log1p(counts)]


class Discriminant:
    """Two classes, each with its mean, Cholesky factor and log determinant."""

    def __init__(self):
        self.classes: list[tuple[np.ndarray, np.ndarray, float]] = []
        self.prior, self.slope, self.offset = 0.0, 1.0, 0.0

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 over class 0, with the log prior, per row."""
        x = (x - self.centre) / self.spread
        densities = []
        for mean, inverse, log_det in self.classes:
            z = (x - mean) @ inverse.T
            densities.append(-0.5 * (z * z).sum(axis=1) - log_det)
        return densities[1] - densities[0] + self.prior

    def _estimate(self, x, y, shrink, diagonal) -> None:
        z = (x - self.centre) / self.spread
        groups = [z[y == c] for c in (0, 1)]
        own = [np.cov(g, rowvar=False) for g in groups]
        pooled = sum(len(g) * s for g, s in zip(groups, own)) / len(z)
        self.classes = []
        for g, s in zip(groups, own):
            mixed = (1 - shrink) * s + shrink * pooled
            mixed = (1 - diagonal) * mixed + diagonal * np.diag(np.diag(mixed)) + 1e-3 * np.eye(len(mixed))
            factor = np.linalg.cholesky(mixed)
            inverse = np.linalg.solve(factor, np.eye(len(mixed)))  # cached: scoring multiplies only
            self.classes.append((g.mean(axis=0), inverse, float(np.log(np.diag(factor)).sum())))

    def fit(self, x: np.ndarray, y: np.ndarray, share: float) -> None:
        """``share`` is the class 1 share among all labelled rows, whatever the sample's."""
        self.centre, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.prior = float(np.log(share / (1 - share)))
        weight = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
        check = np.arange(len(y)) % 4 == 3
        best = None
        for shrink in SHRINKAGE:
            for diagonal in DIAGONAL:
                self._estimate(x[~check], y[~check], shrink, diagonal)
                ratio = self.log_ratio(x[check])
                design = np.c_[np.ones(check.sum()), np.sign(ratio) * np.log1p(np.abs(ratio))]
                beta = labelled.logistic(design, y[check], weight[check])
                p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
                loss = -np.average(np.log(np.where(y[check] == 1, p, 1 - p) + 1e-9), weights=weight[check])
                if best is None or loss < best[0]:
                    best = loss, shrink, diagonal, beta
        _, self.shrink, self.diagonal, (self.offset, self.slope) = best
        self._estimate(x, y, self.shrink, self.diagonal)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), 0.5)
        ratio = self.log_ratio(x)
        z = self.offset + self.slope * np.sign(ratio) * np.log1p(np.abs(ratio))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Discriminant:
    """The statistics are taken where the texts are; twenty numbers per sampled text come back."""
    found, counts = labelled.chosen(docs, labels, "quality", FOLDS, FOLD, rows, LONGEST)
    model = Discriminant()
    if found is None:
        return model

    def run(batches):
        for batch in batches:
            x = [statistics(t.as_py()).tolist() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["label", "doc_id", "x"])

    ready = found.select("label", "doc_id", F.col("text").cast("binary").alias("text"))
    kept = ready.mapInArrow(run, "label string, doc_id long, x array<double>").orderBy("doc_id", "x").collect()
    kept = [r for r in kept if r["label"] in ("0", "1")]
    y = np.array([int(r["label"]) for r in kept])
    if (y == 0).sum() > 1 and (y == 1).sum() > 1:
        x = np.array([r["x"] for r in kept])
        order = np.random.default_rng(1).permutation(len(y))
        model.fit(x[order], y[order], counts["1"] / (counts["0"] + counts["1"]))
    return model


def scores(docs: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t.as_py()) for t in batch.column(1)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], schema=schema)

    return narrow(docs).mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        labelled.held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
