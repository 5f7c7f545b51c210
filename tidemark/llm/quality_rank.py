"""Operator 3: a quality classifier that learns a ranking (Bradley-Terry).

Pairs of a good and a bad labelled text are preferences; the score is linear in features
of the text and minimises the logistic loss of the pairs' feature differences. The
threshold is a quantile of the scores of the labelled texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_fold, labelled_rows, small_batches

FEATURES = (
    "log_words", "short", "mean_word", "symbols", "marks", "capitals", "digits", "repeated_words", "repeated_lines",
    "variety", "top_word", "small_words", "stops", "commas", "bars", "odd_ends", "worst_symbols", "worst_capitals", "worst_marks", "line_words",
)
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_MARKS = re.compile(r"[!?]")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGITS = re.compile(r"[0-9]")


def features(text: str | None) -> list[float]:
    """Shares of a whole text that tell its form; texts without words give zeros but for ``short``."""
    text = text or ""
    words = text.split()
    n, c = len(words), max(1, len(text))
    if not n:
        return [0.0, 1.0, *[0.0] * (len(FEATURES) - 2)]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    triples = list(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    symbols, marks, capitals = (len(p.findall(text)) for p in (_SYMBOLS, _MARKS, _CAPITALS))
    worst = [0.0, 0.0, 0.0]
    for x in lines if symbols + marks + capitals > 0.08 * c else ():
        if len(x) >= 20:
            worst = [max(v, len(p.findall(x)) / len(x)) for v, p in zip(worst, (_SYMBOLS, _CAPITALS, _MARKS), strict=True)]
    return [
        math.log(n), float(n < 50), min(30, (c - n) / n), symbols / c, marks / c, capitals / c, len(_DIGITS.findall(text)) / c,
        1 - len(set(triples)) / len(triples) if triples else 0.0, 1 - len(set(lines)) / len(lines), len(counts) / min(n, 400), max(counts.values()) / n,
        sum(v for w, v in counts.items() if len(w) <= 3) / n, text.count(".") / n, text.count(",") / n, text.count("|") / n,
        sum(v for w, v in counts.items() if not (w[-1].isalnum() or w[-1] in ".,;:")) / n, *worst, min(3.0, math.log1p(n / len(lines)) / 2),
    ]


@dataclass
class Ranking:
    """Weights on standardised features; ``cut`` is the score of the threshold, ``scale`` its steepness."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights

    def score(self, x: np.ndarray, at: float) -> np.ndarray:
        """In 0 to 1, and ``at`` exactly at the threshold."""
        z = self.scale * (self.raw(x) - self.cut) + math.log(at / (1 - at))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def loss(w: np.ndarray, d: np.ndarray, decay: float) -> float:
    """The mean logistic loss of pairs' feature differences ``d`` (better minus worse), with half of ``decay`` times the squared weights."""
    return float(np.logaddexp(0, -(d @ w)).mean() + decay * (w @ w) / 2)


def gradient(w: np.ndarray, d: np.ndarray, decay: float) -> np.ndarray:
    return -(d * (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))[:, None]).mean(axis=0) + decay * w


def fit(x: np.ndarray, y: np.ndarray, *, quantile: float | None = None, rounds: int = 400, pairs: int = 4096, decay: float = 1e-3, seed: int = 42) -> Ranking | None:
    """Gradient descent on pairs drawn anew each round; None if a class is missing.

    The threshold is the ``quantile`` of all scores, by default the one whose balanced
    accuracy on the labelled rows is best.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    rng = np.random.default_rng(seed)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / spread, -8, 8)
    w, m, v = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for t in range(1, rounds + 1):
        d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        g = gradient(w, d, decay)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    s = z @ w
    if quantile is None:
        tried = np.unique(np.quantile(s, np.linspace(0.005, 0.995, 199)))
        balanced = [((s[good] >= c).mean() + (s[bad] < c).mean()) / 2 for c in tried]
        best = np.flatnonzero(np.isclose(balanced, max(balanced)))
        cut = float(tried[best[len(best) // 2]])
    else:
        cut = float(np.quantile(s, quantile))
    return Ranking(mean, spread, w, cut, 4 / (s.std() + 1e-9))


def train_ranking(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = 5, held_out: int = 0, per_class: int = 3000, max_chars: int = 50_000) -> Ranking | None:
    """Learns from at most ``per_class`` labelled texts of each class outside the held-out fold; their features alone reach the driver."""
    rows = labelled_rows(docs, labels, label, folds=folds, held_out=held_out, per_class=per_class, max_chars=max_chars)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    found = rows.select(F.col("doc_id").cast("long"), "text", "label").mapInArrow(run, "doc_id long, label int, x array<double>").orderBy("doc_id").collect()
    return fit(np.array([r["x"] for r in found]), np.array([r["label"] for r in found])) if found else None


def score_quality(docs: DataFrame, model: Ranking | None, *, least: float = 0.3) -> DataFrame:
    """One row for each row of ``docs``: doc_id, score, predicted (1 if score >= ``least``).

    ``docs`` needs doc_id and text; other columns are left out and never are inputs.
    Null and empty texts are scored as texts without words. Without a model (no labels,
    or of one class only) every score is 0.5. An empty table gives no row.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                s = np.full(batch.num_rows, 0.5)
            elif batch.num_rows:
                s = model.score(np.array([features(t) for t in batch.column(1).to_pylist()]), least)
            else:
                continue
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.withColumn("predicted", (F.col("score") >= least).cast("int"))


def held_out(folds: int, fold: int):
    """True for rows whose doc_id falls in the held-out fold; false for a null doc_id."""
    return F.coalesce(crc_fold(F.col("doc_id"), folds) == fold, F.lit(False))
