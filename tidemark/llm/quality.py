"""Quality scores learned from preference pairs (Bradley-Terry).

Documents labelled good are preferred to documents labelled bad. A document's
strength is linear in piecewise-linear hat functions of text statistics; its
weights minimise the logistic loss of strength differences over preference
pairs. The cut is a quantile of the fit rows' strengths, and strengths become
scores by a logistic curve that is 0.7 at the cut, so ``score >= 0.7`` is the cut.

Bounds: the model is fitted on at most ``max_fit`` labelled rows (a parameter),
those with the smallest hash of doc_id; the driver holds their features only.
Scoring covers every row. Language, source, labels and doc_id are no inputs.

Defined results: null text counts as empty and is scored; rows whose labels
contradict each other are not learned from; without good or bad rows every score
is 0.5; equal texts have equal scores; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, texts

CUT = 0.7
MAX_FIT, PAIRS, KNOTS, STEPS = 12_000, 60_000, 9, 300
#: Bytes whose shares are features, besides classes of bytes.
SIGNS = b"!%*&$|#.,?;:-_=+<>{}[]()/\\@\"'~^"
NAMES = ["bytes", "words", "word_length", "upper", "digit", "space", "lines", "high", "control", "distinct", "repeated_lines", "repeated_sentences", "marked", "shouted", "single", "runs", *(f"sign_{chr(b)}" for b in SIGNS)]


def features(text: str) -> list[float]:
    """Statistics of the whole text, in the order of NAMES."""
    raw = text.encode()
    n = max(len(raw), 1)
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    k = max(len(words), 1)
    upper, lower = int(h[65:91].sum()), int(h[97:123].sum())
    lines = [x for x in text.split("\n") if x]
    sentences = [x.strip() for x in text.replace("\n", ".").split(".") if len(x) > 12]
    distinct = len(set(words))
    marked = sum(not x[-1].isalnum() and not x[-2:-1].isalnum() for x in words if len(x) > 1)
    shouted = sum(x.isupper() for x in words if len(x) > 1)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), len(text) / k, upper / max(upper + lower, 1), h[48:58].sum() / n, (h[32] + h[9:14].sum()) / n,
        np.log1p(h[10] / n * 1000), h[128:].sum() / n, (h[:9].sum() + h[14:32].sum() + h[127]) / n, np.log1p(k) - np.log1p(distinct), 1 - len(set(lines)) / max(len(lines), 1),
        1 - len(set(sentences)) / max(len(sentences), 1), marked / k, shouted / k, sum(len(x) == 1 for x in words) / k, sum(a == b for a, b in zip(words, words[1:], strict=False)) / k, *(h[list(SIGNS)] / n),
    ]


@dataclass
class Ranker:
    """Hat-function knots, weights, the cut and the scale; small enough to travel in a task's closure."""

    knots: np.ndarray  # (features, KNOTS), rising
    weights: np.ndarray  # (features, KNOTS)
    cut: float = 0.0
    scale: float = 1.0

    def hats(self, x: np.ndarray) -> np.ndarray:
        """(rows, features, KNOTS): each value's two neighbouring knots share a weight of one."""
        out = np.zeros((*x.shape, self.knots.shape[1]))
        for j, k in enumerate(self.knots):
            v = np.clip(x[:, j], k[0], k[-1])
            i = np.clip(np.searchsorted(k, v, side="right") - 1, 0, len(k) - 2)
            f = (v - k[i]) / np.maximum(k[i + 1] - k[i], 1e-12)
            rows = np.arange(len(x))
            out[rows, j, i], out[rows, j, i + 1] = 1 - f, f
        return out

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("rfk,fk->r", self.hats(x), self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.scale * (self.strength(x) - self.cut) + np.log(CUT / (1 - CUT)), -30, 30)
        return 1 / (1 + np.exp(-z))


def fit_ranker(x: np.ndarray, good: np.ndarray, quantile: float | None = None, pairs: int = PAIRS, steps: int = STEPS, seed: int = 7) -> Ranker:
    """Bradley-Terry weights of features x. The cut is the given quantile of strengths, or that of the grid with most fit rows on their right side."""
    levels = np.linspace(0, 1, KNOTS)
    knots = np.quantile(x, levels, axis=0).T if len(x) else np.zeros((len(NAMES), KNOTS))
    span = np.stack([x.min(0), x.max(0)], 1) if len(x) else np.zeros((len(NAMES), 2))
    knots = np.sort(0.5 * knots + 0.5 * (span[:, :1] + (span[:, 1:] - span[:, :1]) * levels**2), axis=1)  # rare values get knots too
    model = Ranker(knots, np.zeros_like(knots))
    if good.all() or not good.any():
        model.scale = 0.0
        return _flat(model)
    rng = np.random.default_rng(seed)
    h = model.hats(x).reshape(len(x), -1)
    a, b = rng.choice(np.flatnonzero(good), pairs), rng.choice(np.flatnonzero(~good), pairs)
    w, m, v = np.zeros(h.shape[1]), np.zeros(h.shape[1]), np.zeros(h.shape[1])
    for t in range(1, steps + 1):
        s = h @ w
        pull = 1 / (1 + np.exp(np.clip(s[a] - s[b], -30, 30)))  # the loss's slope for each pair
        share = np.bincount(a, pull, len(x)) - np.bincount(b, pull, len(x))
        g = -(share @ h) / pairs + 2e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    model.weights = w.reshape(knots.shape)
    s = h @ w
    if quantile is None:
        grid = np.linspace(0.002, 0.998, 499)
        # a good row that is rejected costs as much as a bad one that stays
        right = [(good & (s >= c)).sum() / good.sum() + (~good & (s < c)).sum() / (~good).sum() for c in np.quantile(s, grid)]
        quantile = float(grid[int(np.argmax(np.array(right) >= max(right) - 0.004))])  # the lowest as good as the best: clean rows stay
    model.cut = float(np.quantile(s, quantile))
    spread = np.median(np.abs(s - model.cut))
    model.scale = float(2 / spread) if spread > 0 else 1.0
    return model


def _flat(model: Ranker) -> Ranker:
    """Every score is 0.5."""
    model.cut, model.scale = float(np.log(CUT / (1 - CUT))), 1.0
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT, folds: int = 4) -> Ranker:
    """Fit on labelled rows outside the held-out fold, at most max_fit of them."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out("doc_id", folds))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("high")).where("quality = high").drop("high")
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit)  # a bounded side, so it may be broadcast
    rows = texts(docs).join(F.broadcast(few), "doc_id").select("quality", "text").mapInArrow(_measure, "quality int, x array<double>").toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(NAMES))
    return fit_ranker(x, rows["quality"].to_numpy() == 1)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[float(v) for v in features(t)] for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["quality", "x"])


def score_quality(docs: DataFrame, model: Ranker, name: str = "score") -> DataFrame:
    """All columns of docs and the score, a double, in a column of that name."""
    schema = docs.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t or "") for t in b.column(b.schema.get_field_index("text")).to_pylist()], float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x))], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = fit_quality(docs, labels)
    return score_quality(texts(docs), model).select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
