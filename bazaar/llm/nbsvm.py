"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams (plain words, byte trigrams, runs of one word) are
scaled by the log-ratio of their class counts; a linear hinge-loss model is
fitted to the scaled indicators by dual coordinate descent, and out-of-fold
margins are turned into probabilities by a logistic fit. Learning reads at
most ``PER_CLASS`` texts of each class; scoring is a map over all rows.

Defined cases: null and empty texts get the score of a text without features;
without labelled rows every score is 0.5, with one class only 0 or 1; rows of
``labels`` that repeat an id count by their mean; repeated rows score alike;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.llm.features import bounded_sample, bucket_counts, indicators, sample_matrix
from bazaar.llm.scratch import small_batches, stage

#: Bounds: labelled texts of each class to learn from, n-grams in the model.
PER_CLASS = 3000
FEATURES = 4096
FOLDS = 3


class Model(NamedTuple):
    selected: np.ndarray    # buckets
    weights: np.ndarray     # log-ratio times fitted weight, by bucket
    bias: float
    slope: float
    offset: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -35, 35)))


def log_ratio(pos: np.ndarray, neg: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = pos + smooth, neg + smooth
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, c: float = 0.1,
                            epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model of least 1/2 |w|^2 + c * hinge loss.
    Row i has value ``scale[j]`` at its indices j and 1 at the bias; each step
    solves for one dual variable, kept in [0, c]."""
    w, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([np.square(scale[r]).sum() + 1.0 for r in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, x = rows[i], scale[rows[i]]
            gradient = y[i] * (w[r] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), c)
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * x
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4 * c:
            break
    return w, bias


def _logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic fit, targets a little inside
    0 and 1 as usual for such small fits."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        g = x.T @ (weight * (p - target)) + 1e-6 * b
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 0.0)), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, label: Column, id_col: str = "doc_id",
        text_col: str = "text", per_class: int = PER_CLASS, features: int = FEATURES) -> Model:
    small_batches(docs)
    labelled = labels.select(F.col(id_col).alias("id"), label.alias("label")).where("label is not null") \
        .groupBy("id").agg(F.round(F.avg("label")).cast("int").alias("cls"))
    rates = labelled.agg(F.avg("cls").alias("rate")).first()["rate"]
    none = np.zeros(0, np.int64)
    sample = stage(bounded_sample(docs, labelled, "cls", (0, 1), per_class, id_col, text_col), "quality-sample")
    have = {r["cls"]: r["count"] for r in sample.groupBy("cls").count().collect()}
    if len(have) < 2:
        certain = 0.0 if not have else 35.0 if 1 in have else -35.0
        return Model(none, none.astype(float), 0.0, 0.0, certain)
    # The buckets whose presence tells the classes apart best (chi-squared).
    counts = bucket_counts(sample, 2)
    n0, n1 = float(have[0]), float(have[1])
    a, b = F.col("n1"), F.col("n0")
    gap = a * F.lit(n0) - b * F.lit(n1)
    held = a + b
    chi = gap * gap / (held * (F.lit(n0 + n1) - held) + 1.0)
    top = counts.where(held >= 3).orderBy(chi.desc(), "bucket").limit(features).collect()
    top.sort(key=lambda r: r["bucket"])
    selected = np.array([r["bucket"] for r in top], np.int64)
    x, got = sample_matrix(sample, selected, ["id", "cls"])
    y = np.where(got["cls"] == 1, 1.0, -1.0)
    rows = [np.flatnonzero(r) for r in x]

    def train(use: np.ndarray) -> tuple[np.ndarray, float]:
        pos, neg = x[use & (y > 0)].sum(axis=0), x[use & (y < 0)].sum(axis=0)
        scale = log_ratio(pos, neg)
        w, bias = dual_coordinate_descent([r for r, u in zip(rows, use, strict=True) if u], scale, y[use])
        return w * scale, bias

    fold = np.arange(len(y)) % FOLDS
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        w, bias = train(fold != k)
        margin[fold == k] = x[fold == k] @ w + bias
    # The sample takes classes evenly; the fit restores their real shares.
    share = np.where(y > 0, rates / (y > 0).mean(), (1 - rates) / (y < 0).mean())
    slope, offset = _logistic(margin, y, share)
    w, bias = train(np.ones(len(y), bool))
    return Model(selected, w, bias, slope, offset)


def score(text: Column, model: Model) -> Column:
    """Probability of label 1 for a text column."""
    @F.arrow_udf("double")
    def score_(texts: pa.Array) -> pa.Array:
        margin = np.full(len(texts), model.bias)
        for first, m in indicators(texts, model.selected):
            margin[first:first + len(m)] += m @ model.weights
        return pa.array(model.probability(margin))

    return score_(text)


def held_out(id_col: str) -> Column:
    """True for the fifth of the ids that no model may learn from."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % 5 == 0


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = 0.3) -> DataFrame:
    """One row per input row: ``id_col``, held_out, score, predicted."""
    model = fit(docs, labels.where(~held_out(id_col)), F.col("quality"), id_col, text_col)
    out = docs.select(id_col, held_out(id_col).alias("held_out"), score(F.col(text_col), model).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
