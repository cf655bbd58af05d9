"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models; each model
reads the text's features and the probabilities of the categories before it.
While learning, those come from out-of-fold predictions, so that a later model
sees earlier probabilities as unsure as they will be on new texts. Learning
reads at most ``PER_CLASS`` toxic and as many other texts; scoring is a map
over all rows.

The categories that the labels can tell apart: toxic (any kind), toxic_prose
(in otherwise good text) and toxic_junk (in text of low quality).

Defined cases: null and empty texts get the score of a text without features;
without labels every probability is 0, with one class the share of it; rows of
``labels`` that repeat an id count by their mean; a null quality counts as
good; repeated rows score alike; an empty table gives an empty result; extra
columns are kept by ``drop_toxic`` and not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.llm.features import bounded_sample, bucket_counts, indicators, sample_matrix
from bazaar.llm.scratch import small_batches, stage

#: Bounds: texts to learn from (toxic, and as many others), features.
PER_CLASS = 2000
FEATURES = 900
FOLDS = 5
CATEGORIES = ("toxic", "toxic_prose", "toxic_junk")
#: A text is toxic from this probability on: labels name too few toxic texts
#: for higher ones, and clean texts stay far below.
THRESHOLD = 0.3


class Link(NamedTuple):
    """One model of the chain: weights of the features, of the earlier
    categories' log-odds, and the bias."""
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


class Chain(NamedTuple):
    selected: np.ndarray
    links: tuple[Link, ...]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 3.0,
                 steps: int = 150) -> np.ndarray:
    """Weights (last: bias) of a ridge logistic regression, by accelerated
    gradient steps. Of a single class: its share as the bias."""
    out = np.zeros(x.shape[1] + 1, np.float32)
    if not len(y) or y.min() == y.max():
        out[-1] = -8.0 if not len(y) or not y.max() else 8.0
        return out
    z = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    # The largest curvature, by power iterations.
    v = np.ones(z.shape[1], np.float32)
    for _ in range(12):
        v = z.T @ (weight * (z @ v))
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * float(v @ (z.T @ (weight * (z @ v)))) + ridge)
    keep = np.full(z.shape[1], ridge, np.float32)
    keep[-1] = 0
    ahead = out.copy()
    for k in range(steps):
        g = z.T @ (weight * (_sigmoid(z @ ahead) - y)).astype(np.float32) + keep * ahead
        new = ahead - rate * g
        ahead = new + (k / (k + 3)) * (new - out)
        out = new
    return out


def fit_chain(x: np.ndarray, ys: list[np.ndarray], weight: np.ndarray, fold: np.ndarray) -> list[Link]:
    x = x.astype(np.float32)
    weight = weight.astype(np.float32)
    earlier = np.zeros((len(x), 0), np.float32)
    links = []
    for y in ys:
        y = y.astype(np.float32)
        z = np.concatenate([x, earlier], axis=1)
        out_of_fold = np.zeros(len(x))
        for k in np.unique(fold):
            b = fit_logistic(z[fold != k], y[fold != k], weight[fold != k])
            out_of_fold[fold == k] = _sigmoid(z[fold == k] @ b[:-1] + b[-1])
        b = fit_logistic(z, y, weight)
        links.append(Link(b[:x.shape[1]], b[x.shape[1]:-1], float(b[-1])))
        earlier = np.concatenate([earlier, _log_odds(out_of_fold)[:, None].astype(np.float32)], axis=1)
    return links


def predict_chain(x: np.ndarray, links: tuple[Link, ...]) -> np.ndarray:
    """Probabilities, a column for each category."""
    p = np.zeros((len(x), len(links)))
    for k, link in enumerate(links):
        p[:, k] = _sigmoid(x @ link.weights + _log_odds(p[:, :k]) @ link.earlier + link.bias)
    return p


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        per_class: int = PER_CLASS, features: int = FEATURES) -> Chain:
    small_batches(docs)
    lab = labels.where(F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.round(F.avg("toxic")).cast("int").alias("toxic"),
        F.coalesce(F.round(F.avg("quality")), F.lit(1)).cast("int").alias("quality"))
    # Classes: 0 not toxic, 1 toxic prose, 2 toxic junk.
    lab = lab.withColumn("cls", F.when(F.col("toxic") == 0, 0).otherwise(2 - F.col("quality")))
    sample = stage(bounded_sample(docs, lab, "toxic", (0, 1), per_class, id_col, text_col), "toxicity-sample")
    have = {r["cls"]: float(r["count"]) for r in sample.groupBy("cls").count().collect()}
    rate = lab.agg(F.avg("toxic").alias("r")).first()["r"] or 0.0
    total = sum(have.values())
    if not total or have.get(0, 0.0) in (0.0, total):
        bias = -30.0 if rate < 0.5 else 30.0
        none = Link(np.zeros(0), np.zeros(0), bias)
        return Chain(np.zeros(0, np.int64), tuple(
            none._replace(earlier=np.zeros(k)) for k in range(len(CATEGORIES))))

    # For each category the buckets of the clearest log-odds difference.
    counts = stage(bucket_counts(sample, 3, stems=True), "toxicity-counts")
    picked: set[int] = set()
    for members in ((1, 2), (1,), (2,)):
        n1 = sum(have.get(c, 0.0) for c in members)
        a = sum(F.col(f"n{c}") for c in members) + 0.5
        b = sum(F.col(f"n{c}") for c in range(3) if c not in members) + 0.5
        c, d = F.lit(n1 + 1) - a, F.lit(total - n1 + 1) - b
        z = F.log(a * d / (b * c)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        top = counts.orderBy(F.abs(z).desc(), "bucket").limit(features // 3).collect()
        picked |= {r["bucket"] for r in top}
    selected = np.array(sorted(picked), np.int64)
    x, got = sample_matrix(sample, selected, ["id", "cls"])
    cls = got["cls"]
    ys = [cls > 0, cls == 1, cls == 2]
    weight = np.where(cls > 0, rate / max((cls > 0).mean(), 1e-9), (1 - rate) / max((cls == 0).mean(), 1e-9))
    return Chain(selected, tuple(fit_chain(x, ys, weight, np.arange(len(x)) % FOLDS)))


def probabilities(text: Column, chain: Chain) -> Column:
    """Struct of the categories' probabilities for a text column."""
    @F.arrow_udf(", ".join(f"{c} double" for c in CATEGORIES))
    def score_(texts: pa.Array) -> pa.Array:
        p = np.zeros((len(texts), len(CATEGORIES)))
        for first, m in indicators(texts, chain.selected):
            p[first:first + len(m)] = predict_chain(m.astype(np.float32), chain.links)
        return pa.StructArray.from_arrays([pa.array(p[:, k]) for k in range(len(CATEGORIES))], list(CATEGORIES))

    return score_(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``id_col``, the categories' probabilities, and
    ``predicted``: 1 if that of toxic reaches the threshold."""
    p = docs.select(id_col, probabilities(F.col(text_col), fit(docs, labels, id_col, text_col)).alias("_p"))
    return p.select(id_col, *[F.col(f"_p.{c}").alias(f"p_{c}") for c in CATEGORIES],
                    F.when(F.col("_p.toxic") >= threshold, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all columns."""
    chain = fit(docs, labels, id_col, text_col)
    return docs.where(probabilities(F.col(text_col), chain).getField("toxic") < threshold)
