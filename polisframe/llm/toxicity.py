"""Toxicity by cumulative-link ordinal regression.

Severity has the grades 0 (clean), 1 (toxic) and 2 (heavily toxic). The model is P(grade <= j) = sigmoid(t_j - w x): one
weight vector, shared by the ordered thresholds t_0 < t_1, over sparse features of the text (words and their
beginnings). The label table says toxic or not; a toxic document has grade 2 if it has more of the toxic vocabulary than
the median of the toxic documents, else 1.

The fit uses a bounded, documented sample of the labelled rows (``_linear.LABELLED`` documents, ``_linear.FEATURES`` features);
the feature counts behind the selection are aggregated by Spark. Scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisframe.llm._linear import LABELLED, Vectors, descend, labelled, sample_vectors, select_features, sparse_rows, with_columns

GRADES = 3


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Severity:
    """A fitted model: feature keys, shared weights, ordered thresholds."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, active: list[list[int]]) -> np.ndarray:
        """P(grade) of each document, one row each."""
        score = np.array([self.weights[a].sum() if len(a) else 0.0 for a in active])
        below = _sigmoid(self.thresholds[None, :] - score[:, None])
        return np.diff(np.column_stack([np.zeros(len(score)), below, np.ones(len(score))]), axis=1)


def fit_cumulative(active: list[np.ndarray], grades: np.ndarray, features: int, ridge: float = 0.002) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of least penalised log loss. Thresholds are t_0, t_0 + e^u_1, ... and so keep their order.

    A feature counts by the logarithm of its rarity, so that words of many documents weigh little.
    """
    n = len(grades)
    row, col = sparse_rows(active)
    rarity = np.log((n + 1) / (np.bincount(col, minlength=features) + 1))
    share = np.array([(np.sum(grades <= j) + 0.5) / (n + 1) for j in range(GRADES - 1)])
    first = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(first), 0.1))

    def thresholds(p):
        return p[features] + np.concatenate([[0.0], np.cumsum(np.exp(p[features + 1:]))])

    def loss(p):
        w, t = p[:features], thresholds(p)
        score = np.bincount(row, (w * rarity)[col], n)
        low = np.concatenate([[-np.inf], t])[grades] - score
        high = np.concatenate([t, [np.inf]])[grades] - score
        a, b = _sigmoid(low), _sigmoid(high)
        chance = np.maximum(b - a, 1e-12)
        da, db = a * (1 - a), b * (1 - b)
        by_score = (db - da) / chance  # of the loss by the score
        by_t = np.zeros(GRADES - 1)
        for j in range(GRADES - 1):
            by_t[j] = -np.sum(db[grades == j] / chance[grades == j]) + np.sum(da[grades == j + 1] / chance[grades == j + 1])
        g = np.zeros_like(p)
        g[:features] = rarity * np.bincount(col, by_score[row], features) / n + ridge * w / max(1, features) ** 0.5
        g[features] = by_t.sum() / n
        for j in range(1, GRADES - 1):
            g[features + j] = by_t[j:].sum() * np.exp(p[features + j]) / n
        return float(-np.log(chance).mean()), g

    p = descend(loss, np.concatenate([np.zeros(features), first[:1], gaps]))
    return p[:features] * rarity, thresholds(p)


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Severity:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0/1). Without labels of either kind every
    document gets the prior of the labels there are (clean, if there are none)."""
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("toxic").cast("int") != 0).cast("int").alias("y"))
    sample = labelled(docs, marked, bound)
    counts = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    sizes = [counts.get(0, 0), counts.get(1, 0)]
    keys = select_features(sample, sizes) if min(sizes) else np.zeros(0, np.uint64)
    if not len(keys):
        share = np.clip((sizes[0] + 1) / (sum(sizes) + 1.5), 0.01, 0.99)
        return Severity(keys, np.zeros(0), np.array([np.log(share / (1 - share)), 6.0]))
    active, _, toxic = sample_vectors(sample, keys)
    # vocabulary that leans to toxic documents gives the two toxic grades
    row, col = sparse_rows(active)
    lean = np.bincount(col, toxic[row], len(keys)) / sizes[1] > 4 * np.bincount(col, 1 - toxic[row], len(keys)) / sizes[0]
    heavy = np.bincount(row, lean[col], len(toxic))
    grades = toxic + ((toxic == 1) & (heavy > np.median(heavy[toxic == 1]))).astype(np.int64)
    weights, thresholds = fit_cumulative(active, grades, len(keys))
    return Severity(keys, weights, thresholds)


def score(docs: DataFrame, model: Severity) -> DataFrame:
    """``docs`` with p_clean, p_toxic, p_heavy, expected_severity (0 to 2) and toxic (P(grade >= 1) > 1/2).

    A null or empty text has no features and so the thresholds' own probabilities; a null id stays null; repeated rows
    are scored each; other columns stay, whatever their names; no rows give no rows.
    """

    def compute(texts, _):
        p = model.probabilities([vectors(t)[0] for t in texts])
        return [p[:, 0], p[:, 1], p[:, 2], p[:, 1] + 2 * p[:, 2], p[:, 0] < 0.5]

    vectors = Vectors(model.keys)
    return with_columns(docs, {"p_clean": "double", "p_toxic": "double", "p_heavy": "double", "expected_severity": "double",
                               "toxic": "boolean"}, compute)


def clean(docs: DataFrame, model: Severity) -> DataFrame:
    """The rows of ``docs`` that the model doesn't call toxic, with their columns."""
    vectors = Vectors(model.keys)
    return with_columns(docs, {}, None, keep=lambda texts, _: model.probabilities([vectors(t)[0] for t in texts])[:, 0] >= 0.5)
