"""Mixing to target weights by soft membership.

A softmax classifier, fitted on a bounded sample of a label table, gives every document a posterior over the domains. Its
tokens count for each domain in proportion. Rates r_i >= 0 are sought for which the expected token totals of the
domains, sum_i r_i n_i p_ik, meet the targets: weighted least squares by projected gradient. The gradient by r_i, taken in the
metric of n_i and of the domains' Gram matrix, is p_i . g with one small vector g for all documents, so a step is one aggregate of K
numbers over the documents, and the rates follow from the few vectors g by arithmetic in the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polisframe.llm._linear import LABELLED, SHAPE, Vectors, descend, labelled, sample_vectors, select_features, sparse_rows, with_columns
from polisframe.llm._shared import stored


@dataclass
class Membership:
    """A fitted softmax model over selected features and the scaled shape of a text."""

    keys: np.ndarray
    weights: np.ndarray  # (features + shape + 1) x domains
    centre: np.ndarray
    spread: np.ndarray

    def posteriors(self, active: list[list[int]], shapes: np.ndarray) -> np.ndarray:
        n = len(self.keys)
        score = ((shapes - self.centre) / self.spread) @ self.weights[n:n + SHAPE] + self.weights[-1]
        for i, a in enumerate(active):
            if len(a):
                score[i] += self.weights[a].sum(axis=0)
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, labels: DataFrame, domains: int, bound: int = LABELLED) -> Membership:
    """Learn domain posteriors from ``docs`` (doc_id, text) and ``labels`` (doc_id, domain 0 ...). A domain without
    labels has a small probability everywhere; without any label all domains are equally likely."""
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("domain").alias("y")).where(F.col("y").between(0, domains - 1))
    sample = labelled(docs, marked, bound)
    counts = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    sizes = [counts.get(c, 0) for c in range(domains)]
    several = sum(s > 0 for s in sizes) > 1
    keys = select_features(sample, sizes) if several else np.zeros(0, np.uint64)
    prior = np.log((np.array(sizes) + 0.5) / (sum(sizes) + 0.5 * domains))
    n = len(keys)
    weights = np.zeros((n + SHAPE + 1, domains))
    weights[-1] = prior
    if not several:
        return Membership(keys, weights, np.zeros(SHAPE), np.ones(SHAPE))
    active, shapes, y = sample_vectors(sample, keys)
    centre, spread = shapes.mean(axis=0), np.maximum(shapes.std(axis=0), 1e-6)
    dense = np.column_stack([(shapes - centre) / spread, np.ones(len(y))])
    row, col = sparse_rows(active)
    truth = np.eye(domains)[y]

    def loss(flat):
        w = flat.reshape(n + SHAPE + 1, domains)
        score = dense @ w[n:]
        for k in range(domains):
            score[:, k] += np.bincount(row, w[col, k], len(y))
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=1, keepdims=True)
        gap = (p - truth) / len(y)
        g = np.zeros_like(w)
        g[n:] = dense.T @ gap
        for k in range(domains):
            g[:n, k] = np.bincount(col, gap[row, k], n)
        return float(-np.log(np.maximum((p * truth).sum(axis=1), 1e-12)).mean()), (g + 1e-4 * w).ravel()

    return Membership(keys, descend(loss, weights.ravel(), 200).reshape(weights.shape), centre, spread)


def with_posteriors(docs: DataFrame, model: Membership) -> DataFrame:
    """``docs`` with n_tokens (words and one end) and posterior (array, one per domain)."""
    vectors = Vectors(model.keys)

    def compute(texts, _):
        got = [vectors(t) for t in texts]
        p = model.posteriors([g[0] for g in got], np.array([g[1] for g in got]).reshape(-1, SHAPE))
        return [[g[2] + 1 for g in got], p.tolist()]

    return with_columns(docs, {"n_tokens": "bigint", "posterior": "array<double>"}, compute)


def _rate(posterior: Column, steps: list[np.ndarray], least: float) -> Column:
    """The rate after the steps taken so far: 1, then a step and its projection each."""
    rate = F.lit(1.0)
    for g in steps:
        moved = rate
        for k, x in enumerate(g.tolist()):
            moved = moved + posterior[k] * F.lit(x)
        rate = F.greatest(F.lit(float(least)), moved)
    return rate


def fit_rates(members: DataFrame, targets: list[float], least: float = 0.0, rounds: int = 20, near: float = 1e-4,
              tokens: float | None = None) -> list[np.ndarray]:
    """Steps of the projected gradient for ``members`` (n_tokens, posterior).

    ``targets``: weights of the domains, scaled to ``tokens`` in all; None: the fewest tokens for which no domain has to lose any.
    Ends when every total is within ``near`` of its target (as a share of all tokens) or stands still.
    """
    k = range(len(targets))
    weight = F.col("n_tokens").cast("double")
    p = F.col("posterior")

    def totals(steps):
        """Tokens of the domains, and the Gram matrix of the members that can move both ways."""
        rate = _rate(p, steps, least)
        free = F.when(rate > least, weight).otherwise(0.0) if steps else weight
        row = members.agg(*[F.sum(rate * weight * p[i]).alias(f"t{i}") for i in k], *[
            F.sum(free * p[i] * p[j]).alias(f"g{i}_{j}") for i in k for j in k]).first()
        return np.array([row[f"t{i}"] or 0.0 for i in k]), np.array([[row[f"g{i}_{j}"] or 0.0 for j in k] for i in k])

    now, gram = totals([])
    if not now.sum():
        return []
    wanted = np.array(targets, float) / sum(targets)
    total = tokens if tokens is not None else max(now[i] / wanted[i] for i in k if wanted[i] > 0)
    goal = wanted * total
    steps: list[np.ndarray] = []
    while len(steps) < rounds:
        gap = goal - now
        if np.abs(gap).max() <= near * total:
            break
        steps.append(np.linalg.pinv(gram, rcond=1e-10, hermitian=True) @ gap)
        before, (now, gram) = now, totals(steps)
        if np.abs(now - before).max() <= 0.1 * near * total:
            break
    return steps


def mix(docs: DataFrame, labels: DataFrame, targets: list[float], least: float = 0.0, tokens: float | None = None,
        bound: int = LABELLED) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_tokens, posterior, rate and copies.

    ``copies`` is the rate rounded up or down by a hash of id and text, so that the copies' expected tokens are the
    rate's. ``least``: smallest rate allowed. A null or empty text has one token; a null id stays null; repeated
    rows are members each; other columns stay, whatever their names; no rows give no rows.
    """
    own = docs.columns
    wide = with_posteriors(docs, fit(docs, labels, len(targets), bound)).toDF(*[f"c{i}" for i in range(len(own))], "n_tokens", "posterior")
    wide = stored(wide)  # the steps read two narrow columns of it
    steps = fit_rates(wide.select("n_tokens", "posterior"), targets, least, tokens=tokens)
    at = {c.lower(): i for i, c in reversed(list(enumerate(own)))}
    chance = F.pmod(F.xxhash64(f"c{at['doc_id']}", f"c{at['text']}", F.lit(5)), F.lit(1 << 40)) / float(1 << 40)
    out = wide.withColumn("rate", _rate(F.col("posterior"), steps, least)).withColumn("copies", F.floor(F.col("rate") + chance))
    return out.toDF(*own, "n_tokens", "posterior", "rate", "copies")


def mixed_rows(docs: DataFrame, labels: DataFrame, targets: list[float], least: float = 0.0, tokens: float | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say."""
    own = docs.columns
    rated = mix(docs, labels, targets, least, tokens).toDF(*[f"c{i}" for i in range(len(own))], "n_tokens", "posterior", "rate", "copies")
    many = rated.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return many.select(*[f"c{i}" for i in range(len(own))]).toDF(*own)
