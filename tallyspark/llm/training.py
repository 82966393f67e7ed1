"""Bounded labelled samples and the small models that are fitted on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, learn=None) -> DataFrame:
    """At most `rows` labelled documents (doc_id, text, label), chosen by a hash of the id.

    Rows of `labels` without an id or a value are left out; an id marked both ways counts as 0, and of several
    texts with one id the least in order stands for it. `learn`: a function of the id column that says which ids
    may be learned from. Only the ids are ranked; the texts are met by a join with the chosen few.
    """
    ids = labels.select(F.col("doc_id"), F.col(target).cast("int").alias("label")).dropna()
    if learn is not None:
        ids = ids.where(learn(F.col("doc_id")))
    few = ids.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(few, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def id_remainder(doc_id, modulus: int):
    """crc32 of the id written as text, modulo `modulus`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1e-3,
                 steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with an L2 penalty, by accelerated gradient steps."""
    n, d = x.shape
    weight = np.full(n, 1 / max(n, 1)) if weight is None else weight / max(weight.sum(), 1e-12)
    share = np.clip((weight * y).sum(), 1e-3, 1 - 1e-3)
    w, b = np.zeros(d, x.dtype), float(np.log(share / (1 - share)))
    if not n:
        return w, 0.0
    v = np.ones(d, x.dtype)
    for _ in range(12):  # the largest curvature, by power iteration
        v = x.T @ (weight.astype(x.dtype) * (x @ v))
        v /= max(float(np.linalg.norm(v)), 1e-12)
    rate = 1 / (0.3 * float((weight * (x @ v) ** 2).sum()) + 0.3 + penalty)
    w_old, b_old = w, b
    for k in range(steps):
        go = k / (k + 3)
        wl, bl = w + go * (w - w_old), b + go * (b - b_old)
        g = weight * (sigmoid(x @ wl + bl) - y)
        w_old, b_old = w, b
        w = (wl - rate * (x.T @ g.astype(x.dtype) + penalty * wl)).astype(x.dtype)
        b = bl - rate * float(g.sum())
    return w, b


def fit_calibration(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn margins into probabilities (logistic on one variable, by Newton steps)."""
    if not len(y):
        return 1.0, 0.0
    up, down = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    scale = max(float(np.std(margin)), 1e-9)
    z = np.stack([margin / scale, np.ones(len(y))], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(z @ beta)
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        move = np.linalg.solve(hessian, z.T @ (p - t) + 1e-3 * np.array([beta[0], 0.0]))
        beta = beta - np.clip(move, -2, 2)
    return float(max(beta[0], 1e-3) / scale), float(beta[1])
