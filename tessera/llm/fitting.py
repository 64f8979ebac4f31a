"""Labelled samples and sparse logistic regression, for the operators that learn from labels."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted


def labelled(labels: DataFrame, label_col: str, mod: int, rest: int, most: int) -> DataFrame:
    """(doc_id, label) of at most ``most`` training rows, those with the least hashes of the id.

    Training rows are those whose crc32(id as text) mod ``mod`` is not ``rest``.
    Rows with a null id or label and, of an id with several labels, all but the
    greatest don't count. ``most`` bounds the sample whatever the data.
    """
    rows = labels.select(quoted("doc_id").cast("long").alias("doc_id"), quoted(label_col).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    rows = rows.filter(F.crc32(F.col("doc_id").cast("string")) % mod != rest)
    return rows.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def held_out(mod: int, rest: int):
    """Whether crc32(doc_id as text; empty for null) mod ``mod`` is ``rest``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % mod == rest


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 800, times: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of an L1-penalised logistic regression, by accelerated proximal steps; y may be soft, a row counts ``times``.

    x is not copied; with single precision in x, its products have that too.
    """
    n, d = x.shape
    if not n:
        return np.zeros(d), 0.0
    share = np.full(n, 1 / n) if times is None else times / times.sum()

    def out(u: np.ndarray) -> np.ndarray:
        return x @ u[:-1].astype(x.dtype) + u[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.append((r.astype(x.dtype) @ x).astype(np.float64), r.sum())

    v = np.random.default_rng(0).normal(size=d + 1)
    for _ in range(30):  # the largest singular value, by power iteration
        v = back(share * out(v))
        v /= np.linalg.norm(v) + 1e-12
    size = float(v @ back(share * out(v))) / 4 * 1.05 + 1e-9
    w, u = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(steps):
        grad = back(share * (1 / (1 + np.exp(-np.clip(out(u), -50, 50))) - y))
        new = u - grad / size
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - penalty / size, 0.0)
        u = new + t / (t + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])
