"""Bounded samples of labelled rows for the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo folds; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % folds


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key only."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def sampled_labels(labels: DataFrame, label: str, usable: Column, rows: int, seed: int) -> DataFrame:
    """(doc_id, y): about ``rows`` labelled documents that are usable, half of each class where there are enough.

    The sample is cut by a hash of the id, so its expected size is the bound whatever the table's size. A
    document labelled twice counts once, with its larger label; null labels and ids are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
    counts = {r["y"]: r["n"] for r in known.groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col(label) == y, F.lit(min(1.0, rows / 2 / n))).otherwise(share)
    picked = known.where(unit_hash(F.col("doc_id"), seed) < share)
    return picked.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))


def logistic(x, y, weight=None, l2=1e-3, steps=60):
    """Newton's method for logistic loss; the last column of x should be ones. Returns the coefficients."""
    import numpy as np

    w = np.zeros(x.shape[1])
    weight = np.ones(len(y)) if weight is None else weight
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + l2 * len(y) * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * len(y) * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
