"""Bounded samples of labelled training rows, and logistic calibration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, max_docs: int) -> pd.DataFrame:
    """At most about ``max_docs`` labelled documents for fitting: doc_id, text, label; held-out rows never.

    Rows are drawn by a hash of the id below a threshold that follows from the number of labels, so the
    sample reruns alike. Only the drawn ids are broadcast, and only their texts are shuffled. Where an id has
    several labels, the larger counts, where it has several texts, the smallest; null labels and ids are no examples.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    rows = rows.where(crc_mod(F.col("doc_id"), modulus) != held)
    share = min(1.0, max_docs / max(1, rows.count()))
    if share < 1:  # all 63 bits of the hash are compared, so that a share is kept to, however many labels there are
        rows = rows.where(F.xxhash64(F.lit("sample"), "doc_id").bitwiseAND((1 << 63) - 1) < int(share * (1 << 63)))
    drawn = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label").toPandas()
    return got.sort_values("doc_id", kind="stable").reset_index(drop=True)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression, the intercept last, by Newton steps with a ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
