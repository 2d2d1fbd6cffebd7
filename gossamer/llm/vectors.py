"""Vectors that take part in searches and joins, and small helpers on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable(embedding: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def by_id(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>, usable), one row per id that is not null; of rows of one id the smallest vector counts."""
    rows = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("usable", is_usable(F.col("embedding")))


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows as doubles; shorter ones are read as if filled up with zeros."""
    if len(column) == 0:
        return np.zeros((0, width))
    try:
        out = np.stack(column.to_numpy()).astype(np.float64)
        if out.shape[1] == width:
            return out
    except ValueError:
        pass
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by the largest component first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(1, initial=0, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
