"""Whitening of embeddings: principal components of the distinct integer vectors, and each row's place along them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Dimensions up to which all singular values are asked for, which MLlib then takes from the whole decomposition of the Gram matrix.
WHOLE = 2_048
#: Share of the largest variance below which a component is rounding of the Gram matrix and counts as none.
LEAST_SHARE = 1e-13


@dataclass
class Fit:
    """n distinct vectors, their sums by dimension (None beyond a long), means, unit components as columns, variances, and the total variance."""

    n: int
    sums: list[int | None]
    means: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total: float


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, ...) -> vec_id, x array<bigint>: floor(64 c) + 1000000 of each entry c.

    Rows whose vector is null or holds null or non-finite entries go, and those with an entry beyond 2^56, which is no long. Shorter
    vectors are read as if filled up with zeros to the longest.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("c"))
    good = rows.where(F.col("c").isNotNull() & F.forall("c", lambda c: F.coalesce(F.abs(c) < float(1 << 56), F.lit(False)) & ~F.isnan(c)))
    width = good.agg(F.max(F.size("c"))).first()[0] or 0
    filled = F.concat("c", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("c"))) if width else F.col("c")
    return good.select("vec_id", F.transform(filled, lambda c: F.floor(c * SCALE).cast("bigint") + SHIFT).alias("x"))


def centred(n: int, sums: list[int | None], means: np.ndarray) -> Column:
    """x - S/n: the quotient of whole numbers where they fit a long, so that no digits cancel."""
    told = F.array(*[F.struct(F.lit(s).cast("bigint").alias("s"), F.lit(float(m)).alias("m")) for s, m in zip(sums, means, strict=True)])
    return F.zip_with("x", told, lambda x, d: F.coalesce(F.try_subtract(F.try_multiply(x, F.lit(n).cast("bigint")), d["s"]) / F.lit(float(n)), x - d["m"]))


def scaled_offsets(n: int, sums: list[int | None]) -> Column:
    """n x - S by dimension; null where it is no long."""
    return F.zip_with("x", F.array(*[F.lit(s).cast("bigint") for s in sums]), lambda x, s: F.try_subtract(F.try_multiply(x, F.lit(n).cast("bigint")), s))


def deviation(n: int, sums: list[int | None]) -> Column:
    """Sum of (n x - S)^2 over the dimensions, exactly; null where it is no long."""
    return F.aggregate(scaled_offsets(n, sums), F.lit(0).cast("bigint"), lambda total, d: F.try_add(total, F.try_multiply(d, d)))


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Principal components of distinct vectors (x array<bigint>); None where there is no vector or no dimension.

    The rows are centred, then decomposed with RowMatrix.computeSVD, which adds up their Gram matrix over the executors; the driver gets
    a square of the dimension. Variances are the squared singular values over n. The total variance is added up by itself from the exact deviations.
    """
    n = distinct.count()
    told = distinct.select(F.posexplode("x").alias("d", "x")).groupBy("d").agg(F.try_sum("x").alias("sum"), F.avg("x").alias("mean")).orderBy("d").collect()
    if not told:
        return None
    sums = [r["sum"] for r in told]
    means = np.array([r["sum"] / n if r["sum"] is not None else r["mean"] for r in told])
    off = centred(n, sums, means)
    # Deviations beyond a long are added up as decimals.
    wide = lambda d: d.cast("decimal(19,0)")
    squares = F.aggregate(scaled_offsets(n, sums), F.lit(0).cast("decimal(38,0)"), lambda t, d: F.try_add(t, F.try_multiply(wide(d), wide(d))).cast("decimal(38,0)"))
    each = F.coalesce(deviation(n, sums).cast("decimal(38,0)"), squares)
    exact = distinct.select(each.alias("s")).agg(F.try_sum("s"), F.count_if(F.col("s").isNull())).first()
    if exact[1] or exact[0] is None:
        total = distinct.select(F.aggregate(F.transform(off, lambda v: v * v), F.lit(0.0), lambda t, v: t + v).alias("s")).agg(F.sum("s")).first()[0] / n
    else:
        total = float(exact[0]) / n / n / n
    if not total:
        return Fit(n, sums, means, np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    rows = MLUtils.convertVectorColumnsFromML(distinct.select(array_to_vector(off).alias("row")), "row")
    width = len(sums)
    svd = RowMatrix(rows, n, width).computeSVD(width if width <= WHOLE else min(components, width), False, 1e-9)
    variances = np.asarray(svd.s.toArray()) ** 2 / n
    found = svd.V.toArray()
    order = np.argsort(-variances, kind="stable")[:components]
    order = order[variances[order] > LEAST_SHARE * variances.max()]
    found = found[:, order]
    return Fit(n, sums, means, found * np.where(found[np.abs(found).argmax(0), np.arange(found.shape[1])] < 0, -1.0, 1.0), variances[order], total)


def _places(rows: DataFrame, model: Fit, keep: list[str], schema: str, make) -> DataFrame:
    """mapInArrow of ``make(kept columns, whitened matrix)`` over rows with their centred vectors."""
    names, scaled = [c.split()[0] for c in schema.split(", ")], model.components / np.sqrt(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = batch.column(batch.num_columns - 1)
            placed = np.asarray(off.flatten(), np.float64).reshape(len(off), -1) @ scaled
            yield pa.RecordBatch.from_arrays(make(batch.columns[:-1], placed), names=names)

    return rows.select(*keep, centred(model.n, model.sums, model.means).alias("__off")).mapInArrow(run, schema)


def identity_error(distinct: DataFrame, model: Fit) -> float:
    """Largest entry, in absolute value, of the covariance of the whitened distinct vectors minus the identity; each batch gives one matrix."""
    k = len(model.variances)

    def sums(_: list, placed: np.ndarray) -> list:
        both = np.column_stack([placed, np.ones(len(placed))])
        return [pa.array(np.repeat(np.arange(k + 1), k + 1), pa.int32()), pa.array(np.tile(np.arange(k + 1), k + 1), pa.int32()), pa.array((both.T @ both).ravel(), pa.float64())]

    got = np.zeros((k + 1, k + 1))
    for r in _places(distinct, model, [], "i int, j int, s double", sums).groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        got[r["i"], r["j"]] = r["s"] / model.n
    mean = got[:k, k]
    return float(np.abs(got[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(spark: SparkSession, vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and component.

    Components are numbered from 1 by falling variance and turned so that their entry of largest size is positive. There are as many
    as asked for, or as have a variance at all: constant dimensions, or fewer vectors than dimensions, give fewer, and vectors that are all equal give no rows.

    Nulls: a null id stays null. Rows whose vector is null or holds null or non-finite entries are not returned. Repeated rows are returned each, their vector
    counts once in the fit. A deviation beyond a long is null (from some 10^8 vectors on). An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(spark)
    rows = scratch.write(integer_vectors(vectors), "integers")
    distinct = scratch.write(rows.select("x").distinct(), "distinct")
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    model = fit(distinct, components)
    if model is None or not len(model.variances):
        return spark.createDataFrame([], schema)
    k, error = len(model.variances), identity_error(distinct, model)
    explained = model.variances / model.total

    def make(kept: list, placed: np.ndarray) -> list:
        times = pa.array(np.repeat(np.arange(len(placed)), k))
        number = np.tile(np.arange(k), len(placed))
        same = lambda value, kind: pa.array(np.full(len(number), value), kind)
        return [kept[0].take(times), pa.array(number + 1, pa.int32()), same(model.n, pa.int64()), kept[1].take(times), pa.array(placed.ravel(), pa.float64()), pa.array(explained[number], pa.float64()), same(error, pa.float64())]

    told = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), deviation(model.n, model.sums).alias("deviation"), "x")
    return _places(told, model, ["vec_id", "deviation"], schema, make)
