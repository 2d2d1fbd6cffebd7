"""Embedding near-duplicates through a pivot-permutation index.

Reference points (pivots) are vectors of a hash sample, none within the link cosine of another, so that a dense group of near copies
has one pivot and not its share of them. Equal vectors are one, with their number. Each vector is described by its nearest pivots
in order and stands in their inverted lists. Vectors that share enough pivots are candidates; the
cosine of the original vectors decides. A pair is counted in the list of its smallest shared pivot only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_groups
from .components import connected_components
from .vectors import by_id, matrix, unit

COSINE = 0.9
#: Pivots: twice the root of the number of vectors, between these bounds; a vector stands in NEAREST lists. All pivots are sent
#: everywhere, at most 65,536 vectors, as many as a thousand million vectors have.
LEAST_PIVOTS, MOST_PIVOTS, NEAREST, SHARED = 64, 65_536, 10, 2
#: Sampled vectors for each pivot that is chosen among them; cosines held at once while pivots are chosen and looked up.
CANDIDATES, CELLS = 4, 4_000_000
#: Members of a list that are compared with one another in one task.
BLOCK = 2048


def spread(x: np.ndarray, count: int, cosine: float) -> np.ndarray:
    """Places of the first ``count`` unit vectors of which none is within ``cosine`` of one before."""
    chosen = np.zeros(min(count, len(x)), np.int64)
    n, step = 0, max(1, min(1024, CELLS // count))
    for lo in range(0, len(x), step):
        some = x[lo : lo + step]
        free = (some @ x[chosen[:n]].T < cosine).all(1) if n else np.ones(len(some), bool)
        within = some @ some.T >= cosine
        for i in range(len(some)):
            if free[i]:
                if n == len(chosen):
                    return chosen
                chosen[n] = lo + i
                n += 1
                free[i + 1 :] &= ~within[i, i + 1 :]
    return chosen[:n]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Places of each vector's k nearest pivots, nearest first, ties to the smaller place."""
    out = np.empty((len(x), k), np.int64)
    step = max(1, CELLS // len(pivots))
    for lo in range(0, len(x), step):
        out[lo : lo + step] = np.argsort(-(x[lo : lo + step] @ pivots.T), axis=1, kind="stable")[:, :k]
    return out


def choose_pivots(usable: DataFrame, n: int, width: int, cosine: float = COSINE) -> np.ndarray:
    count = min(MOST_PIVOTS, max(LEAST_PIVOTS, round(2 * math.sqrt(n))))
    rows = usable.orderBy(F.xxhash64(F.lit("pivot"), "vec_id"), "vec_id").limit(CANDIDATES * count).select("embedding").toPandas()
    x = unit(matrix(rows["embedding"], width))
    return x[spread(x, count, cosine)]


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable place of each of n places over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked_pairs(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, pivot: int, cosine: float, shared: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked pairs of two blocks of one pivot's list: shared-pivot count, canonical list, cosine."""
    out = []
    for lo in range(0, len(x), 512):
        a, b = np.nonzero(x[lo : lo + 512] @ y.T >= cosine)
        a += lo
        if same:
            a, b = a[a < b], b[a < b]
        for at in range(0, len(a), 200_000):
            i, j = a[at : at + 200_000], b[at : at + 200_000]
            equal = px[i][:, :, None] == py[j][:, None, :]
            first = np.where(equal.any(2), px[i], np.iinfo(np.int64).max).min(1)
            keep = (first == pivot) & (equal.sum((1, 2)) >= shared)
            out.append((i[keep], j[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """Vectors (vec_id, embedding, ...) -> a row per id: vec_id, n_links, component_id, kept.

    Links are pairs with a cosine of at least ``cosine`` in double precision; n_links counts an id's,
    component_id is the smallest id reachable over them, kept marks that one. A long list is split into
    blocks that meet pairwise, so a task holds two blocks whatever a pivot attracts; only counts and a spanning
    forest leave it, never the pairs. n_links is exact, so a dense group of different vectors costs the square of their number.

    Nulls: vectors that are null, empty, zero or hold null or non-finite components link with nothing. Rows
    with a null id are left out; rows of one id count once, by their smallest vector. Vectors of
    unequal length compare as if filled up with zeros. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.write(by_id(vectors), "vectors")
    texts = scratch.write(rows.where("usable").groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")), "texts")
    usable = texts.select("vec_id", "embedding", F.col("n").alias("copies"))
    n, width = usable.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if n == 0:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    pivots = choose_pivots(usable, n, width, cosine)
    k = min(nearest, len(pivots))
    need = min(shared, k)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = unit(matrix(batch["embedding"], width))
            yield pd.DataFrame({"vec_id": batch["vec_id"], "copies": batch["copies"], "unit": [r.tobytes() for r in x], "near": list(nearest_pivots(x, pivots, k))})

    described = scratch.write(usable.mapInPandas(describe, "vec_id bigint, copies bigint, unit binary, near array<bigint>"), "described")
    lists = described.select("vec_id", "copies", "unit", "near", F.explode("near").alias("pivot"))
    sizes = lists.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))  # a row per pivot
    placed = lists.join(F.broadcast(sizes), "pivot").withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    other = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    cells = placed.select("vec_id", "copies", "unit", "near", "pivot", "own", F.explode(other).alias("with")).select(
        "vec_id", "copies", "unit", "near", "pivot", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j")
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        pivot, i, j = int(group["pivot"].iloc[0]), int(group["i"].iloc[0]), int(group["j"].iloc[0])
        group = group.sort_values("vec_id", kind="stable").reset_index(drop=True)
        x, near, own = np.frombuffer(b"".join(group["unit"]), np.float64).reshape(len(group), width), np.stack(group["near"].to_numpy()), group["own"].to_numpy()
        if i == j:
            a, b = linked_pairs(x, x, near, near, pivot, cosine, need, True)
        else:
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            a, b = linked_pairs(x[left], x[right], near[left], near[right], pivot, cosine, need, False)
            a, b = left[a], right[b]
        copies = group["copies"].to_numpy()
        count = (np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))).astype(np.int64)
        ids = group["vec_id"].to_numpy()
        some = np.flatnonzero(count)
        return pd.DataFrame({"vec_id": ids[some], "n": count[some], "root": ids[labels_of(len(x), a, b)[some]]})

    found = scratch.write(cells.groupBy("pivot", "i", "j").applyInPandas(compare, "vec_id bigint, n bigint, root bigint"), "found")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("linked"))
    edges = found.where("vec_id != root").select(F.col("vec_id").alias("a"), F.col("root").alias("b")).distinct()
    classes = connected_components(edges, scratch).withColumnRenamed("id", "vec_id")
    # What holds for the first of equal vectors holds for all of them.
    told = texts.join(counts, "vec_id", "left").join(classes, "vec_id", "left")
    told = told.select("embedding", "n", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    mine = join_groups(rows.where("usable").select("vec_id", "embedding"), scratch.write(told, "told"), "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return mine.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
