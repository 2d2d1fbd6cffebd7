"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors x become (x, sqrt(M^2 - |x|^2)) and queries (M q / |q|, 0), M the largest length: the nearest by
distance is then the largest inner product. Tables hash by floor((a.x + b) / W) with normal a. A query
visits, in each table, its own bucket and perturbed ones in the order of their estimated success, which
falls with the squared distances to the cell walls it would have to cross. The candidates of all
tables are ranked by the inner product of the original vectors.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import by_id, matrix

TABLES, HASHES, WIDTH = 4, 4, 1.5
#: Fitting the number of probes: vectors sampled, queries among them, recall wanted there.
SAMPLE, SAMPLE_QUERIES, SAMPLE_RECALL = 4_000, 200, 0.96
#: Rows of a bucket's share, and of a task's group of shares.
SHARE_ROWS, GROUP_ROWS = 4_096, 32_768


@dataclass
class Hasher:
    """TABLES x HASHES stable projections; codes hold each table's cells in 16 bits apiece."""

    radius: float
    normal: np.ndarray
    shift: np.ndarray
    offsets: np.ndarray

    @classmethod
    def draw(cls, width: int, radius: float, seed: int = 11) -> Hasher:
        rng = np.random.default_rng(seed)
        return cls(radius, rng.normal(size=(width + 1, TABLES * HASHES)), rng.uniform(0, WIDTH, TABLES * HASHES), np.array(list(itertools.product((-1, 0, 1), repeat=HASHES))))

    def places(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Coordinates in units of cells, rows x TABLES x HASHES."""
        length = np.sqrt((x * x).sum(1))
        if query:
            lifted = np.column_stack([x / length[:, None], np.zeros(len(x))])
        else:
            lifted = np.column_stack([x / self.radius, np.sqrt(np.maximum(0, 1 - (length / self.radius) ** 2))])
        return ((lifted @ self.normal + self.shift) / WIDTH).reshape(len(x), TABLES, HASHES)

    @staticmethod
    def code(cells: np.ndarray) -> np.ndarray:
        """Cells are a few units from 0; 16 bits hold them."""
        return ((cells.astype(np.int64) & 0xFFFF) << (16 * np.arange(HASHES))).sum(-1)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        return self.code(np.floor(self.places(x, False)))

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The first n buckets of each query in each table: rows x TABLES x n."""
        at = self.places(x, True)
        cell = np.floor(at)
        inside = at - cell
        wall = np.stack([inside, np.zeros_like(inside), 1 - inside]) ** 2  # to the cell below, itself, above
        cost = sum(wall[self.offsets[:, h] + 1, :, :, h] for h in range(HASHES))
        order = np.argsort(np.moveaxis(cost, 0, -1), axis=-1, kind="stable")[:, :, :n]
        return self.code(cell[:, :, None, :] + self.offsets[order])


def fit_probes(hasher: Hasher, sample: np.ndarray, k: int) -> int:
    """Fewest probes a table with which the sample's queries find the wanted share of their k nearest; one more than there are if none do."""
    q = sample[:SAMPLE_QUERIES]
    score = q @ sample.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(hasher.offsets)
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    buckets, probes = hasher.buckets(sample), hasher.probes(q, len(hasher.offsets))
    # For each true neighbour, the probe that finds it first in any table.
    hit = probes[:, :, None, :] == np.moveaxis(buckets[best], 1, 2)[:, :, :, None]
    first = np.where(hit.any(-1), hit.argmax(-1), len(hasher.offsets)).min(1)
    reached = np.sort(first.ravel())
    n = int(reached[math.ceil(SAMPLE_RECALL * len(reached)) - 1]) + 1
    return n


def _best(width: int, k: int):
    """Ranks, in one group, each query's candidates from the shares that it visits."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows, asks = group[group["kind"] == 0], group[group["kind"] == 1]
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(rows) or not len(asks):
            return empty
        rows = rows.assign(key=[x[0] for x in rows["keys"]]).sort_values(["key", "id"], kind="stable")
        x, ids, keys = matrix(rows["vec"], width), rows["id"].to_numpy(), rows["key"].to_numpy()
        y, names = matrix(asks["vec"], width), asks["id"].to_numpy()
        asked = pd.DataFrame({"q": np.repeat(np.arange(len(asks)), [len(a) for a in asks["keys"]]), "key": np.concatenate([np.asarray(a) for a in asks["keys"]])})
        out = []
        for key, part in asked.groupby("key", sort=True):
            lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            if lo == hi:
                continue
            for at in range(0, len(part), 256):
                q = part["q"].to_numpy()[at : at + 256]
                score = y[q] @ x[lo:hi].T
                score[names[q][:, None] == ids[None, lo:hi]] = -np.inf
                if hi - lo > k:  # keep what reaches the k-th best, ties too
                    bar = np.partition(score, hi - lo - k, axis=1)[:, hi - lo - k]
                    i, j = np.nonzero((score >= bar[:, None]) & (score > -np.inf))
                else:
                    i, j = np.nonzero(score > -np.inf)
                out.append(pd.DataFrame({"query_id": names[q[i]], "vec_id": ids[lo + j], "score": score[i, j]}))
        if not out:
            return empty
        found = pd.concat(out).drop_duplicates(["query_id", "vec_id"]).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        return found.groupby("query_id", sort=False).head(k)

    return run


FOUND = "query_id bigint, vec_id bigint, score double"


def _by_buckets(base: DataFrame, queries: DataFrame, hasher: Hasher, n_probes: int, n: int, width: int, k: int, scratch: Scratch) -> DataFrame:
    """The best of each query in the buckets that it visits, by group of shares."""

    def bucket_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            code = hasher.buckets(matrix(batch["embedding"], width))
            for t in range(TABLES):
                yield pd.DataFrame({"t": t, "code": code[:, t], "id": batch["vec_id"], "vec": batch["embedding"]})

    def probe_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            code = hasher.probes(matrix(batch["embedding"], width), n_probes)
            ids = np.repeat(batch["vec_id"].to_numpy(), n_probes)
            for t in range(TABLES):
                yield pd.DataFrame({"t": t, "code": code[:, t, :].ravel(), "id": ids})

    groups = max(1, math.ceil(n * TABLES / GROUP_ROWS))
    rows = base.mapInPandas(bucket_rows, "t int, code bigint, id bigint, vec array<double>")
    sizes = scratch.write(rows.groupBy("t", "code").agg(F.ceil(F.count("*") / F.lit(SHARE_ROWS)).alias("shares")), "sizes")
    key = F.xxhash64("t", "code", "share")
    gid = F.pmod(key, F.lit(groups))
    data = rows.join(sizes, ["t", "code"]).withColumn("share", F.pmod(F.xxhash64(F.lit("share"), "id"), F.col("shares")))
    data = data.select(gid.alias("gid"), F.lit(0).alias("kind"), "id", "vec", F.array(key).alias("keys"))
    asked = queries.mapInPandas(probe_rows, "t int, code bigint, id bigint").join(sizes, ["t", "code"])
    asked = asked.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)))
    asked = asked.groupBy(F.col("id"), gid.alias("gid")).agg(F.collect_list(key).alias("keys"))
    asked = asked.join(queries.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), "id")
    both = data.unionByName(asked.select("gid", F.lit(1).alias("kind"), "id", "vec", "keys"))
    return both.groupBy("gid").applyInPandas(_best(width, k), FOUND)


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """The k nearest by inner product of each row that ``is_query`` holds for, among all other rows.

    Returns query_id, rank from 1, vec_id, score (double); nearest first, ties to the smaller id.
    Buckets are cut into shares of bounded size, which are grouped into tasks; a query visits all
    shares of a bucket. Queries that found fewer than k, while more rows exist, are compared with all rows; all queries
    are where no number of probes reaches the wanted recall on the sample.

    Nulls: vectors that are null, empty, zero or hold null or non-finite components neither ask nor
    answer, nor do rows with a null id. Rows of one id count once, by their smallest vector. Vectors of
    unequal length compare as if filled up with zeros. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    base = scratch.write(by_id(vectors).where("usable").select("vec_id", "embedding"), "base")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    n, width, radius = base.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0)), F.coalesce(F.max(length), F.lit(0.0))).first()
    if n == 0:
        return base.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    hasher = Hasher.draw(width, radius)
    drawn = base.orderBy(F.xxhash64(F.lit("sample"), "vec_id"), "vec_id").limit(SAMPLE).select("embedding").toPandas()
    n_probes = fit_probes(hasher, matrix(drawn["embedding"], width), k)

    queries = base.where(is_query)
    if n_probes <= len(hasher.offsets):
        found = scratch.write(_by_buckets(base, queries, hasher, n_probes, n, width, k, scratch), "found")
    else:  # hashing would miss too many: every query is compared with all rows
        found = spark.createDataFrame([], FOUND)

    reached = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n"))
    short = queries.join(reached, F.col("vec_id") == F.col("query_id"), "left").where(F.coalesce("n", F.lit(0)) < min(k, n - 1)).select("vec_id", "embedding")
    short = scratch.write(short, "short")
    if not short.isEmpty():
        blocks = max(1, math.ceil(n / GROUP_ROWS))
        spot = F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks))
        all_rows = base.select(spot.alias("gid"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.array(F.lit(0).cast("bigint")).alias("keys"))
        asks = short.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("gid"), F.lit(1).alias("kind"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.array(F.lit(0).cast("bigint")).alias("keys"))
        found = found.unionByName(all_rows.unionByName(asks).groupBy("gid").applyInPandas(_best(width, k), FOUND))
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
