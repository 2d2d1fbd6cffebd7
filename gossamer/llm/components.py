"""Connected components of an edge table by randomised contraction, all in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


#: So few edges are finished by one task; more are contracted in rounds.
LOCAL_EDGES = 16_384


class UnionFind(dict):
    """Parent by id; roots are the smallest ids of their sets."""

    def root(self, x: int) -> int:
        at = x
        while (up := self.get(at, at)) != at:
            at = up
        while (up := self.get(x, x)) != at:
            self[x] = at
            x = up
        return at

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self[max(a, b)] = min(a, b)
        return True


def forest(edges: DataFrame) -> DataFrame:
    """A spanning forest (a, b) of each partition's edges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = UnionFind()
        for batch in batches:
            kept = [(a, b) for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True) if sets.join(a, b)]
            yield pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

    return edges.select("a", "b").mapInPandas(run, "a bigint, b bigint")


def _onward(labels: DataFrame, step: DataFrame) -> DataFrame:
    """Labels followed one step further."""
    onward = step.select(F.col("id").alias("label"), F.col("label").alias("next"))
    return labels.join(onward, "label", "left").select("id", F.coalesce("next", "label").alias("label"))


def rooted(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each id reaches, of edges few enough for one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets, ids = UnionFind(), set()
        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                sets.join(a, b)
                ids |= {a, b}
        ids = sorted(ids)
        yield pd.DataFrame({"id": ids, "label": [sets.root(x) for x in ids]}, dtype="int64")

    return edges.select("a", "b").repartition(1).mapInPandas(run, "id bigint, label bigint")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every id in ``edges`` (a bigint, b bigint); component is the smallest id reachable.

    Each round, an id follows its neighbour with the smallest hash, if that is below its own; edges
    between followers of one id vanish. Rounds draw new hashes, so the edges fall by a constant
    factor on average, until there are so few that one task joins them. Only their number comes
    to the driver.
    """
    n = edges.count()
    left = scratch.write(forest(edges.where("a != b")), "edges", rows=n)
    labels: DataFrame | None = None
    turn = 0
    while n := left.count():
        turn += 1
        if n <= LOCAL_EDGES:
            step = scratch.write(rooted(left), f"step{turn}", rows=n)
            labels = step if labels is None else _onward(labels, step)
            break
        rank = lambda c, k=turn: F.xxhash64(F.lit(k), c)
        both = left.select("a", "b").unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(rank(F.col("b")).alias("r"), F.col("b").alias("id"))).alias("m"))
        step = best.select(F.col("a").alias("id"), F.when(F.col("m") < F.struct(rank(F.col("a")).alias("r"), F.col("a").alias("id")), F.col("m.id")).otherwise(F.col("a")).alias("label"))
        step = scratch.write(step, f"step{turn}", rows=2 * n)
        la, lb = step.select(F.col("id").alias("a"), F.col("label").alias("la")), step.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        shrunk = left.join(la, "a").join(lb, "b").where("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
        left = scratch.write(forest(shrunk), "edges", rows=n)
        if labels is None:
            labels = step
        else:
            labels = scratch.write(_onward(labels, step), "labels", rows=labels.count())
    if labels is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = labels.groupBy("label").agg(F.min("id").alias("component"))
    return labels.join(least, "label").select("id", "component")
