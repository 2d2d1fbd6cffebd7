"""Mixing sources to target weights by repetition rates and hash-seeded Bernoulli copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_side, word_count

#: A source may be repeated up to this many times.
MAX_REPEATS = 3
#: Columns of a plan.
PLANNED = ("size", "source_size", "target", "rate", "copies")
#: Hexadecimal digits of the digest that seed a document's coin: 52 bits, exact in a double.
COIN_DIGITS = 13


def ordered_totals(rows: DataFrame, order: list[Column], sums: tuple[str, ...], scratch: Scratch) -> DataFrame:
    """rows with ``place`` from 1 in the order and, of each of the columns ``sums``, the total over the rows before as ``before_<column>``.

    Rows are dealt by range of the order; each range adds up its own and takes the totals of the ranges before, of which
    there are as many as partitions. No task sees all rows.
    """
    dealt = scratch.write(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("__range").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{c}") for c in sums])
    above = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    above_of = lambda c: F.coalesce(F.sum(c).over(above), zero).alias(c)
    offsets = totals.select("__range", above_of("__n"), *[above_of(f"__{c}") for c in sums])
    mine = Window.partitionBy("__range").orderBy(*order)
    before = mine.rowsBetween(Window.unboundedPreceding, -1)
    numbered = dealt.join(F.broadcast(offsets), "__range").withColumns({"place": F.row_number().over(mine) + F.col("__n")} | {f"before_{c}": F.coalesce(F.sum(c).over(before), zero) + F.col(f"__{c}") for c in sums})
    return numbered.drop("__range", "__n", *[f"__{c}" for c in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS, scratch: Scratch | None = None) -> DataFrame:
    """One row per source (source, source_size) -> plus weight and target.

    Weights cycle over the sources in code point order, null last. Targets share the total by weight;
    one stops at ``max_repeats`` times its source's size and the excess goes to the others by weight.
    With the sources in the order of cap/weight, source k is capped exactly if its cap is not above
    its share of what the sources before it leave, so one running sum gives the fixed point at once. Of the
    sources only totals and the row at that point come to the driver.
    """
    scratch = scratch or Scratch(sizes.sparkSession)
    source = F.col("source").asc_nulls_last()
    named = ordered_totals(sizes, [source], (), scratch)
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    caps = named.withColumn("weight", cycle.cast("long")).drop("place").withColumn("cap", F.col("source_size") * max_repeats).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    rising = ordered_totals(caps, [F.col("ratio").asc(), source], ("cap", "weight"), scratch)
    size, weight = rising.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left = rising.withColumn("left_size", F.lit(size) - F.col("before_cap")).withColumn("left_weight", F.lit(weight) - F.col("before_weight"))
    # The first source that keeps below its cap fixes the level that all later ones share.
    free = left.where(F.col("cap") * F.col("left_weight") > F.col("left_size") * F.col("weight"))
    level = free.agg(F.min(F.struct("place", "left_size", "left_weight")).alias("level")).first()["level"]
    cap = F.col("cap").cast("double")
    target = cap if level is None else F.when(F.col("place") < level["place"], cap).otherwise(F.lit(float(level["left_size"])) * F.col("weight") / F.lit(level["left_weight"]))
    return left.select("source", "source_size", "weight", target.alias("target"))


def plan_mix(docs: DataFrame, seed: str = "mix-1", weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Documents (doc_id, text, source, ...) plus size, source_size, target, rate and copies.

    size counts the words of the whole text. rate = target / source_size; a document gets
    floor(rate) copies and one more with the fraction's probability, by a coin seeded with its id. The sizes by source are a written table; documents
    are joined with it without a shuffle unless there are very many sources.

    Nulls: a null text has size 0, null sources form one source of their own, a null id seeds as
    an empty text. Repeated rows count each and share one coin. An empty table gives no rows. Columns
    of the input named like an added one are replaced; all others pass through.
    """
    base = docs.drop(*PLANNED).withColumn("size", word_count(F.col("text")))
    scratch = Scratch(docs.sparkSession)
    per_source = scratch.write(base.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    targets = source_targets(per_source, weights, max_repeats, scratch).select(
        F.col("source").alias("__source"), F.col("source_size"), F.col("target"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    coin = F.conv(F.substring(F.md5(key.cast("binary")), 1, COIN_DIGITS), 16, 10).cast("double") / F.lit(float(16**COIN_DIGITS))
    whole = F.floor("rate").cast("int")
    targets = small_side(targets, per_source)
    joined = base.join(targets, base["source"].eqNullSafe(targets["__source"]), "left").drop("__source")
    return joined.withColumn("copies", whole + F.when(coin < F.col("rate") - whole, F.lit(1)).otherwise(F.lit(0)))


def emit_mix(planned: DataFrame) -> DataFrame:
    """Each planned document as many times as its copies say; those with none go. Without the plan's columns, and so without columns of the
    documents themselves of those names, which the plan has replaced."""
    return (
        planned.where(F.col("copies") > 0)
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .drop("__copy", *PLANNED)
    )
