"""Audit of document filters: what each removes, alone and after the others, in every order of them.

Exact duplicates are found by refining a partition of the documents: by code-point length, then by the
hashes of successive blocks of their texts. Whoever is alone in a class is done; the texts of those left are compared in full.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_groups, small_side

LETTERS = "ABCDE"
#: The bit of the duplicate filter in a mask; the filter of letter k has bit k.
DUPLICATE = 1 << LETTERS.index("E")
#: Start and size in code points of a text's blocks, the first of 64, each four times as long as the one before.
BLOCKS = [(start, min(3 * start + 64, (1 << 31) - 1 - start)) for start in (64 * (4**k - 1) // 3 for k in range(14))]


def with_content_mask(docs: DataFrame) -> DataFrame:
    """docs with ``content``, the bits of the filters A to D that the text fails."""
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    told = docs.withColumn("__words", words).withColumn("__n", F.size("__words")).withColumn("__distinct", F.size(F.array_distinct("__words")))
    fails = (
        F.col("__n") < 50, 100 * F.col("__distinct").cast("bigint") < 65 * F.col("__n").cast("bigint"),
        100 * F.regexp_count("text", F.lit("[A-Z]")).cast("bigint") > 5 * F.length("text").cast("bigint"), F.col("text").rlike("[#$%&*|]"),
    )
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return told.withColumn("content", mask).drop("__words", "__n", "__distinct")


def block_hashes() -> Column:
    """array<bigint>: hashes of the blocks that ``text`` of ``length`` code points reaches; together they cover all of it."""
    blocks = F.array(*[F.struct(F.lit(start).alias("start"), F.lit(size).alias("size")) for start, size in BLOCKS])
    return F.transform(F.filter(blocks, lambda b: b["start"] < F.col("length")), lambda b: F.xxhash64(F.substring("text", b["start"] + 1, b["size"])))


def last_class() -> Column:
    """The class that ``text`` is in when all its blocks are used."""
    return F.aggregate(block_hashes(), F.xxhash64("length"), lambda c, h: F.xxhash64(c, h))


def mark_duplicates(docs: DataFrame, scratch: Scratch, keep: list[str]) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, the columns ``keep``, and ``duplicate``: has a smaller doc_id the same text?

    Only ids, lengths and hashes are dealt by class, and those of a hot class stay where they are. Texts move only where
    their class outlives all rounds, and of equal ones in a task one moves. A null id is no duplicate and makes none.
    """
    names, whole = ["doc_id", *keep], docs.withColumn("length", F.length("text"))
    rows = scratch.write(whole.select(*names, "length", block_hashes().alias("hashes")), "lengths")
    rows, n, level, alone = rows.withColumn("class", F.xxhash64("length")), rows.count(), 0, []
    while True:
        groups = scratch.write(rows.groupBy("class").agg(F.count("*").alias("n")), "classes", rows=n)
        split = scratch.write(join_groups(rows, groups, "class"), "split", rows=n)
        alone.append(split.where("n = 1").select(*names, F.lit(False).alias("duplicate")))
        rows = split.where("n > 1").drop("n")
        n, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("hashes")), F.lit(0))).first()
        if level >= longest:
            break
        finer = F.xxhash64("class", F.get("hashes", F.lit(level)))
        rows, level = rows.withColumn("class", F.when(F.size("hashes") > level, finer).otherwise(F.col("class"))), level + 1

    left = scratch.write(rows.groupBy("class").agg(F.count("*").alias("n")), "left", rows=n)
    texts = whole.select("doc_id", "text", last_class().alias("class")).join(small_side(left.select("class"), left), "class", "left_semi").groupBy("class", "text").agg(F.min("doc_id").alias("first"))
    kinds = scratch.write(texts.groupBy("class").agg(F.count("*").alias("kinds"), F.min("first").alias("first")).join(left, "class"), "firsts", rows=n)
    marked = lambda df: df.select(*names, F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("duplicate"))
    out = marked(join_groups(rows, kinds.where("kinds = 1"), "class"))
    mixed = kinds.where("kinds > 1").select("class")
    if not mixed.isEmpty():  # texts that differ though all their hashes are equal
        unlike = whole.withColumn("class", last_class()).join(small_side(mixed, kinds), "class", "left_semi")
        out = out.unionByName(marked(unlike.join(unlike.groupBy("class", "text").agg(F.min("doc_id").alias("first")), ["class", "text"])))
    for part in alone:
        out = out.unionByName(part)
    return out


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, source), labels (doc_id, quality, toxic) -> part, mask, n, good, toxic: documents that fail the mask's filters and no others.

    Sums are made before the shuffle, so a source that holds most documents costs a task 32 rows.
    """
    scratch = Scratch(docs.sparkSession)
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    marked = scratch.write(mark_duplicates(with_content_mask(base), scratch, ["part", "content"]), "marks")
    rows = marked.select("doc_id", "part", (F.col("content") + F.when(F.col("duplicate"), DUPLICATE).otherwise(0)).alias("mask"))
    told = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(*[F.coalesce(F.max((F.col(c) == 1).cast("bigint")), F.lit(0)).alias(name) for name, c in (("good", "quality"), ("toxic", "toxic"))])
    none = F.lit(0).cast("bigint")
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", "n", none.alias("good"), none.alias("toxic"))
    labelled = rows.join(told, "doc_id").groupBy("part", "mask").agg(F.sum("good").alias("good"), F.sum("toxic").alias("toxic")).select("part", "mask", none.alias("n"), "good", "toxic")
    return counts.unionByName(labelled).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What the five filters do in each part (source), in all 120 orders of them.

    docs (doc_id, text, source, ...), labels (doc_id, quality, toxic, ...) -> part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley. A row for each part, order and step, zeros included, made from at most 32 counts a part.

    Nulls: a null text or source is empty, so the parts of null and of the empty source are one; a null doc_id has no label, is no
    duplicate and makes none. Repeated rows count each; rows that share id and text are no duplicates of each other, for no id is smaller.
    Of several labels of an id, any 1 counts. An empty table gives no rows. Further columns are not read.
    """
    held = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    rows = held.select("part", "counts", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    bit = f"shiftleft(1, instr('{LETTERS}', substring(filter_order, {{}}, 1)) - 1)"
    rows = rows.withColumns({"own": F.expr(bit.format("step")), "before": F.expr(f"aggregate(filter(sequence(1, {len(LETTERS)}), k -> k < step), 0, (b, k) -> b + {bit.format('k')})")})

    fails, gone = lambda m: m.bitwiseAND(F.col("own")) != 0, lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: fails(m) & ~gone(m)
    # In how many orders a filter comes first among those that a document fails: 120 over their number.
    first = lambda m: F.element_at(F.array(*[F.lit(120 // k).cast("bigint") for k in range(1, 6)]), F.bit_count(m))

    def total(value: str, holds, times=lambda m: F.lit(1).cast("bigint")) -> Column:
        return F.aggregate(F.filter("counts", lambda c: holds(c["mask"])), F.lit(0).cast("bigint"), lambda sum_, c: sum_ + c[value] * times(c["mask"]))

    return rows.select(
        "part", "filter_order", "step", total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("n", here).alias("removed"), total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == F.col("own")).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), total("n", fails, first).alias("shapley"),
    )
