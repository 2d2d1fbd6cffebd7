"""Corpus pipeline: the stages that turn raw documents into packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. What a stage returns is written as Parquet and reread as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm import minhash, mixing, packing, pii, toxicity
from gossamer.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches a half go; the model learns from the labelled ones among docs."""
    model = toxicity.fit_from_tables(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).where(F.col("toxicity_score") < 0.5).drop("toxicity_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest id."""
    return minhash.keep_one(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in each text is replaced by its kind; n_chars is counted anew."""
    return pii.redact(pii.find_pii(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target rate says."""
    return mixing.emit_mix(mixing.plan_mix(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its place in a sequence of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("pii", redact_pii), ("mixing", mix), ("packing", pack)]

#: Models are fitted and texts tokenised on the way: SQL cannot say the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents one after another, each written to the shared folder and reread."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
