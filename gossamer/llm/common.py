"""Helpers shared by the training-data operators: inputs, hold-out rule, scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rule: space and \t \n \v \f \r; a word is a run of anything else.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id reads as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder of spark.checkpoint.dir; a temporary one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        existing = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = existing.get() if existing.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="gossamer-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Rows of an Arrow batch while intermediate tables are written: texts and shingle sets are wide rows.
BATCH_ROWS = "1000"
#: Rows of ids, keys or links that a task writes.
LIGHT_ROWS = 500_000
#: Bytes as written of ids or sources that are sent to all executors; above it the join shuffles both sides.
BROADCAST_BYTES = 16_000_000


def small_side(df: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """df marked for broadcast if the files of the ``written`` table that it is made of, row by row, are small."""
    size = int(str((written or df)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def hot_bound(rows: int) -> int:
    """Rows of one key beyond which the key is hot: no more than 5000 keys of a table can be, so a row for each can be sent everywhere."""
    return max(500, rows // 5_000)


def join_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows joined with ``groups``, which has a row per key with the number ``n`` of the key's rows.

    Groups of hot keys are broadcast, at most 5000 of them, so that their rows stay where they are; others meet by key. Both tables
    are read twice and should be written ones.
    """
    bound = hot_bound(rows.count())
    hot = F.broadcast(groups.where(F.col("n") > bound))
    cold = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col("n") <= bound), key)
    return rows.join(hot, key).unionByName(cold)


class Scratch:
    """Written intermediate tables in the shared folder; they cut lineage and survive lost executors.

    ``drop()`` removes those written so far, once what reads them has been written in its turn; what is
    left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/gossamer-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def write(self, df: DataFrame, name: str, compression: str = "snappy", rows: int | None = None, per_file: int = LIGHT_ROWS) -> DataFrame:
        """df as a written table. Where the number of its ``rows`` is known at least roughly, it is written by a task for
        each ``per_file`` of them, but not by fewer tasks than cores: many tiny files cost more than their rows."""
        if rows is not None:
            df = df.coalesce(max(self.spark.sparkContext.defaultParallelism, -(-rows // per_file)))
        path = f"{self.root}/{name}-{len(self.paths)}"
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, BATCH_ROWS)
        try:
            df.write.parquet(path, compression=compression)
        finally:
            self.spark.conf.set(key, before)
        if not self.paths:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(p)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: int = 0) -> None:
        """Delete all written tables but the newest ``keep``."""
        jvm = self.spark._jvm
        gone = self.paths[: len(self.paths) - keep]
        self.paths = self.paths[len(self.paths) - keep :]
        for path in gone:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
