"""Readers of local specimens and of saved runs: text lists, key=value stats, lenient JSON, binaries, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F



def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan, dealt over all cores where it comes in fewer partitions than there are.

    A row group is read by one task, so a file of one would leave the work on its texts to a single core. Larger inputs have more partitions
    than cores and are not moved.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


INLINE_URL = "https://inline.specimen.local/"


def inline_page(spark: SparkSession, html: str) -> DataFrame:
    return spark.createDataFrame([(INLINE_URL, html)], "url string, html string")


def script_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, body) of whole script files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("body"))


def document_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, content, content_type) of binary files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), "content", F.lit("").alias("content_type"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) lines that are not blank."""
    return spark.read.text(path).where(F.trim("value") != "")


def typed_value(text: Column) -> Column:
    """struct<int, double, text>: the first reading that fits; the others are null."""
    as_int, as_double = text.try_cast("bigint"), text.try_cast("double")
    return F.struct(as_int.alias("int"), F.when(as_int.isNull(), as_double).alias("double"), F.when(as_double.isNull(), text).alias("text"))


def stats_lines(lines: DataFrame) -> DataFrame:
    """(value) -> key, int, double, text of key=value lines."""
    kv = lines.where(F.col("value").contains("=")).select(F.trim(F.substring_index("value", "=", 1)).alias("key"), F.trim(F.expr("substring(value, instr(value, '=') + 1)")).alias("v"))
    return kv.select("key", typed_value(F.col("v")).alias("t")).select("key", "t.*")


def json_lines(lines: DataFrame) -> DataFrame:
    """(value) -> payload variant of the lines that are JSON objects; others are dropped."""
    return lines.select(F.try_parse_json("value").alias("payload")).where(F.schema_of_variant("payload").startswith("OBJECT"))


def with_precedence(*sources: DataFrame, key: str = "name") -> DataFrame:
    """Union of the sources in which, of rows with one key, those of the first source that has it stay."""
    tagged = [s.withColumn("__source", F.lit(i)) for i, s in enumerate(sources)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    first = F.min("__source").over(Window.partitionBy(key))
    return out.withColumn("__first", first).where(F.col("__source") == F.col("__first")).drop("__source", "__first")


def file_hashes(spark: SparkSession, path: str, exclude: tuple[str, ...] = ("manifest.json", "temporal-baseline.json")) -> DataFrame:
    """(path, sha256, size) of a run's files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    return files.where(~name.isin(*exclude)).select(name.alias("path"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("bigint").alias("size"))
