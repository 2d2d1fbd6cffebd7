"""Sinks: datasets as text, JSON or CSV, snapshots, manifests, checkpoints."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import file_hashes
from .runlog import load_checkpoint, save_checkpoint  # noqa: F401


def long_form(datasets: dict[str, DataFrame], stats: dict[str, DataFrame] | None = None) -> DataFrame:
    """(category, ord, value): one row per entry of each single-column dataset; key/value tables as key=value, by key."""
    parts = []
    for name, df in datasets.items():
        column = df.columns[0]
        parts.append(df.select(F.lit(name).alias("category"), F.col("ord").cast("bigint") if "ord" in df.columns else F.lit(None).cast("bigint").alias("ord"), F.col(column).cast("string").alias("value")))
    for name, df in (stats or {}).items():
        parts.append(df.select(F.lit(name).alias("category"), F.lit(None).cast("bigint").alias("ord"), F.concat_ws("=", F.col("key"), F.col("value").cast("string")).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("category", F.col("ord").asc_nulls_last(), "value")


def write_text(datasets: dict[str, DataFrame], folder: str) -> list[str]:
    """A folder of text files per dataset that has rows, in value order, or in ``ord`` where there is one."""
    written = []
    for name, df in datasets.items():
        if not df.isEmpty():
            column = df.columns[0]
            df.orderBy("ord" if "ord" in df.columns else column).select(F.col(column).cast("string")).coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
            written.append(name)
    return written


def write_csv(datasets: dict[str, DataFrame], path: str, stats: dict[str, DataFrame] | None = None) -> None:
    long_form(datasets, stats).select("category", "value").write.mode("overwrite").option("header", "true").csv(path)


def write_json(datasets: dict[str, DataFrame], path: str) -> None:
    """One JSON object a row, category and its values; large datasets stay distributed as one row per entry."""
    long_form(datasets).select("category", "value").write.mode("overwrite").json(path)


def manifest(spark: SparkSession, folder: str, run: dict[str, object]) -> DataFrame:
    """One row: manifest_version, run as JSON, and each file's hash and size."""
    files = file_hashes(spark, folder).agg(F.array_sort(F.collect_list(F.struct("path", "sha256", "size"))).alias("files"))
    return files.select(F.lit(1).alias("manifest_version"), F.lit(json.dumps(run, sort_keys=True)).alias("run"), "files")


# The files that a run exports, by kind.
EXPORTS = {
    "json": "results.json", "csv": "results.csv", "autopsy-json": "autopsy.json", "autopsy-md": "autopsy.md", "manifest-json": "crawl-manifest.json",
    "rendered-evidence": "rendered-evidence.json", "timeline-jsonl": "timeline.jsonl", "timeline-json": "timeline.json", "bundle": "sealed-bundle.zip",
}


def export_listing(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, path) of the exports that a run's folder holds."""
    known = spark.createDataFrame(list(EXPORTS.items()), "kind string, name string")
    there = spark.read.format("binaryFile").load(folder).select("path", F.substring_index("path", "/", -1).alias("name"))
    return there.join(F.broadcast(known), "name").select("kind", "path")


def bundle(folder: str, out: str, config: dict[str, object] | None = None, log: list[str] | None = None) -> list[str]:
    """Zips a run's local folder on the driver, with its settings and log where given; gives the members' names."""
    root, members = Path(folder), []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("crawl-config.json", config and json.dumps(config, indent=2)), ("crawl-log.txt", log and "\n".join(log))):
            if text:
                members.append(name)
                z.writestr(name, text)
        for path in sorted(root.rglob("*")):
            if path.is_file() and path != Path(out):
                members.append(str(path.relative_to(root)))
                z.write(path, members[-1])
    return members


def timeline_array(lines: DataFrame) -> DataFrame:
    """One row, the entries of a JSON-lines timeline as one JSON array in order; lines that are no JSON are dropped. For a run's own log, which is bounded."""
    rows = lines.where(F.try_parse_json("value").isNotNull()).select(F.col("value").alias("v"), F.get_json_object("value", "$.timestamp").alias("ts"))
    ordered = F.array_sort(F.collect_list(F.struct("ts", "v")))
    return rows.agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["v"]), ","), F.lit("]")).alias("timeline"))


def selected(datasets: dict[str, DataFrame], name: str) -> DataFrame:
    """(line) of one dataset as it is printed: values in order, key/value tables as key=value by key."""
    df = datasets[name]
    if df.columns[:2] == ["key", "value"]:
        return df.select(F.concat_ws("=", "key", F.col("value").cast("string")).alias("line")).orderBy("line")
    return df.select(F.col(df.columns[0]).cast("string").alias("line")).orderBy("line")


def event_lines(events: DataFrame) -> DataFrame:
    """(line) of (type, payload JSON) events, marked for a console that reads a run's output."""
    return events.select(F.concat(F.lit("[EVENT]"), F.to_json(F.struct(F.col("type"), F.try_parse_json("payload").alias("payload")))).alias("line"))
