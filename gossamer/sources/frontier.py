"""A frontier of addresses as a stream: each micro-batch fetches the next few of every host.

``frontier_stream`` numbers each host's addresses and writes them dealt by host, then reads them with the data source ``crawl_frontier``. Its offset is
the number of turns that every host has had, so the driver plans a batch without a list of addresses: a partition holds whole hosts, and a batch
takes ``per_host`` turns of each. Within a batch a host's waits follow the politeness rules.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.urls import hostname
from .fetch import SCHEMA, fetch_all


def _at(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if "://" in path:
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path.removeprefix("file:")


class Turns(InputPartition):
    def __init__(self, part: int, start: int, end: int):
        self.part, self.start, self.end = part, start, end


class FrontierReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.folder = options, options["folder"].rstrip("/")
        self.parts, self.turns, self.per_host = (int(options[k]) for k in ("parts", "turns", "per_host"))
        self.planned = self._read_planned()

    def _read_planned(self) -> int:
        """Turns planned so far: written before a batch runs and after its offsets are logged, so a restarted stream never falls behind them."""
        system, path = _at(f"{self.folder}/planned")
        if system.get_file_info(path).type == arrow_fs.FileType.NotFound:
            return 0
        with system.open_input_stream(path) as f:
            return int(f.read() or b"0")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"turn": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"turn": min(self.turns, self.planned + self.per_host)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.planned = max(self.planned, end["turn"])
        system, path = _at(f"{self.folder}/planned")
        with system.open_output_stream(path) as out:
            out.write(str(self.planned).encode())
        return [Turns(p, start["turn"], end["turn"]) for p in range(self.parts)]

    def read(self, partition: Turns) -> Iterator[tuple]:
        system, path = _at(f"{self.folder}/addresses/part={partition.part}")
        if system.get_file_info(path).type == arrow_fs.FileType.NotFound:
            return
        found = pq.read_table(path, columns=["host", "turn", "url"], filesystem=system, filters=[("turn", ">=", partition.start), ("turn", "<", partition.end)])
        yield from fetch_all(iter(found.sort_by([("host", "ascending"), ("turn", "ascending")]).column("url").to_pylist()), self.options)

    def commit(self, end: dict) -> None:
        pass


class FrontierSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "crawl_frontier"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return FrontierReader(dict(self.options))


def save_frontier(urls: DataFrame, folder: str, parts: int) -> dict[str, str]:
    """Writes the addresses (url) once each, dealt by host into ``parts`` and numbered from 0 within it; the options of the stream that reads them.

    A folder that has a frontier keeps it, and with it how far a stream has come.
    """
    spark, home = urls.sparkSession, folder.rstrip("/")
    jvm = spark._jvm.org.apache.hadoop.fs
    whole = jvm.Path(f"{home}/addresses/_SUCCESS")
    if not whole.getFileSystem(spark._jsc.hadoopConfiguration()).exists(whole):
        one = urls.select("url").where("url IS NOT NULL").distinct().withColumn("host", F.coalesce(hostname(F.col("url")), F.lit("")))
        turn = F.row_number().over(Window.partitionBy("host").orderBy("url")) - 1
        dealt = one.withColumn("part", F.pmod(F.xxhash64("host"), F.lit(parts)).cast("int")).withColumn("turn", turn)
        dealt.repartition(parts, "part").sortWithinPartitions("part", "host", "turn").write.mode("overwrite").partitionBy("part").parquet(f"{home}/addresses")
    saved = spark.read.schema("url string, host string, turn int, part int").parquet(f"{home}/addresses")
    turns, most = saved.agg(F.coalesce(F.max("turn") + 1, F.lit(0)), F.coalesce(F.max("part") + 1, F.lit(1))).first()
    return {"folder": home, "turns": str(turns), "parts": str(max(parts, most))}


def frontier_stream(spark: SparkSession, urls: DataFrame, folder: str, per_host: int = 10, parts: int = 16, options: dict[str, str] | None = None) -> DataFrame:
    """A stream of fetched pages (fetch.SCHEMA) of a frontier (url), ``per_host`` of every host a batch; ``options`` are those of fetching."""
    spark.dataSource.register(FrontierSource)
    told = save_frontier(urls, folder, parts)
    return spark.readStream.format("crawl_frontier").options(**(options or {}), **told, per_host=str(per_host)).load()


def left_over(told: dict[str, str]) -> bool:
    """Whether the frontier has turns that no batch has taken yet."""
    reader = FrontierReader({**told, "per_host": "1"})
    return reader.planned < reader.turns
