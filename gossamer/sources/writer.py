"""A run's findings as a data source to write to: one file a task, published together.

``spark.dataSource.register(FindingsSink)``, then ``df.write.format("crawl_findings").mode("append" or "overwrite").option("path", folder).save()``, or the same with
``writeStream``. The file system is the path's, by pyarrow; a plain path is a folder that all executors share. Options: ``kind`` (``jsonl``, ``csv`` or ``text``, which writes the
first column). Tasks write to a staging folder; a commit moves their files to a folder of its own and then names it in ``_published``, and an abort removes them, so that
readers meet whole writes alone. One writer at a time. File names follow the partitions: the files of a sorted DataFrame, in order, are sorted.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SUFFIX = {"jsonl": "jsonl", "csv": "csv", "text": "txt"}


@dataclass
class Written(WriterCommitMessage):
    staging: str
    name: str
    rows: int


@dataclass
class Folder:
    """The folder written to: its file system and path are looked up where they are used, in a task or on the driver."""

    path: str
    kind: str
    columns: list[str]
    staging: str = field(default_factory=lambda: f"_staging-{uuid.uuid4().hex}")

    def at(self, *names: str) -> tuple[arrow_fs.FileSystem, str]:
        system, root = arrow_fs.FileSystem.from_uri(self.path) if "://" in self.path else (arrow_fs.LocalFileSystem(), self.path)
        return system, "/".join([root.rstrip("/"), *names])

    def lines(self, rows: Iterator[Row]) -> Iterator[str]:
        for row in rows:
            if self.kind == "jsonl":
                yield json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) + "\n"
            elif self.kind == "csv":
                out = io.StringIO()
                csv.writer(out, lineterminator="\n").writerow(row)
                yield out.getvalue()
            else:
                yield f"{'' if row[0] is None else row[0]}\n"

    def write(self, rows: Iterator[Row]) -> Written:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.{SUFFIX[self.kind]}"
        system, folder = self.at(self.staging)
        system.create_dir(folder)
        count = 0
        with system.open_output_stream(f"{folder}/{name}") as out:
            for line in self.lines(rows):
                out.write(line.encode())
                count += 1
        return Written(self.staging, name, count)

    def discard(self) -> None:
        """Removes what tasks have staged; those of a write that was aborted may still write a little later, which the next one removes."""
        system, root = self.at()
        for info in system.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith("_staging-"):
                system.delete_dir(info.path)

    def publish(self, messages: list[Written | None], number: str, replace: bool) -> None:
        """Moves the files of the tasks that count, not those of lost attempts, then names the folder in _published."""
        system, home = self.at(number)
        told = sorted((m for m in messages if m is not None), key=lambda m: m.name)
        if system.get_file_info(home).type != arrow_fs.FileType.NotFound:
            system.delete_dir(home)
        system.create_dir(home)
        for m in told:
            system.move(self.at(m.staging, m.name)[1], f"{home}/{m.name}")
        self.discard()
        before = [] if replace else published(self)
        entries = [e for e in before if e["folder"] != number] + [{"folder": number, "files": [m.name for m in told], "rows": sum(m.rows for m in told)}]
        draft, place = self.at(f"_published-{uuid.uuid4().hex}")[1], self.at("_published")[1]
        with system.open_output_stream(draft) as out:
            out.write(json.dumps({"kind": self.kind, "columns": self.columns, "writes": entries}).encode())
        system.move(draft, place)


def published(folder: Folder) -> list[dict]:
    system, place = folder.at("_published")
    if system.get_file_info(place).type == arrow_fs.FileType.NotFound:
        return []
    with system.open_input_stream(place) as f:
        return json.loads(f.read())["writes"]


class BatchWriter(DataSourceWriter):
    def __init__(self, folder: Folder, replace: bool):
        self.folder, self.replace = folder, replace

    def write(self, iterator: Iterator[Row]) -> Written:
        return self.folder.write(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        old = {e["folder"] for e in published(self.folder)}
        self.folder.publish(messages, f"write-{uuid.uuid4().hex}", self.replace)
        if self.replace:
            system, _ = self.folder.at()
            for name in old:
                system.delete_dir(self.folder.at(name)[1])

    def abort(self, messages: list[Written | None]) -> None:
        self.folder.discard()


class BatchesWriter(DataSourceStreamWriter):
    """A folder for each micro-batch, by its number: one that comes twice replaces itself."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def write(self, iterator: Iterator[Row]) -> Written:
        return self.folder.write(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.folder.publish(messages, f"batch-{batchId:09d}", replace=False)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.folder.discard()


class FindingsSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "crawl_findings"

    def _folder(self, schema: StructType) -> Folder:
        kind = self.options.get("kind", "jsonl")
        if kind not in SUFFIX:
            raise ValueError(f"kind {kind!r} is none of {sorted(SUFFIX)}")
        return Folder(self.options["path"], kind, schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BatchWriter(self._folder(schema), overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return BatchesWriter(self._folder(schema))


def read_findings(spark: SparkSession, path: str, schema: str, kind: str = "jsonl") -> DataFrame:
    """What has been published in the folder, and nothing else."""
    files = [f"{path.rstrip('/')}/{e['folder']}/{name}" for e in published(Folder(path, kind, [])) for name in e["files"]]
    if not files:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return reader.json(files) if kind == "jsonl" else reader.option("escape", '"').option("multiLine", True).csv(files) if kind == "csv" else reader.text(files)
