"""A log of written tables that outlives the driver: each entry is there as a whole or not at all.

An entry's tables are written to a folder of their own, then a small JSON file that names them is published under the entry's number,
by a rename that fails where that number is taken. Readers follow published entries alone, so a writer that dies midway
leaves what was there before, and of two writers of one number one fails.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class EntryTaken(RuntimeError):
    """Another writer has published an entry of this number."""


@dataclass(frozen=True)
class Entry:
    """Number from 1, phase, facts, and the tables by name: folder within the log, schema as JSON."""

    number: int
    phase: str
    facts: dict
    tables: dict[str, dict[str, str]] = field(default_factory=dict)


class RunLog:
    """The log in ``folder``, on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _text(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def entries(self) -> list[Entry]:
        """Published entries in order."""
        found = []
        for name in self._names("published"):
            if re.fullmatch(r"\d{12}", name):
                path = self._path(f"published/{name}")
                try:
                    found.append(Entry(int(name), **json.loads(self._text(path))))
                except Py4JJavaError:
                    if self._fs.exists(path):  # else it has been dropped meanwhile
                        raise
        return found

    def last(self) -> Entry | None:
        entries = self.entries()
        return entries[-1] if entries else None

    def commit(self, phase: str, tables: dict[str, DataFrame] | None = None, facts: dict | None = None, after: int | None = None) -> Entry:
        """Writes the tables and publishes them as the entry after number ``after``, the last one by default.

        What fails before the entry is published leaves no trace in it; its files are removed.
        """
        if after is None:
            last = self.last()
            after = last.number if last else 0
        number, home, told = after + 1, f"tables/{after + 1:012d}-{uuid.uuid4().hex}", {}
        try:
            for name, df in (tables or {}).items():
                df.write.parquet(f"{self.folder}/{home}/{name}")
                told[name] = {"folder": f"{home}/{name}", "schema": df.schema.json()}
            entry = Entry(number, phase, facts or {}, told)
            self._publish(entry)
        except BaseException:
            self._fs.delete(self._path(home), True)
            raise
        return entry

    def _publish(self, entry: Entry) -> None:
        jvm = self.spark._jvm
        self._fs.mkdirs(self._path("published"))
        draft, place = self._path(f"published/draft-{uuid.uuid4().hex}"), self._path(f"published/{entry.number:012d}")
        out = self._fs.create(draft, False)
        try:
            out.write(json.dumps({"phase": entry.phase, "facts": entry.facts, "tables": entry.tables}).encode())
        finally:
            out.close()
        kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kinds, 1)
        options[0] = kinds.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, place, options)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise EntryTaken(f"entry {entry.number} of {self.folder} is taken") from e
            raise

    def table(self, entry: Entry, name: str) -> DataFrame:
        return self.union([entry], name)

    def union(self, entries: list[Entry], name: str) -> DataFrame | None:
        """The rows of a table that several entries have parts of, all with one schema; None where none has it."""
        told = [e.tables[name] for e in entries if name in e.tables]
        if not told:
            return None
        return self.spark.read.schema(StructType.fromJson(json.loads(told[-1]["schema"]))).parquet(*[f"{self.folder}/{t['folder']}" for t in told])

    def tables(self, entry: Entry) -> dict[str, DataFrame]:
        return {name: self.table(entry, name) for name in entry.tables}

    def drop_before(self, number: int) -> None:
        """Removes entries below ``number``, their names first, and what unfinished writers of such entries have left."""
        for name in self._names("published"):
            if re.fullmatch(r"\d{12}", name) and int(name) < number:
                self._fs.delete(self._path(f"published/{name}"), False)
        for name in self._names("tables"):
            if int(name[:12]) < number:
                self._fs.delete(self._path(f"tables/{name}"), True)


def save_checkpoint(tables: dict[str, DataFrame], folder: str, version: int = 1, keep: int = 2) -> int:
    """Saves the tables together as the newest checkpoint in ``folder`` and gives its number.

    The ones before stay readable until the new one is published; then all but the newest ``keep`` are removed, two by default so that
    whoever has just looked up the former can still read it. Of two that save at once one gets EntryTaken.
    """
    log = RunLog(next(iter(tables.values())).sparkSession, folder)
    number = log.commit("checkpoint", tables, {"version": version}).number
    log.drop_before(number - keep + 1)
    return number


def load_checkpoint(spark: SparkSession, folder: str, version: int = 1, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of the newest checkpoint, or of a certain one. None there, or one of another version, is an error."""
    log = RunLog(spark, folder)
    found = [e for e in log.entries() if number is None or e.number == number]
    if not found:
        raise FileNotFoundError(f"no checkpoint in {folder}")
    if found[-1].facts.get("version") != version:
        raise ValueError(f"checkpoint version {found[-1].facts.get('version')}, not {version}")
    return log.tables(found[-1])
