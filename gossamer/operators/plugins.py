"""Extractors of a user's own as table functions of SQL, and all of them over a body in one reading.

A plug-in is a function of a page's address and body that gives tuples. ``register`` makes each ``find_<name>(url, body)`` in SQL, to be
called with LATERAL, and ``find_all(url, body, names)``, which runs several over a body that is read and handed to Python once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

Plugin = Callable[[str, str], Iterable[tuple]]
#: Registered plug-ins by name: the function and its columns, as in DDL.
PLUGINS: dict[str, tuple[Plugin, str]] = {}


def plugin(name: str, columns: str) -> Callable[[Plugin], Plugin]:
    """Registers a function of (url, body) that gives tuples of the columns."""
    if not name.isidentifier():
        raise ValueError(f"{name!r} is no name for SQL")

    def keep(f: Plugin) -> Plugin:
        PLUGINS[name] = f, columns
        return f

    return keep


def _one(function: Plugin):
    class Found:
        def eval(self, url: str, body: str) -> Iterator[tuple]:
            yield from function(url or "", body or "")

    return Found


def _several(known: dict[str, tuple[Plugin, list[str]]]):
    class Found:
        def eval(self, url: str, body: str, names: list) -> Iterator[tuple]:
            for name in dict.fromkeys(names):
                if name not in known:
                    raise ValueError(f"no plug-in {name!r} among {sorted(known)}")
                function, columns = known[name]
                for row in function(url or "", body or ""):
                    yield name, json.dumps(dict(zip(columns, row, strict=True)), ensure_ascii=False, separators=(",", ":"))

    return Found


def register(spark: SparkSession) -> None:
    """Makes ``find_<name>(url, body)`` of each plug-in, and ``find_all(url, body, names)``, known to the session's SQL."""
    known = {}
    for name, (function, columns) in PLUGINS.items():
        spark.udtf.register(f"find_{name}", udtf(_one(function), returnType=columns))
        known[name] = function, spark.createDataFrame([], columns).columns
    spark.udtf.register("find_all", udtf(_several(known), returnType="extractor string, row string"))


def run_plugins(bodies: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """(url, body) -> url, extractor, row JSON of the plug-ins named, all by default; one scan, in which each body goes to Python once."""
    register(bodies.sparkSession)
    wanted = F.array(*[F.lit(n) for n in (PLUGINS if names is None else names)]).cast("array<string>")
    rows = bodies.select("url", "body").withColumn("names", wanted)
    return bodies.sparkSession.sql("SELECT r.url, f.extractor, f.row FROM {rows} r, LATERAL find_all(r.url, r.body, r.names) f", rows=rows)
