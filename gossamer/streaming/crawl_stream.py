"""Crawl logs as streams: record upsert, bounded logs, and per-host politeness as batch replay and as stateful stream."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FIRST_BACKOFF, MAX_BACKOFF = 1.0, 30.0
PLAN_SCHEMA = "host string, seq bigint, requested double, started double, backoff double, next_allowed double"


def polite_step(state: tuple[float, float, float], at: float, status: int | None, retry_after: float | None, gap: float, most: float) -> tuple[float, tuple[float, float, float]]:
    """When a request wanted at ``at`` starts, and the host's (last request, next allowed, backoff) after its response."""
    last, allowed, backoff = state
    start = max(at, allowed, last + gap)
    if status in (429, 503):
        backoff = min(most, max(backoff * 2, FIRST_BACKOFF))
        allowed = max(allowed, start + (backoff if retry_after is None else retry_after))
    elif status is not None and 200 <= status < 400:
        backoff = 0.0
    return start, (start, allowed, backoff)


def politeness_replay(requests: DataFrame, base_delay: float = 0.0, robots_delay: float = 0.0, max_backoff: float = MAX_BACKOFF) -> DataFrame:
    """(host, seq, at, status, retry_after) -> when each request may start and the host's state after it.

    A host's requests are replayed in order; hosts are sorted within partitions, so the state is three numbers
    whatever the number of a host's requests, and no host is held in memory as a group.
    """
    gap = max(base_delay, robots_delay)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, state = None, (float("-inf"), 0.0, 0.0)
        for batch in batches:
            rows = []
            for x in batch.itertuples(index=False):
                if x.host != host:
                    host, state = x.host, (float("-inf"), 0.0, 0.0)
                start, state = polite_step(state, x.at, None if pd.isna(x.status) else int(x.status), None if pd.isna(x.retry_after) else float(x.retry_after), gap, max_backoff)
                rows.append((x.host, x.seq, x.at, start, state[2], state[1]))
            yield pd.DataFrame(rows, columns=["host", "seq", "requested", "started", "backoff", "next_allowed"])

    src = requests.select(F.coalesce("host", F.lit("")).alias("host"), "seq", F.col("at").cast("double").alias("at"), "status", F.col("retry_after").cast("double").alias("retry_after"))
    return src.repartition("host").sortWithinPartitions("host", "at", "seq").mapInPandas(run, PLAN_SCHEMA)


class HostPoliteness(StatefulProcessor):
    """polite_step over a host's requests, with its three numbers as value state.

    A timer forgets a host that has been idle for ``idle`` seconds of event time, counted from when its next request may start; ``ttl``
    does so by the clock. Without either a host is kept.
    """

    def __init__(self, gap: float, most: float, idle: float | None, ttl: float | None):
        self.gap, self.most, self.idle, self.ttl = gap, most, idle, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("host", "last double, allowed double, backoff double, due bigint", int(self.ttl * 1000) if self.ttl else None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, allowed, backoff, due = self.held.get() if self.held.exists() else (float("-inf"), 0.0, 0.0, None)
        # A batch's requests of a host are sorted here, as four numbers each; maxFilesPerTrigger or maxBytesPerTrigger bound a batch.
        batch = pd.concat([x[["at", "seq", "status", "retry_after"]] for x in rows]).sort_values(["at", "seq"])
        state, out = (last, allowed, backoff), []
        for at, seq, status, retry_after in batch.itertuples(index=False):
            start, state = polite_step(state, at, None if pd.isna(status) else int(status), None if pd.isna(retry_after) else float(retry_after), self.gap, self.most)
            out.append((key[0], seq, at, start, state[2], state[1]))
        if self.idle is not None:
            if due is not None:
                self.handle.deleteTimer(due)
            due = int((max(state[0] + self.gap, state[1]) + self.idle) * 1000)
            self.handle.registerTimer(due)
        self.held.update((*state, due))
        yield pd.DataFrame(out, columns=["host", "seq", "requested", "started", "backoff", "next_allowed"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def on_rocksdb(spark: SparkSession) -> None:
    """State of transformWithState lives in RocksDB, on disk and in changelogs; an own choice of the session's stays."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def politeness_stream(
    requests: DataFrame, base_delay: float = 0.0, robots_delay: float = 0.0, max_backoff: float = MAX_BACKOFF, idle: float | None = None, ttl: float | None = None, late: str = "0 seconds"
) -> DataFrame:
    """politeness_replay on a stream of (host, seq, at, status, retry_after), with the host's numbers as keyed state.

    Requests of a batch are replayed in order of ``at`` and ``seq``; batches should come in that order, as a log's files do. With ``idle`` the
    watermark of ``at``, ``late`` behind its largest, lets hosts go that have asked nothing for so long.
    """
    on_rocksdb(requests.sparkSession)
    src = requests.select(F.coalesce("host", F.lit("")).alias("host"), "seq", F.col("at").cast("double").alias("at"), F.col("status").cast("int").alias("status"), F.col("retry_after").cast("double").alias("retry_after"))
    if idle is not None:
        src = src.withColumn("event_time", F.timestamp_micros((F.col("at") * 1e6).cast("bigint"))).withWatermark("event_time", late)
    processor = HostPoliteness(max(base_delay, robots_delay), max_backoff, idle, ttl)
    return src.groupBy("host").transformWithStateInPandas(processor, PLAN_SCHEMA, "Append", "EventTime" if idle is not None else "ProcessingTime" if ttl else "None")


class LastEntries(StatefulProcessor):
    """The newest entries of a channel as capped list state; each batch that has some of the channel gives the whole list once."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("entries", "seq bigint, line string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        entries = [(int(seq), line) for seq, line in self.held.get()] if self.held.exists() else []
        for batch in rows:  # never more than the cap and a batch of rows at once
            new = [(int(seq), line) for seq, line in zip(batch["seq"], batch["line"], strict=True)]
            entries = heapq.nlargest(self.most, {*entries, *new})
        entries.sort()
        self.held.put(entries)
        yield pd.DataFrame({"channel": [key[0]], "newest": [entries[-1][0]], "entries": [[{"seq": s, "line": line} for s, line in entries]]})

    def close(self) -> None:
        pass


def last_entries_stream(entries: DataFrame, most: int) -> DataFrame:
    """(channel, seq, line) -> channel, newest, entries array<struct<seq, line>>: in every batch, the last ``most`` of each channel that it touches.

    The state of a channel is as long as the cap, however long the log; of what is given out, the row with the greatest ``newest`` counts
    (``latest_by_key``). An entry that comes twice is one.
    """
    on_rocksdb(entries.sparkSession)
    src = entries.select(F.coalesce("channel", F.lit("")).alias("channel"), F.col("seq").cast("bigint").alias("seq"), F.col("line").cast("string").alias("line")).where("seq IS NOT NULL")
    return src.groupBy("channel").transformWithStateInPandas(LastEntries(most), "channel string, newest bigint, entries array<struct<seq: bigint, line: string>>", "Update", "None")


def latest_by_key(events: DataFrame, key: str, seq: str) -> DataFrame:
    """The last event of each key, by sequence; in a stream a running upsert."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("last")).select(key, "last.*")


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a streaming DataFrame over what is there and gives its rows, resuming from the checkpoint in ``folder``.

    Each batch is written to a folder of its own number, so that one run twice after a failure counts once. In update mode a
    key's rows of several batches all stay; ``latest_by_key`` takes the last.
    """
    spark, schema = stream.sparkSession, stream.schema

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/rows").select(*schema.names)


def timeline_sink(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends log and event entries as JSON lines."""
    entry = events.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "type", "payload")
    return entry.writeStream.outputMode("append").format("json").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
