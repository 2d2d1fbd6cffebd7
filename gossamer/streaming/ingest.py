"""A crawl's events taken into tables: results by URL, the newest queue, robots and sitemap messages, errors and the timeline.

Each micro-batch is split by type inside ``foreachBatch`` and logged under its number (runlog): what changes tables in ``state``, what is only
added in ``history``. A number that is there already is not taken again, so a batch that comes twice counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.runlog import EntryTaken, RunLog

RESULT = "url string, status_code int, content_type string, depth int, source_page string, discovery_time bigint, state string, error_kind string, error_message string, source_kind string"
QUEUES = "map<string, struct<count: bigint, items: array<string>>>"
ROBOTS = "rules array<string>, crawl_delay double"
SITEMAP = "sitemap_urls array<string>, queued_urls array<string>"
ERROR = "message string, category string, status_code string, url string"
#: Tables of which a batch holds a part that later parts overrule, and those that only grow.
STATE, HISTORY = ("results", "queue", "robots", "sitemap"), ("errors", "timeline")
UNSAID = "The rite failed."  # fixed value: what an error without a message says


def split_events(lines: DataFrame) -> dict[str, DataFrame]:
    """(seq, line) with line the JSON of one event, {"type", "payload"} -> the batch's part of each table.

    Lines that are no JSON are dropped; an event of another type, or whose payload is no object, is in the timeline alone. An empty payload
    is an object without fields.
    """
    said = F.get_json_object("line", "$.payload")
    payload = F.when(said.isNull() | said.isin("", "[]", "0", "false"), F.lit("{}")).otherwise(said)
    events = lines.where(F.try_parse_json("line").isNotNull()).select("seq", F.coalesce(F.get_json_object("line", "$.type"), F.lit("")).alias("type"), F.when(payload.startswith("{"), payload).otherwise("{}").alias("payload"), payload.startswith("{").alias("is_object"))
    of = lambda kind, schema: events.where((F.col("type") == kind) & F.col("is_object")).select("seq", F.from_json("payload", schema).alias("p"))
    newest = lambda rows: rows.groupBy().agg(F.max_by("p", "seq").alias("p"), F.max("seq").alias("seq")).where("seq IS NOT NULL").select("seq", "p")
    text = {c: F.coalesce(F.col(f"p.{c}"), F.lit("")) for c in ("content_type", "source_page", "error_kind", "error_message", "source_kind")}
    results = of("result", RESULT).where(F.coalesce("p.url", F.lit("")) != "").select(
        "seq", "p.url", "p.status_code", text["content_type"].alias("content_type"), "p.depth", text["source_page"].alias("source_page"), F.coalesce("p.discovery_time", F.lit(0).cast("bigint")).alias("discovery_time"),
        F.coalesce(F.nullif("p.state", F.lit("")), F.lit("pending")).alias("state"), *[text[c].alias(c) for c in ("error_kind", "error_message", "source_kind")],
    )
    part = lambda name, label: F.when(F.coalesce(F.col(f"p.{name}"), F.lit("")).isin("", "0"), None).otherwise(F.concat(F.lit(label), F.col(f"p.{name}")))
    message = F.concat_ws(" | ", F.coalesce(F.nullif("p.message", F.lit("")), F.lit(UNSAID)), part("category", "category="), part("status_code", "status="), part("url", "url="))
    return {
        "results": newest_by(results, "url"), "queue": newest(of("queue", QUEUES)), "robots": newest(of("robots", ROBOTS)), "sitemap": newest(of("sitemap", SITEMAP)),
        "errors": of("error", ERROR).select("seq", message.alias("line")), "timeline": events.select("seq", F.col("type").alias("event_type"), "payload"),
    }


def newest_by(rows: DataFrame, key: str) -> DataFrame:
    """The row of the greatest seq of each key; rows are combined before they are dealt by key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(*rest)).alias("r")).select(*[F.col(key) if c == key else F.col(f"r.{c}") for c in rows.columns])


def _logs(spark: SparkSession, folder: str) -> tuple[RunLog, RunLog, RunLog]:
    return RunLog(spark, f"{folder}/merged"), RunLog(spark, f"{folder}/state"), RunLog(spark, f"{folder}/history")


def ingest_batch(lines: DataFrame, number: int, folder: str, merge_every: int = 16) -> None:
    """Takes batch ``number`` (from 0) of (seq, line) into the tables in ``folder``; one that is there already changes nothing.

    A batch writes what is new alone. After every ``merge_every`` of them the parts of the tables by key are merged into one, so
    that a reader meets few files; what is only added is never written again.
    """
    merged, state, history = _logs(lines.sparkSession, folder)
    base = merged.last()
    through = base.facts["through"] if base else 0
    lines = lines.persist()
    try:
        parts = split_events(lines)
        for log, names in ((history, HISTORY), (state, STATE)):
            if number + 1 > (through if log is state else 0) and all(e.number != number + 1 for e in log.entries()):
                try:
                    log.commit("batch", {n: parts[n] for n in names}, {"batch": number}, after=number)
                except EntryTaken:
                    pass
    finally:
        lines.unpersist()
    if number + 1 - through >= merge_every:
        entry = merged.commit("merged", {n: _settled(merged, state, n) for n in STATE}, {"through": number + 1})
        merged.drop_before(entry.number - 1)
        state.drop_before(number + 2 - merge_every)


def _settled(merged: RunLog, state: RunLog, name: str) -> DataFrame | None:
    """A table by key: what was merged, overruled by the parts of the batches since."""
    base = merged.last()
    parts = [state.union([e for e in state.entries() if e.number > (base.facts["through"] if base else 0)], name), merged.table(base, name) if base else None]
    parts = [p for p in parts if p is not None]
    if not parts:
        return None
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return newest_by(rows, "url") if name == "results" else rows.groupBy().agg(F.max_by("p", "seq").alias("p"), F.max("seq").alias("seq")).where("seq IS NOT NULL").select("seq", "p")


def ingested(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables so far: results (a row per URL), queue (queue, count, items), robots and sitemap (one row or none), errors and timeline (seq, ...)."""
    merged, state, history = _logs(spark, folder)
    out = {name: _settled(merged, state, name) for name in STATE} | {name: history.union(history.entries(), name) for name in HISTORY}
    out = {name: df for name, df in out.items() if df is not None}
    if "queue" in out:
        count = lambda d: F.coalesce(d["count"], F.lit(0).cast("bigint"))
        out["queue"] = out["queue"].select(F.explode("p").alias("queue", "d")).select("queue", count(F.col("d")).alias("count"), _list(F.col("d")["items"]).alias("items"))
        out["robots"] = out["robots"].select(_list(F.col("p.rules")).alias("rules"), "p.crawl_delay")
        out["sitemap"] = out["sitemap"].select(_list(F.col("p.sitemap_urls")).alias("sitemap_urls"), _list(F.col("p.queued_urls")).alias("queued_urls"))
    return out


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def ingest_stream(lines: DataFrame, folder: str, merge_every: int = 16) -> StreamingQuery:
    """Runs a stream of (seq, line) into the tables in ``folder`` until what is there is used up; started again, it goes on where it ended."""
    put = lambda batch, number: ingest_batch(batch, number, folder, merge_every)
    return lines.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
