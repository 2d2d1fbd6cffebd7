"""Queries that run the table of events as a stream of files, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crawl
from ..streaming import crawl_stream, ingest
from . import page_queries
from .page_queries import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


def in_three_runs(spark: SparkSession, rows: DataFrame, by: str, run) -> None:
    """A third of the rows arrives as files, the stream ``run(stream, folder)`` uses them up and ends; the next third does, and it is started again."""
    folder = crawl.scratch_folder(spark)
    low, high = rows.agg(F.percentile_approx(by, [1 / 3, 2 / 3])).first()[0] or (0, 0)
    at = F.col(by)
    for part in (at <= low, (at > low) & (at <= high), at > high):
        rows.where(part).write.mode("append").parquet(f"{folder}/in")
        run(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), folder)


@query("politeness_on_stream", page_queries.SQL["politeness_replay"])
def politeness_on_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = []
    run = lambda stream, folder: found.append(crawl_stream.run_available(crawl_stream.politeness_stream(stream, 0.5, 1.0), folder))
    in_three_runs(spark, page_queries.requests(spark, sf_dir), "at", run)
    return found[-1]


@query("last_log_entries_on_stream", "SELECT event_type AS channel, event_id AS seq, 'user ' || user_id AS line FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 150")
def last_log_entries_on_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, found = read(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), F.col("event_id").alias("seq"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("line")), []
    in_three_runs(spark, entries, "seq", lambda stream, folder: found.append(crawl_stream.run_available(crawl_stream.last_entries_stream(stream, 150), folder, "update")))
    return crawl_stream.latest_by_key(found[-1], "channel", "newest").select("channel", F.explode("entries").alias("e")).select("channel", "e.seq", "e.line")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, line): the events as messages of a crawl: views are results, clicks queues, signups robots files, purchases sitemaps."""
    text = lambda c: F.col(c).cast("string")
    k = F.col("event_id")
    payload = {
        "view": F.to_json(F.struct(F.concat(F.lit("http://h/"), text("user_id")).alias("url"), F.when(k % 4 > 0, (200 + 100 * (k % 4)).cast("int")).alias("status_code"), (k % 5).cast("int").alias("depth"), F.when(k % 3 > 0, F.lit("done")).alias("state"))),
        "click": F.to_json(F.struct(F.struct(k.alias("count"), F.array(F.concat(F.lit("u"), text("user_id"))).alias("items")).alias("pending"), F.struct(F.array().cast("array<string>").alias("items")).alias("active"))),
        "signup": F.to_json(F.struct(F.array(F.concat(F.lit("/p"), (k % 9).cast("string"))).alias("rules"), F.col("value").alias("crawl_delay"))),
        "purchase": F.to_json(F.struct(F.array(F.concat(F.lit("s"), text("event_id"))).alias("sitemap_urls"))),
        "error": F.to_json(F.struct(F.when(k % 2 > 0, F.concat(F.lit("m"), text("user_id"))).alias("message"), F.lit("net").alias("category"), F.when(k % 4 > 0, (k % 4)).alias("status_code"))),
    }
    kinds = {"view": "result", "click": "queue", "signup": "robots", "purchase": "sitemap", "error": "error"}
    line = F.coalesce(*[F.when(F.col("event_type") == e, F.concat(F.lit(f'{{"type": "{kind}", "payload": '), payload[e], F.lit("}"))) for e, kind in kinds.items()])
    return read(spark, sf_dir, "events").select(k.alias("seq"), line.alias("line"))


def taken_in(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The messages taken in over three runs of a stream."""
    folder = f"{crawl.scratch_folder(spark)}/ingest"
    in_three_runs(spark, event_lines(spark, sf_dir), "seq", lambda stream, _: ingest.ingest_stream(stream, folder, merge_every=2).awaitTermination())
    return ingest.ingested(spark, folder)


@query("ingested_results", """
SELECT 'http://h/' || user_id AS url, max(event_id) AS seq, arg_max(CASE WHEN event_id % 4 > 0 THEN 200 + 100 * (event_id % 4) ELSE -1 END, event_id)::INT AS status_code,
  arg_max(event_id % 5, event_id)::INT AS depth, arg_max(CASE WHEN event_id % 3 > 0 THEN 'done' ELSE 'pending' END, event_id) AS state FROM events WHERE event_type = 'view' GROUP BY user_id""")
def ingested_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_in(spark, sf_dir)["results"].select("url", "seq", F.coalesce("status_code", F.lit(-1)).alias("status_code"), "depth", "state")


@query("ingested_messages", r"""
SELECT 'queue' AS target, 'pending' AS key, max(event_id)::VARCHAR || ':u' || arg_max(user_id, event_id) AS value FROM events WHERE event_type = 'click'
UNION ALL SELECT 'queue', 'active', '0:' FROM events WHERE event_type = 'click' GROUP BY 1
UNION ALL SELECT 'robots', '/p' || arg_max(event_id % 9, event_id), arg_max(value, event_id)::VARCHAR FROM events WHERE event_type = 'signup'
UNION ALL SELECT 'sitemap', 's' || max(event_id), '' FROM events WHERE event_type = 'purchase'
UNION ALL SELECT 'errors', event_id::VARCHAR, CASE WHEN event_id % 2 > 0 THEN 'm' || user_id ELSE 'The rite failed.' END || ' | category=net' || CASE WHEN event_id % 4 > 0 THEN ' | status=' || (event_id % 4) ELSE '' END FROM events WHERE event_type = 'error'
UNION ALL SELECT 'timeline', CASE event_type WHEN 'view' THEN 'result' WHEN 'click' THEN 'queue' WHEN 'signup' THEN 'robots' WHEN 'purchase' THEN 'sitemap' ELSE 'error' END, count(*)::VARCHAR FROM events GROUP BY event_type""")
def ingested_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = taken_in(spark, sf_dir)
    row = lambda df, target, key, value: df.select(F.lit(target).alias("target"), key.alias("key"), value.alias("value"))
    joined = lambda c: F.array_join(c, ",")
    parts = [
        row(t["queue"], "queue", F.col("queue"), F.concat(F.col("count").cast("string"), F.lit(":"), joined("items"))), row(t["robots"], "robots", joined("rules"), F.col("crawl_delay").cast("string")),
        row(t["sitemap"], "sitemap", joined("sitemap_urls"), joined("queued_urls")), row(t["errors"], "errors", F.col("seq").cast("string"), F.col("line")),
        row(t["timeline"].groupBy("event_type").agg(F.count("*").alias("n")), "timeline", F.col("event_type"), F.col("n").cast("string")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
