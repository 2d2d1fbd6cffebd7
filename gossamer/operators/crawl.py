"""Crawl relations: frontier, breadth-first walk, record upsert, queue and status views."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..sources.runlog import RunLog

# Outside domains that count as findings, and words of subdomain candidates.
INTEL_DOMAINS = (
    "facebook.com", "twitter.com", "github.com", "linkedin.com", "instagram.com", "youtube.com", "reddit.com", "pastebin.com",
    "pinterest.com", "tumblr.com", "flickr.com", "vimeo.com", "soundcloud.com", "medium.com", "quora.com", "discord.gg",
    "telegram.me", "t.me", "twitch.tv", "tiktok.com", "s3.amazonaws.com", "storage.googleapis.com", "blob.core.windows.net",
)
SUBDOMAIN_WORDS = ("www", "mail", "ftp", "smtp", "pop", "ns1", "ns2", "blog", "dev", "api", "static", "cdn", "media", "shop", "secure", "vpn", "admin", "portal", "app", "test")
QUEUE_SHOWN = 12


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for written levels under spark.checkpoint.dir, or a temporary one in local mode; it goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            root = known.get()
        elif spark.sparkContext.master.startswith("local["):
            root = tempfile.mkdtemp(prefix="gossamer-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/walk-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


def frontier(internal: DataFrame, processed: DataFrame, exclude: str | None = None) -> DataFrame:
    """Known URLs not yet processed, without those a pattern excludes."""
    left = internal.select("url").distinct().join(processed.select("url"), "url", "left_anti")
    return left.where(~F.col("url").rlike(exclude)) if exclude else left


def walk(edges: DataFrame, roots: DataFrame, max_depth: int = 8) -> DataFrame:
    """(url, depth): what is reachable over edges (src, dst) from roots (url), each with its least depth.

    Roots with a column ``depth`` are what an earlier walk has found, and this one goes on from its last level.
    One job per level: frontier joined with the edges, without what was visited. Levels are written to
    the shared folder, so plans stay short and survive lost executors; and Spark knows the bytes of each frontier, so
    one below its broadcast threshold meets the edges where they are.
    """
    return walk_logged(edges, roots, scratch_folder(edges.sparkSession), max_depth).select("url", "depth")


def walk_logged(edges: DataFrame | None, roots: DataFrame | None, folder: str, max_depth: int = 8, spark: SparkSession | None = None) -> DataFrame:
    """(url, depth, parent): the walk with its phases logged in ``folder``, where another session can take it up.

    The log has the edges, the roots as phase ``seeded``, each level as ``depth-N``, and ``complete`` once a level is empty; each is published as a
    whole (runlog), so a walk that was stopped anywhere goes on after its last whole level. What the log has of edges and roots
    counts, and a walk that goes on needs neither. A complete walk, or one that has the levels asked for, is only read.

    ``parent`` is the smallest URL of the level before that leads there; roots have none. A root may come with its ``depth`` and ``parent``.
    """
    spark = spark or edges.sparkSession
    log = RunLog(spark, folder)
    done = log.entries()
    if not any(e.phase == "seeded" for e in done):
        depth = F.col("depth").cast("int") if "depth" in roots.columns else F.lit(0)
        parent = F.col("parent").cast("string") if "parent" in roots.columns else F.lit(None).cast("string")
        seeds = roots.groupBy("url").agg(F.min(F.struct(depth.alias("depth"), parent.alias("parent"))).alias("s")).select("url", "s.depth", "s.parent")
        done.append(log.commit("seeded", {"edges": edges.select("src", "dst").distinct(), "level": seeds}, after=0))
    edges = log.table(done[0], "edges")
    reached = done[-1].facts.get("depth")
    if reached is None:
        reached = log.table(done[0], "level").agg(F.max("depth")).first()[0] or 0
    while reached < max_depth and done[-1].phase != "complete":
        reached += 1
        known = log.union(done, "level")
        last = log.table(done[-1], "level").where(F.col("depth") == reached - 1)
        found = last.join(edges, last["url"] == edges["src"]).groupBy(F.col("dst").alias("url")).agg(F.min("src").alias("parent"))
        fresh = found.join(known.select("url"), "url", "left_anti").select("url", F.lit(reached).alias("depth"), "parent")
        done.append(log.commit(f"depth-{reached}", {"level": fresh}, {"depth": reached}, after=done[-1].number))
        if log.table(done[-1], "level").isEmpty():
            done.append(log.commit("complete", facts={"depth": reached}, after=done[-1].number))
    return log.union(done, "level")


def walk_paths(walked: DataFrame) -> DataFrame:
    """(url, depth, parent) -> the same and ``path``, the URLs from the root to each.

    By doubling pointers: each row keeps the ancestors that it knows and the next one after them, and takes over what that one
    knows, twice as much in every round; so a path of 1,000 steps takes ten joins.
    """
    spark, folder, k = walked.sparkSession, scratch_folder(walked.sparkSession), 0
    rows = walked.select("url", "depth", "parent", F.col("parent").alias("next"), F.array("url").alias("path"))
    while True:
        rows.write.parquet(f"{folder}/round={k}")
        rows, k = spark.read.parquet(f"{folder}/round={k}"), k + 1
        if rows.where("next IS NOT NULL").isEmpty():
            return rows.select("url", "depth", "parent", "path")
        known = rows.select(F.col("url").alias("next"), F.col("next").alias("then"), F.col("path").alias("before"))
        ended = rows.where("next IS NULL")
        # An ancestor that is not in the table ends a path.
        went = rows.where("next IS NOT NULL").join(known, "next", "left").select("url", "depth", "parent", F.col("then").alias("next"), F.when(F.col("before").isNull(), F.col("path")).otherwise(F.concat("before", "path")).alias("path"))
        rows = ended.unionByName(went)


def upsert_records(events: DataFrame) -> DataFrame:
    """Crawl records from state events (seq, url, source_page, source_kind, depth, state, status_code, content_type, error_kind, error_message).

    The first source page and kind that are not empty stay; of the other fields the last that is not null
    counts. first_seq is the URL's first event, by which ``discovered`` numbers the records where that is wanted.
    """
    kept = lambda c: F.coalesce(F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("seq"))), F.lit("")).alias(c)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    rows = events.where(F.coalesce("url", F.lit("")) != "").groupBy("url").agg(
        F.min("seq").alias("first_seq"), kept("source_page"), kept("source_kind"), last("depth"), last("state"), last("status_code"), last("content_type"), last("error_kind"), last("error_message")
    )
    blank = {c: F.coalesce(F.col(c), F.lit("")) for c in ("content_type", "error_kind", "error_message")}
    return rows.withColumns(blank | {"state": F.coalesce("state", F.lit("pending"))})


def discovered(records: DataFrame) -> DataFrame:
    """Records with discovery_time, their place in the order of first events, in place of first_seq."""
    return number_rows(records, ["first_seq", "url"], "discovery_time").drop("first_seq")


def number_rows(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: places from 1 in the order of the columns, without gathering the rows in one task.

    Rows are dealt by range of the order; each range numbers its own and adds the sizes of the ranges
    before, of which there are as many as partitions.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("__range", F.spark_partition_id())
    folder = scratch_folder(spark)
    dealt.write.parquet(f"{folder}/ranges")
    dealt = spark.read.parquet(f"{folder}/ranges")
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    offsets = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.join(F.broadcast(offsets), "__range").withColumn(name, place + F.col("__before")).drop("__range", "__before")


def queue_state(state: Column) -> Column:
    """Failed URLs are completed ones in the queue."""
    return F.when(state == "failed", F.lit("completed")).otherwise(state)


def queue_snapshot(records: DataFrame, shown: int = QUEUE_SHOWN) -> DataFrame:
    """(queue, n, items): URLs of each queue state, the first of them in order.

    Counting aggregates before the shuffle; the first items come by a per-state top-k.
    """
    q = records.select(queue_state(F.col("state")).alias("queue"), "url").distinct()
    counts = q.groupBy("queue").agg(F.count("*").alias("n"))
    top = q.withColumn("k", F.row_number().over(Window.partitionBy("queue").orderBy("url"))).where(F.col("k") <= shown)
    items = top.groupBy("queue").agg(F.array_sort(F.collect_list("url")).alias("items"))
    return counts.join(items, "queue")


def content_type_histogram(responses: DataFrame) -> DataFrame:
    """(content_type, n), unknown for an empty one."""
    kind = T.content_type(F.col("content_type"))
    return responses.groupBy(F.when(kind == "", F.lit("unknown")).otherwise(kind).alias("content_type")).agg(F.count("*").alias("n"))


def top_content_types(histogram: DataFrame, n: int = 8) -> DataFrame:
    return histogram.orderBy(F.col("n").desc(), F.col("content_type")).limit(n)


def fetch_outcome(responses: DataFrame) -> DataFrame:
    """responses (url, purpose, status_code, content_type, body, error, redirect_chain) plus state, error_kind, skip_reason.

    Binary extensions are never requested; exceptions, 4xx and 5xx fail; binary types and empty bodies are
    skipped; what is left is read if its type is one that the purpose reads.
    """
    ct = T.content_type(F.col("content_type"))
    status, empty = F.col("status_code"), F.length(F.trim(F.coalesce("body", F.lit("")))) == 0
    binary = U.is_binary_url(F.col("url"))
    unread = F.when(F.col("purpose") == "page", ~T.extracts_markup(ct)).when(F.col("purpose") == "script", ~T.extracts_script(ct)).otherwise(F.lit(False))
    skip = F.when(binary, F.lit("binary-extension")).when(F.coalesce("error", F.lit("")) != "", None).when(status >= 400, None).when(T.skip_reason(ct).isNotNull(), T.skip_reason(ct)).when(empty, F.lit("empty-response")).when((status < 300) & unread, F.concat(F.lit("content-type:"), F.when(ct == "", F.lit("unknown")).otherwise(ct)))
    kind = F.when(F.coalesce("error", F.lit("")) != "", T.classify_request_error(F.col("error"))).otherwise(T.error_kind(status))
    done = responses.withColumn("skip_reason", skip)
    failed = (F.coalesce("error", F.lit("")) != "") | (status >= 300)
    state = F.when(F.col("skip_reason").isNotNull(), F.lit("skipped")).when(failed, F.lit("failed")).otherwise(F.lit("completed"))
    return done.withColumn("state", state).withColumn("error_kind", F.when(F.col("state") == "skipped", F.when(F.col("skip_reason").startswith("content-type"), F.lit("unsupported-content-type")).otherwise(F.col("skip_reason"))).otherwise(kind))


def crawl_counters(outcomes: DataFrame) -> DataFrame:
    """One row of the run's eleven counters."""
    binary = F.col("skip_reason") == "binary-extension"
    status = F.col("status_code")
    return outcomes.agg(
        F.count_if(~F.coalesce(binary, F.lit(False))).alias("requests"),
        F.count_if(status.between(200, 399) & (F.coalesce("error", F.lit("")) == "") & ~F.coalesce(binary, F.lit(False))).alias("successes"),
        F.coalesce(F.sum(F.greatest(F.size("redirect_chain"), F.lit(0))), F.lit(0)).alias("redirects"),
        F.count_if((F.coalesce("error", F.lit("")) != "") | (status >= 400)).alias("failures"),
        F.count_if(status.between(400, 499)).alias("client_errors"), F.count_if(status >= 500).alias("server_errors"),
        F.count_if(F.col("state") == "skipped").alias("skipped"),
        F.count_if(F.col("skip_reason").isin("binary-extension", "binary-content")).alias("binary_skips"),
        F.count_if(F.col("skip_reason") == "empty-response").alias("empty_responses"),
        F.count_if((F.col("state") == "completed") & (F.col("purpose") == "page")).alias("markup_pages"),
        F.count_if((F.col("state") == "completed") & (F.col("purpose") == "script")).alias("script_pages"),
    )


def redirect_lines(responses: DataFrame) -> DataFrame:
    """(line) url => hop -> hop of redirected responses."""
    hops = F.concat("redirect_chain", F.array("final_url"))
    shown = F.transform(hops, lambda h: F.coalesce(F.nullif(U.normalize_url(h), F.lit("")), h))
    return responses.where(F.size("redirect_chain") > 0).select(F.concat(F.col("url"), F.lit(" => "), F.array_join(shown, " -> ")).alias("line")).distinct()


def intel_from_external(external: DataFrame, domains: tuple[str, ...] = INTEL_DOMAINS) -> DataFrame:
    """External URLs whose registrable domain is one that counts: a semi-join with a fixed list."""
    spark = external.sparkSession
    known = spark.createDataFrame([(d,) for d in domains], "domain string")
    hosts = external.select("url", U.hostname(F.col("url")).alias("host"))
    named = U.registered_domains(hosts).join(F.broadcast(known), "domain", "left_semi")
    return hosts.join(named, "host", "left_semi").select("url").distinct()


def subdomain_candidates(domains: DataFrame, words: tuple[str, ...] = SUBDOMAIN_WORDS) -> DataFrame:
    """(domain, candidate): each word before each domain; whether they resolve is asked elsewhere."""
    return domains.select("domain", F.explode(F.array(*[F.lit(w) for w in words])).alias("w")).select("domain", F.concat_ws(".", "w", "domain").alias("candidate"))


def ordered_urls(dataset: DataFrame, records: DataFrame, state: str | None = None) -> DataFrame:
    """(url) of a dataset in order of discovery, unknown ones after, by name; with a state, only records in it are known."""
    known = records.where(F.col("state") == state) if state else records
    joined = dataset.select("url").distinct().join(known.select("url", "discovery_time"), "url", "left")
    return joined.orderBy(F.col("discovery_time").isNull(), "discovery_time", "url").select("url")
