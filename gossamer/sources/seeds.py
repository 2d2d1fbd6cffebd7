"""Seed sources: robots files, sitemaps, archive listings; bodies come as rows, fetching is the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U

#: The crawler's name in robots files, and the bounds of seeding.
ROBOTS_AGENT = "gossamercrawler/1.0"
MAX_SITEMAPS, MAX_INDEXES, MAX_ARCHIVED = 25, 3, 200
DEFAULT_SITEMAPS = ("/sitemap.xml", "/sitemap_index.xml")

SEED_PROVIDERS: dict[str, Callable[..., DataFrame]] = {}


def seed_provider(name: str):
    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        SEED_PROVIDERS[name] = f
        return f

    return register


def robot_lines(bodies: DataFrame) -> DataFrame:
    """(url, body) -> url, line, directive, value, grp: the lines of robots files with the number of their group.

    A group starts at a blank line, and at a user-agent line after rules of its own. That is a running sum of
    starts in each file; files are small, and each is a window of its own.
    """
    lines = bodies.select("url", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("line", "raw"))
    lines = lines.withColumn("text", F.trim(F.substring_index("raw", "#", 1)))
    lines = lines.where((F.col("text") == "") | F.col("text").contains(":"))
    lines = lines.select(
        "url", "line", (F.col("text") == "").alias("blank"), F.lower(F.trim(F.substring_index("text", ":", 1))).alias("directive"),
        F.trim(F.substring(F.col("text"), F.instr("text", ":") + 1, F.length("text"))).alias("value"),
    )
    order = Window.partitionBy("url").orderBy("line")
    block = F.sum(F.col("blank").cast("int")).over(order)
    lines = lines.withColumn("block", block).where(~F.col("blank"))
    # The last line before this one in its block that is an agent, a rule or a delay.
    matters = F.when(F.col("directive").isin("user-agent", "allow", "disallow", "crawl-delay"), F.when(F.col("directive") == "crawl-delay", F.when(F.col("value").try_cast("double").isNotNull(), F.col("directive"))).otherwise(F.col("directive")))
    in_block = Window.partitionBy("url", "block").orderBy("line")
    last = F.last(matters, ignorenulls=True).over(in_block.rowsBetween(Window.unboundedPreceding, -1))
    starts = (F.col("directive") == "user-agent") & F.coalesce(last != "user-agent", F.lit(False))
    grp = F.sum(starts.cast("int")).over(in_block)
    return lines.withColumn("part", grp).select("url", "line", F.concat_ws(".", F.col("block").cast("string"), F.col("part").cast("string")).alias("grp"), "directive", "value")


def robots_rules(bodies: DataFrame, agent: str = ROBOTS_AGENT) -> DataFrame:
    """(url, body) -> url, ord, directive, path, crawl_delay: rules of all best-matching groups, once each in order of their first mention.

    Of agent names, * scores 0 and a prefix of the crawler's name its length. crawl_delay is the largest
    of those groups. Rules before any agent line are of nobody.
    """
    lines = robot_lines(bodies)
    agents = lines.where("directive = 'user-agent'")
    score = F.when(F.lower("value") == "*", F.lit(0)).when((F.col("value") != "") & F.lit(agent).startswith(F.lower("value")), F.length("value")).otherwise(F.lit(-1))
    groups = agents.groupBy("url", "grp").agg(F.max(score).alias("score"), F.min("line").alias("from_line")).where("score >= 0")
    best = groups.withColumn("rank", F.rank().over(Window.partitionBy("url").orderBy(F.col("score").desc()))).where("rank = 1").select("url", "grp", "from_line")
    mine = lines.join(best, ["url", "grp"]).where("line > from_line")
    # A delay that is no number unsets its group's; the last one of a group counts.
    delays = mine.where("directive = 'crawl-delay'").groupBy("url", "grp").agg(F.max_by(F.greatest(F.col("value").try_cast("double"), F.lit(0.0)), "line").alias("d")).groupBy("url").agg(F.max("d").alias("crawl_delay"))
    rules = mine.where("directive IN ('allow', 'disallow')").groupBy("url", F.upper("directive").alias("directive"), F.col("value").alias("path")).agg(F.min("line").alias("line"))
    place = F.row_number().over(Window.partitionBy("url").orderBy("line"))
    return rules.join(delays, "url", "left").select("url", place.alias("ord"), "directive", "path", "crawl_delay")


def robots_sitemaps(bodies: DataFrame) -> DataFrame:
    """(url, sitemap): sitemap lines, which belong to no group."""
    return robot_lines(bodies).where("directive = 'sitemap'").select("url", U.normalize_url(F.col("value")).alias("sitemap")).where("sitemap != ''").distinct()


@seed_provider("robots")
def robots_seeds(bodies: DataFrame) -> DataFrame:
    """(url, seed): allowed and disallowed paths alike are places to look at."""
    rules = robots_rules(bodies)
    seed = U.seedable_robot_path(F.col("path"))
    return rules.select("url", F.when(seed != "", U.normalize_url(seed, F.col("url"))).alias("seed")).where("seed != ''").distinct()


def robots_dataset(bodies: DataFrame) -> DataFrame:
    """(url, value): rule paths and sitemap addresses."""
    return robots_rules(bodies).select("url", F.col("path").alias("value")).union(robots_sitemaps(bodies)).distinct()


def _sitemap_entries(body: str) -> list[tuple[str, bool]]:
    """(address, is a nested sitemap) of a sitemap; text that is no XML gives its lines."""
    try:
        root = ElementTree.fromstring(body)
    except ElementTree.ParseError:
        return [(line.strip(), False) for line in body.splitlines() if line.strip()]
    bare = lambda tag: str(tag).rpartition("}")[2].lower()
    index = bare(root.tag) == "sitemapindex"
    return [(node.text.strip(), index) for node in root.iter() if bare(node.tag) == "loc" and node.text and node.text.strip()]


def sitemap_entries(bodies: DataFrame) -> DataFrame:
    """(url, body) -> url, loc, nested. XML that may be broken needs a parser that says so: one Arrow pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(u, loc, nested) for u, b in zip(batch["url"], batch["body"], strict=True) if b for loc, nested in _sitemap_entries(b)]
            yield pd.DataFrame(rows, columns=["url", "raw", "nested"])

    raw = bodies.select("url", "body").mapInPandas(run, "url string, raw string, nested boolean")
    return raw.select("url", U.normalize_url(F.col("raw"), F.col("url")).alias("loc"), "nested").where("loc != ''").distinct()


@seed_provider("sitemaps")
def sitemap_urls(bodies: DataFrame, roots: DataFrame, max_sitemaps: int = MAX_SITEMAPS) -> DataFrame:
    """(url, depth) of pages that the sitemaps reachable from ``roots`` (url) list.

    Level by level over the table of bodies; a sitemap is read once, at most ``max_sitemaps`` of them, in order of
    level and address. The level's frontier and the visited set are at most that many rows.
    """
    from ..operators.crawl import walk

    entries = sitemap_entries(bodies)
    nested = entries.where("nested").select(F.col("url").alias("src"), F.col("loc").alias("dst"))
    visited = walk(nested, roots.select("url"), max_depth=max_sitemaps).orderBy("depth", "url").limit(max_sitemaps)
    return entries.where("NOT nested").join(visited, "url").groupBy(F.col("loc").alias("url")).agg(F.min("depth").alias("depth"))


def archive_targets(hosts: DataFrame) -> DataFrame:
    """(host, domain) -> host, ord, target: what to ask an archive for, host, domain and its subdomains, once each."""
    targets = F.array_distinct(F.filter(F.array(F.trim(F.coalesce("host", F.lit(""))), F.trim(F.coalesce("domain", F.lit(""))), F.concat(F.lit("*."), F.coalesce("domain", F.lit("")))), lambda t: t != ""))
    return hosts.select("host", F.posexplode(targets).alias("ord", "target"))


def archive_requests(targets: DataFrame, indexes: DataFrame, limit: int = MAX_ARCHIVED) -> DataFrame:
    """(target) and index listings (id) -> target, index, address: what to fetch of the page index and of the newest crawl indexes, at most ``limit`` entries of each."""
    # The two public listings and their parameters.
    quoted = F.replace(F.url_encode(F.col("target")), F.lit("%2A"), F.lit("*"))
    pages = targets.select("target", F.lit("").alias("index"), F.concat(F.lit("https://web.archive.org/cdx/search/cdx?url="), quoted, F.lit(f"%2F*&output=text&fl=original&collapse=urlkey&limit={limit}")).alias("address"))
    crawls = targets.crossJoin(F.broadcast(newest_indexes(indexes.where("id != ''")).select(F.col("id").alias("index"))))  # three rows
    return pages.unionByName(crawls.select("target", "index", F.concat(F.lit("https://index.commoncrawl.org/"), "index", F.lit("-index?url="), quoted, F.lit(f"%2F*&output=json&limit={limit}")).alias("address")))


@seed_provider("archives")
def archive_urls(lines: DataFrame) -> DataFrame:
    """(line) -> url: listings of plain addresses or of JSON objects with a url, canonical and distinct."""
    bare = U.strip(F.col("line"))
    raw = F.when(bare.startswith("{"), F.coalesce(F.get_json_object(bare, "$.url"), F.lit(""))).otherwise(bare)
    return lines.select(U.normalize_url(raw).alias("url")).where("url != ''").distinct()


def newest_indexes(indexes: DataFrame, n: int = MAX_INDEXES) -> DataFrame:
    """The n indexes with the largest ids."""
    return indexes.orderBy(F.col("id").desc()).limit(n)


def merge_seeds(*seeds: DataFrame) -> DataFrame:
    """Distinct union of seed tables with a column ``url``."""
    out = seeds[0].select("url")
    for s in seeds[1:]:
        out = out.unionByName(s.select("url"))
    return out.distinct()


def harvest_seeds(sources: dict[str, tuple]) -> DataFrame:
    """(url, providers): the seeds of every registered provider that ``sources`` has the arguments of, once each, with the providers that told them."""
    out = None
    for name, provider in SEED_PROVIDERS.items():
        if name in sources:
            found = provider(*sources[name])
            found = found.select(F.col("seed" if "seed" in found.columns else "url").alias("url"), F.lit(name).alias("provider"))
            out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError(f"no registered provider among {sorted(sources)}")
    return out.groupBy("url").agg(F.array_sort(F.collect_set("provider")).alias("providers"))
