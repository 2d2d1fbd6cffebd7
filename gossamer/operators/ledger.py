"""Views over a run's records: ledger rows, filters, facets, panels, summary cards, run lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .crawl import number_rows

PANEL_ITEMS, DIFF_ITEMS, CARDS = 250, 16, 6
FACETS = ("state", "bucket", "error_kind", "content_type", "source_kind")


def ledger_rows(records: DataFrame, redirects: DataFrame, exports: tuple[str, ...] = ()) -> DataFrame:
    """Records with their redirect chain, discovery path, panel, status bucket and export kinds; of repeated redirect lines the last counts."""
    parsed = redirects.select(T.parse_redirect(F.col("line")).alias("r"), "line").select("r.url", "r.chain", "line")
    chains = parsed.groupBy("url").agg(F.max_by("chain", "line").alias("redirect_chain"))
    rows = records.join(chains, "url", "left")
    return rows.select(
        *records.columns, F.coalesce("redirect_chain", F.array().cast("array<string>")).alias("redirect_chain"),
        F.filter(F.array(F.coalesce("source_page", F.lit("")), "url"), lambda x: x != "").alias("discovery_path"),
        T.related_panel(F.col("state"), F.col("source_kind"), F.col("content_type")).alias("panel"), T.status_bucket(F.col("error_kind"), F.col("status_code"), F.col("state")).alias("bucket"),
        F.array(*[F.lit(e) for e in exports]).cast("array<string>").alias("export_kinds"),
    )


def filter_ledger(rows: DataFrame, query: str = "", **facets: str) -> DataFrame:
    """Rows with the given facet values whose JSON holds the query, in any case."""
    for name, value in facets.items():
        rows = rows.where(F.col(name) == value)
    return rows.where(F.contains(F.lower(F.to_json(F.struct(*rows.columns))), F.lit(query.strip().lower()))) if query.strip() else rows


def sort_ledger(rows: DataFrame, key: str = "discovery_time", ascending: bool = True) -> DataFrame:
    """Numbers as numbers, missing as 0; texts by locale; the address breaks ties, in the same direction."""
    if key in ("status_code", "depth", "discovery_time"):
        first = F.coalesce(F.col(key), F.lit(0))
    else:
        first = F.collate(F.coalesce(F.col(key), F.lit("")), "UNICODE")
    order = [first, F.collate(F.col("url"), "UNICODE")]
    return rows.orderBy(*[c.asc() if ascending else c.desc() for c in order])


def facet_values(rows: DataFrame, facets: tuple[str, ...] = FACETS) -> DataFrame:
    """(facet, value) distinct and not empty."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets]))
    return rows.select(pairs.alias("p")).select("p.facet", "p.value").where("value != ''").distinct()


def panels(findings: DataFrame, items: int = PANEL_ITEMS) -> DataFrame:
    """(dataset, value) -> dataset, n, items: the count and the first values of each."""
    counts = findings.groupBy("dataset").agg(F.count("*").alias("n"))
    top = findings.withColumn("k", F.row_number().over(Window.partitionBy("dataset").orderBy("value"))).where(F.col("k") <= items)
    return counts.join(top.groupBy("dataset").agg(F.array_sort(F.collect_list("value")).alias("items")), "dataset")


def summary_cards(findings: DataFrame, mode: str = "generic") -> DataFrame:
    """(label, value) of a run: the four common cards, then the mode's two; one aggregation over the long table of findings."""
    is_ = lambda name: F.col("dataset") == name
    count = lambda name, more=None: F.count_if(is_(name) & (F.lit(True) if more is None else more))
    v = F.col("value")
    documents = count("files", F.lower(v).rlike(r"\.(?:pdf|docx?|xlsx?|pptx?|odt|ods|odp|rtf)$"))
    # The labels by which readers of a run know its cards.
    own = {
        "document": {"TOMBS": count("document_metadata"), "LEAKS": count("document_leaks")}, "js-intel": {"SIGILS": count("js_intel"), "SCRIPTS": count("scripts")},
        "forum": {"THREADS": count("threads"), "REPLIES": count("threads", v.contains("reply_to="))}, "geo": {"EXACT": count("locations", v.contains("confidence=exact")), "WEAK": count("locations", v.contains("confidence=weak"))},
        "news": {"PAGES": count("stories", v.contains(" relation=page ")), "MIRRORS": count("stories", v.contains(" relation=mirror "))}, "hidden": {"SHADOWS": count("hidden_paths"), "PROBES": count("hidden_probe_sources")},
        "scam": {"HEXES": count("scam_signals"), "RUSES": F.count_distinct(F.when(is_("scam_signals"), F.regexp_extract(v, r"signal=(\S+)", 1)))}, "temporal": {"DIFFS": count("temporal_diffs"), "VISITED": count("visited")},
    }.get(mode, {"DOCS": documents, "SCRIPTS": count("scripts")})
    cards = {"LINKS": count("internal"), "RELICS": count("files"), "MAIL": count("intel", v.contains("EMAIL:")), "OMENS": count("failed")} | own
    one = findings.agg(*[c.alias(k) for k, c in cards.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.col(k).cast("bigint").alias("value")) for k in list(cards)[:CARDS]])).alias("c")).select("c.*")


def list_runs(runs: DataFrame) -> DataFrame:
    """(id, source, is_current, ended_at) with the first source of each id: current first, then the latest."""
    one = runs.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("source"))).where("k = 1").drop("k")
    return one.orderBy(F.col("is_current").desc(), F.col("ended_at").desc(), F.col("id").desc())


def older_run(runs: DataFrame) -> DataFrame:
    """(id, against): each run and the one before it in time, null for the first. Runs are numbered by range of time, so that no task holds all of them."""
    placed = number_rows(runs.select("id", "ended_at"), ["ended_at", "id"], "place")
    before = placed.select(F.col("id").alias("against"), (F.col("place") + 1).alias("place"))
    return placed.join(before, "place", "left").select("id", "against")


def last_entries(events: DataFrame, n: int, by: str = "channel", order: str = "seq") -> DataFrame:
    """The last n rows of each channel, as a bounded log keeps them."""
    return events.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc()))).where(F.col("k") <= n).drop("k")


def autopsy_report(records: DataFrame, findings: DataFrame, histogram: DataFrame, duration_seconds: float, shown: int = 20) -> DataFrame:
    """One row: run summary, counts by dataset, first findings, top content types."""
    run = records.agg(F.count("*").alias("urls"), F.count_if(F.col("state") == "completed").alias("completed"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.col("state") == "skipped").alias("skipped"))
    exposure = panels(findings, shown).agg(F.array_sort(F.collect_list(F.struct("dataset", "n", "items"))).alias("exposure"))
    types = histogram.orderBy(F.col("n").desc(), "content_type").limit(8).agg(F.collect_list(F.struct("content_type", "n")).alias("content_types"))
    return run.withColumn("duration_seconds", F.lit(float(duration_seconds))).crossJoin(exposure).crossJoin(types)


def autopsy_markdown(report: DataFrame) -> str:
    """The report's one row as Markdown."""
    row = report.first()
    lines = ["# Autopsy", "", f"- URLs: {row['urls']} ({row['completed']} completed, {row['failed']} failed, {row['skipped']} skipped)", f"- Seconds: {row['duration_seconds']:g}", ""]
    for part in row["exposure"]:
        lines += [f"## {part['dataset']} ({part['n']})", "", *(f"- {x}" for x in part["items"]), ""]
    return "\n".join(lines)
