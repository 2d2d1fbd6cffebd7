"""Saved runs as tables keyed by run: artifacts, settings, queues, counts, panels, browser entries, differences, report sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import analysis
from .ledger import DIFF_ITEMS, PANEL_ITEMS, older_run

DONE, LOST = ("completed", "failed", "skipped"), ("failed", "skipped")
QUEUE_ITEMS, NEXT_PROBES, REPORT_ITEMS = 12, 12, 20
DOCUMENT = r"\.(?:pdf|docx?|xlsx?|pptx?|odt|ods|odp|rtf)$"
#: The panels of each mode in order, and the datasets that panels of another name show.
MODE_PANELS = {
    "generic": ("site_anatomy", "mutation_probes", "links", "mail", "documents", "relics", "scripts", "broken", "forms", "vitals"),
    "document": ("document_metadata", "document_leaks", "artifact_genealogy", "documents", "links", "vitals"),
    "js-intel": ("js_intel", "mutation_probes", "scripts", "links", "relics", "vitals"),
    "forum": ("threads", "links", "mail", "vitals"),
    "geo": ("locations", "links", "vitals"),
    "news": ("stories", "links", "vitals"),
    "hidden": ("hidden_paths", "hidden_probe_sources", "links", "broken", "vitals"),
    "scam": ("scam_signals", "links", "forms", "vitals"),
    "temporal": ("temporal_diffs", "artifact_genealogy", "links", "vitals"),
}
PANEL_DATASET = {"links": "internal", "mail": "intel", "documents": "files", "relics": "files", "broken": "failed"}


def run_artifacts(texts: DataFrame, checkpointed: DataFrame) -> DataFrame:
    """(run_id, name, value) of text artifacts, stats among them; a run that has none takes those of its checkpoint."""
    return texts.unionByName(checkpointed.join(texts.select("run_id").distinct(), "run_id", "left_anti"))


def saved_settings(runs: DataFrame) -> DataFrame:
    """(run_id, manifest, checkpoint, history as JSON texts) -> run_id, target, specimen, preset, mode, workflow, baseline.

    What the manifest's target says counts, else the checkpoint, else the history entry; a text that is no JSON object says nothing.
    """
    said = lambda doc, *path: F.coalesce(F.get_json_object(doc, "$." + ".".join(path)), F.lit(""))
    first = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    has = lambda doc, path: F.coalesce(F.get_json_object(doc, path).startswith("{") & (F.get_json_object(doc, path) != "{}"), F.lit(False))
    m, c, h = "manifest", "checkpoint", "history"

    def pick(target: Column, saved: Column, listed: Column, default: str = "") -> Column:
        return F.when(has(m, "$.target"), target).when(has(c, "$"), saved).when(has(h, "$"), listed).otherwise(F.lit(default))

    out = runs.withColumn("target", pick(said(m, "target", "main_url"), said(c, "main_url"), said(h, "target_url")))
    return out.select(
        "run_id", "target", pick(said(m, "target", "main_url"), first(said(c, "specimen_input"), F.col("target")), first(said(h, "target_url"), F.col("target"))).alias("specimen"),
        pick(first(said(m, "target", "preset"), said(m, "resolved_config", "preset"), F.lit("balanced")), first(said(c, "preset"), F.lit("balanced")), F.lit("balanced"), "balanced").alias("preset"),
        pick(first(said(m, "target", "mode"), said(m, "resolved_config", "mode"), F.lit("generic")), first(said(c, "mode"), F.lit("generic")), first(said(h, "mode"), F.lit("generic")), "generic").alias("mode"),
        pick(said(m, "target", "ritual_chain"), said(c, "ritual_chain"), F.lit("")).alias("workflow"), pick(said(m, "lineage", "temporal_baseline"), F.lit(""), F.lit("")).alias("baseline"),
    )


def checkpoint_queues(runs: DataFrame) -> DataFrame:
    """(run_id, checkpoint as JSON text) -> run_id, queue, n, items: each saved queue's length and first items."""
    queues = F.from_json(F.get_json_object("checkpoint", "$.queue_state"), "map<string, array<string>>")
    each = runs.select("run_id", F.explode(queues).alias("queue", "values"))
    return each.select("run_id", "queue", F.size(F.coalesce("values", F.array().cast("array<string>"))).alias("n"), F.slice("values", 1, QUEUE_ITEMS).alias("items"))


def checkpoint_seeds(runs: DataFrame) -> DataFrame:
    """(run_id, checkpoint as JSON text) -> run_id, crawl_delay, rules, sitemap_urls, queued_urls: what a checkpoint kept of robots files and sitemaps."""
    kept = lambda path: F.coalesce(F.from_json(F.get_json_object("checkpoint", path), "array<string>"), F.array().cast("array<string>"))
    return runs.select(
        "run_id", F.get_json_object("checkpoint", "$.robots_metadata.crawl_delay").try_cast("double").alias("crawl_delay"), F.size(kept("$.robots_metadata.rules")).alias("rules"),
        kept("$.sitemap_metadata.sitemap_urls").alias("sitemap_urls"), kept("$.sitemap_metadata.queued_urls").alias("queued_urls"),
    )


def run_counts(findings: DataFrame, stats: DataFrame) -> DataFrame:
    """(run_id, dataset, value) and (run_id, key, value bigint) -> run_id and its eight counts; of failures and visits the statistics' own word counts."""
    is_ = lambda name: F.col("dataset") == name
    found = findings.groupBy("run_id").agg(
        F.count_if(is_("internal")).alias("links"), F.count_if(is_("files")).alias("files"), F.count_if(is_("intel") & F.col("value").contains("EMAIL:")).alias("mail"),
        F.count_if(is_("scripts")).alias("scripts"), F.count_if(is_("files") & F.lower("value").rlike(DOCUMENT)).alias("documents"), F.count_if(is_("failed")).alias("broken"),
    )
    told = stats.groupBy("run_id").agg(F.max(F.when(F.col("key") == "visited", F.col("value"))).alias("visited"), F.max(F.when(F.col("key") == "failures", F.col("value"))).alias("failures"))
    zero = F.lit(0).cast("bigint")
    both = found.join(told, "run_id", "full_outer")
    return both.select("run_id", F.coalesce("visited", zero).alias("visited"), F.coalesce("failures", "broken", zero).alias("failures"), *[F.coalesce(c, zero).alias(c) for c in ("links", "files", "mail", "scripts", "documents", "broken")])


def live_counts(counts: DataFrame, records: DataFrame) -> DataFrame:
    """Counts with visited and failures raised to what the run's records (run_id, url, state) show by now."""
    seen = records.groupBy("run_id").agg(F.count_if(F.col("state").isin(*DONE)).alias("__done"), F.count_if(F.col("state").isin(*LOST)).alias("__lost"))
    raised = {"visited": F.greatest("visited", F.coalesce("__done", F.lit(0))), "failures": F.greatest("failures", F.coalesce("__lost", F.lit(0)))}
    return counts.join(seen, "run_id", "left").withColumns(raised).drop("__done", "__lost")


def mode_panels(findings: DataFrame, stats: DataFrame, mode: str = "generic", items: int = PANEL_ITEMS) -> DataFrame:
    """(dataset, value) and (key, value) -> ord, panel, n, items: the panels of a mode in its order; empty ones go, but for the vitals."""
    spark = findings.sparkSession
    names = MODE_PANELS.get(mode, MODE_PANELS["generic"])
    shown = spark.createDataFrame([(i + 1, p, PANEL_DATASET.get(p, p)) for i, p in enumerate(names)], "ord int, panel string, dataset string")
    vitals = stats.select(F.lit("vitals").alias("dataset"), F.concat_ws("=", "key", F.col("value").cast("string")).alias("value"))
    rows = findings.select("dataset", "value").unionByName(vitals).join(F.broadcast(shown), "dataset")
    rows = rows.where((F.col("panel") != "mail") | F.col("value").contains("EMAIL:")).where((F.col("panel") != "documents") | F.lower("value").rlike(DOCUMENT))
    counted = rows.groupBy("panel").agg(F.count("*").alias("n"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("panel").orderBy("value"))).where(F.col("k") <= items)
    listed = first.groupBy("panel").agg(F.array_sort(F.collect_list("value")).alias("items"))
    out = shown.join(counted, "panel", "left").join(listed, "panel", "left").where(F.col("n").isNotNull() | (F.col("panel") == "vitals"))
    return out.select("ord", "panel", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def browser_entries(runs: DataFrame, settings: DataFrame, counts: DataFrame) -> DataFrame:
    """runs (run_id, status, started_at, ended_at, is_current) -> one entry each, with target, mode and counts.

    A run without a status is complete if anything was found or counted, else empty.
    """
    rows = runs.join(settings.select("run_id", "target", "mode"), "run_id", "left").join(counts, "run_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    status = F.coalesce("status", F.when(F.col("links").isNotNull(), F.lit("complete")).otherwise(F.lit("empty")))
    return rows.select("run_id", F.coalesce("target", F.lit("")).alias("target"), F.coalesce("mode", F.lit("generic")).alias("mode"), status.alias("status"), "started_at", "ended_at", "is_current", *map(zero, ("visited", "failures", "links", "files")))


def run_diffs(runs: DataFrame, leaves: DataFrame, items: int = DIFF_ITEMS) -> DataFrame:
    """Each run against the one before it: runs (id, ended_at), leaves (run_id, path, kind, value) -> id, against, added, removed, changed, lines.

    Counts and the first lines in order; a pair of which one has no snapshot differs in nothing.
    """
    known = leaves.select("run_id").distinct()
    pairs = older_run(runs).where("against IS NOT NULL").withColumnRenamed("id", "run_id")
    both = pairs.join(known, "run_id", "left_semi").join(known.withColumnRenamed("run_id", "against"), "against", "left_semi")
    before = leaves.withColumnRenamed("run_id", "against").join(both, "against").select("run_id", "path", "kind", "value")
    after = leaves.join(both, "run_id", "left_semi").select("run_id", "path", "kind", "value")
    diff = analysis.snapshot_diff(before, after, ("run_id",))
    counts = diff.groupBy("run_id").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")])
    lines = analysis.diff_lines(diff).withColumn("k", F.row_number().over(Window.partitionBy("run_id").orderBy("line"))).where(F.col("k") <= items)
    lines = lines.groupBy("run_id").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    out = pairs.join(counts, "run_id", "left").join(lines, "run_id", "left")
    zero = F.lit(0).cast("bigint")
    return out.select(F.col("run_id").alias("id"), "against", *[F.coalesce(c, zero).alias(c) for c in ("added", "removed", "changed")], F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))


def snapshot_leaves(findings: DataFrame, stats: DataFrame, content_types: DataFrame, genealogy: DataFrame, report: dict[str, str]) -> DataFrame:
    """A run's structured snapshot as path, kind and value, the form that ``snapshot_diff`` reads; write it as Parquet, whatever its size.

    Datasets as lists, statistics, content types and report metadata as scalars, and of each artifact's genealogy seven fields.
    """
    scalar = lambda *path: lambda value: [F.array(*path).alias("path"), F.lit("scalar").alias("kind"), value.cast("string").alias("value")]
    name = F.lit
    parts = [
        findings.select(F.array("dataset").alias("path"), F.lit("item").alias("kind"), "value"),
        stats.select(*scalar(name("stats"), F.col("key"))(F.col("value"))),
        content_types.select(*scalar(name("content_types"), F.col("content_type"))(F.col("n"))),
    ]
    fields = ("content_type", "sha256", "size", "archive_presence", "first_seen", "last_seen", "title")
    text = lambda c: F.initcap(F.col(c).cast("string")) if c == "archive_presence" else F.col(c).cast("string")
    each = genealogy.select("url", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), text(c).alias("value")) for c in fields])).alias("f"))
    parts.append(each.select(*scalar(name("artifact_genealogy"), F.col("url"), F.col("f.field"))(F.col("f.value"))))
    meta = findings.sparkSession.createDataFrame([("snapshot_version", None, "2"), *(("report_metadata", k, v) for k, v in report.items())], "top string, key string, value string")
    parts.append(meta.select(F.array_compact(F.array("top", "key")).alias("path"), F.lit("scalar").alias("kind"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report_sections(findings: DataFrame, probes: DataFrame, shown: int = REPORT_ITEMS) -> DataFrame:
    """(dataset, value) and probes (ord, probe) -> section, ord, value: what a report lists, the first of each section.

    what_broke are failed before skipped URLs, what_looks_fake signals before trust links, worth_probing_next the first twelve probes.
    """
    # Sections and the datasets they show, in order.
    sections = {"what_broke": ("failed", "skipped"), "what_changed": ("temporal_diffs",), "what_looks_fake": ("scam_signals", "trust_links")}
    order = findings.sparkSession.createDataFrame([(s, i, d) for s, ds in sections.items() for i, d in enumerate(ds)], "section string, part int, dataset string")
    rows = findings.join(F.broadcast(order), "dataset")
    place = F.row_number().over(Window.partitionBy("section").orderBy("part", "value"))
    listed = rows.withColumn("ord", place).where(F.col("ord") <= shown).select("section", F.col("ord").cast("bigint").alias("ord"), "value")
    upcoming = probes.where(F.col("ord") <= min(NEXT_PROBES, shown)).select(F.lit("worth_probing_next").alias("section"), F.col("ord").cast("bigint").alias("ord"), F.col("probe").alias("value"))
    return listed.unionByName(upcoming)


def exposure(findings: DataFrame) -> DataFrame:
    """One row of what a site exposes: internal links, forms, documents, interfaces and scripts; documents and interfaces by the anatomy's sections."""
    count = lambda name: F.count_if(F.col("dataset") == name)
    return findings.agg(count("internal").alias("internal_links"), count("forms").alias("forms"), count("docs").alias("documents"), count("apis").alias("apis"), count("scripts").alias("scripts"))


def rendered_pages(pages: DataFrame, rendered: DataFrame) -> DataFrame:
    """Fetched pages (url, html) with the body a renderer made of them where there is one that is not empty: rendered (url, html, final_url, urls)."""
    made = rendered.select("url", F.nullif(F.col("html"), F.lit("")).alias("__html"))
    return pages.join(made, "url", "left").withColumn("html", F.coalesce("__html", "html")).drop("__html")


def rendered_links(rendered: DataFrame) -> DataFrame:
    """(url, target, source_kind) of the addresses that rendering met, in the network and in the page."""
    return rendered.select("url", F.explode(F.array_distinct("urls")).alias("target"), F.lit("rendered-link").alias("source_kind"))


def rendered_evidence(rendered: DataFrame) -> DataFrame:
    """(url, evidence JSON) of rendered pages: the digest of the page, its final address where that is another, the number of addresses met."""
    final = F.when(F.col("final_url") != F.col("url"), F.col("final_url"))
    return rendered.select("url", F.to_json(F.struct(F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("dom_sha256"), final.alias("final_url"), F.size("urls").alias("urls"))).alias("evidence"))


# Headings of a report and what stands where a section is empty.
REPORT_PARTS = (
    ("what_broke", "## What broke", "- None observed"), ("what_changed", "## What changed", "- No temporal changes recorded"),
    ("what_looks_fake", "## What looks fake", "- No strong fake signals recorded"), ("worth_probing_next", "## Worth probing next", "- No next probes suggested"),
)


def report_lines(head: list[str], anatomy: DataFrame, sections: DataFrame, shown: int = REPORT_ITEMS) -> DataFrame:
    """(part, ord, line) of a Markdown report: ``head`` as it is, the anatomy (section, value) by section, then ``report_sections``; the first items of each.

    A row per line, to be sorted by part and ord; at most ``shown`` items a section, whatever the tables' size.
    """
    spark = anatomy.sparkSession
    titled = [(s, f"### {s.replace('_', ' ').title()}", "- None observed") for s in analysis.SECTIONS]
    parts = spark.createDataFrame([(k + 1, *row) for k, row in enumerate([*titled, *REPORT_PARTS])], "part int, section string, heading string, none string")
    place = F.row_number().over(Window.partitionBy("section").orderBy("value")).cast("bigint")
    items = anatomy.select("section", "value").withColumn("ord", place).where(F.col("ord") <= shown).unionByName(sections.where(F.col("ord") <= shown).select("section", "value", "ord"))
    listed = F.broadcast(parts).join(items, "section", "left").select("part", F.coalesce("ord", F.lit(1).cast("bigint")).alias("ord"), F.coalesce(F.concat(F.lit("- "), "value"), F.col("none")).alias("line"))
    headings = parts.select("part", F.lit(0).cast("bigint").alias("ord"), F.col("heading").alias("line"))
    gaps = parts.select("part", F.lit(shown + 1).cast("bigint").alias("ord"), F.lit("").alias("line"))
    first = spark.createDataFrame([(0, k, line) for k, line in enumerate([*head, "## Site anatomy"])], "part int, ord bigint, line string")
    return first.unionByName(headings).unionByName(listed).unionByName(gaps).orderBy("part", "ord")
