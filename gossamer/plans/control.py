"""Control plane: modes, workflows, presets and the settings of a run, with their resolution."""

from __future__ import annotations

import platform
import re
from dataclasses import asdict, dataclass, fields, replace
from importlib import metadata
from pathlib import Path

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Names, labels and defaults, as saved runs and their readers know them.
MODES = {
    "generic": "Generic crawler", "document": "Document harvester", "js-intel": "JS intelligence crawler", "forum": "Forum/thread deep crawler", "geo": "Geo-intelligence crawler",
    "news": "News propagation tracker", "hidden": "Hidden directory hybrid", "scam": "Dark pattern / scam detector", "temporal": "Temporal change crawler",
}
#: workflow: label, mode, settings it turns on or off.
WORKFLOWS: dict[str, tuple[str, str, dict[str, bool]]] = {
    "domain_necropsy": ("Domain necropsy", "generic", {"archive_seeds": True, "respect_robots_delay": True}),
    "dead_page_resurrection": ("Dead page resurrection", "temporal", {"archive_seeds": True, "respect_robots_delay": True}),
    "js_bone_saw": ("JS bone saw", "js-intel", {"extract_secrets": True, "render_js": False}),
    "pdf_fossil_dig": ("PDF fossil dig", "document", {"archive_seeds": True, "render_js": False}),
    "scam_smell_test": ("Scam smell test", "scam", {"render_js": True}),
    "forum_bloodline": ("Forum bloodline", "forum", {"render_js": True}),
    "news_mutation_trace": ("News mutation trace", "news", {"archive_seeds": True, "render_js": True}),
}
KIND_WORKFLOW = {
    "domain": "domain_necropsy", "url": "domain_necropsy", "sitemap": "domain_necropsy", "html": "domain_necropsy", "dead_url": "dead_page_resurrection",
    "archived_url": "dead_page_resurrection", "pdf": "pdf_fossil_dig", "js": "js_bone_saw", "company": "scam_smell_test", "handle": "scam_smell_test",
}
PRESETS: dict[str, dict[str, object]] = {
    "balanced": {"depth": 2, "threads": 4, "delay": 0.0, "timeout": 8.0},
    "quick": {"depth": 1, "threads": 6, "delay": 0.0, "timeout": 6.0},
    "polite": {"depth": 2, "threads": 2, "delay": 0.75, "timeout": 10.0},
    "document-heavy": {"depth": 2, "threads": 3, "delay": 0.25, "timeout": 10.0, "archive_seeds": True},
    "javascript-heavy": {"depth": 2, "threads": 4, "delay": 0.15, "timeout": 10.0, "render_js": True, "extract_secrets": True},
}
DATASETS = (
    "files", "intel", "robots", "custom", "failed", "internal", "scripts", "external", "fuzzable", "endpoints", "keys", "forms", "redirects", "skipped",
    "document_metadata", "document_leaks", "js_intel", "threads", "locations", "stories", "hidden_paths", "hidden_probe_sources", "scam_signals", "temporal_diffs",
    "site_anatomy", "mutation_probes", "artifact_genealogy",
)
LOCAL_SUFFIXES = (".js", ".mjs", ".cjs", ".pdf", ".html", ".htm")


def known_or(value: str | None, table: dict, default: str) -> str:
    return value if value in table else default


@dataclass(frozen=True)
class RunSettings:
    """Settings of a run; ``from_mapping`` coerces and bounds them."""

    depth: int = 2
    threads: int = 4
    delay: float = 0.0
    timeout: float = 8.0
    scope: str = "host"
    extract_intel: bool = True
    extract_secrets: bool = False
    archive_seeds: bool = False
    render_js: bool = False
    respect_robots_delay: bool = False
    enumerate_subdomains: bool = False
    preset: str = "balanced"
    mode: str = "generic"
    workflow: str = "domain_necropsy"
    hidden_words: tuple[str, ...] = ()
    scope_allow: tuple[str, ...] = ()
    scope_deny: tuple[str, ...] = ()

    @classmethod
    def from_mapping(cls, raw: dict[str, object]) -> RunSettings:
        """Zero and empty values read as the default; depth and threads are 1 at least, delay 0, timeout 1."""
        got = {}
        for f in fields(cls):
            value = raw.get(f.name, f.default)
            got[f.name] = type(f.default)(f.default if value in (None, "", 0) and not isinstance(f.default, (bool, tuple)) else value)
        words = raw.get("hidden_words") or ()
        words = re.split(r"[\s,]+", words) if isinstance(words, str) else words
        got |= {"hidden_words": tuple(dict.fromkeys(w.lower() for w in words if w)), "scope": "domain" if got["scope"] == "domain" else "host"}
        got |= {"depth": max(1, got["depth"]), "threads": max(1, got["threads"]), "delay": max(0.0, got["delay"]), "timeout": max(1.0, got["timeout"])}
        got |= {"mode": known_or(got["mode"], MODES, "generic"), "preset": known_or(got["preset"], PRESETS, "balanced"), "workflow": known_or(got["workflow"], WORKFLOWS, "domain_necropsy")}
        return cls(**got)


def resolve(kind: str, explicit: dict[str, object], workflow: str | None = None, preset: str | None = None) -> RunSettings:
    """Settings for an input kind: explicit ones, else the preset's, else the workflow's, else the defaults."""
    chosen = known_or(workflow, WORKFLOWS, KIND_WORKFLOW.get(kind, "domain_necropsy"))
    _, mode, on = WORKFLOWS[chosen]
    preset = known_or(preset, PRESETS, "balanced")
    return RunSettings.from_mapping({"mode": mode} | on | PRESETS[preset] | explicit | {"workflow": chosen, "preset": preset})


def web_bounds(settings: RunSettings) -> RunSettings:
    """The bounds of runs that are started over the web."""
    return replace(settings, depth=min(settings.depth, 8), threads=min(settings.threads, 32))


def pattern_problems(spark: SparkSession, patterns: dict[str, list[str]]) -> dict[str, list[str]]:
    """Of the named lists of a user's patterns, those that do not compile with what is wrong, before a run starts: asked of Java, which runs them."""
    problems: dict[str, list[str]] = {}
    for name, some in patterns.items():
        for p in some:
            try:
                spark._jvm.java.util.regex.Pattern.compile(p)
            except IllegalArgumentException as error:
                problems.setdefault(name, []).append(f"{p}: {str(error).splitlines()[0]}")
    return problems


def safe_local_path(raw: str, roots: tuple[str, ...]) -> str:
    """The resolved path of a specimen file, '' unless it is a plain file of a known suffix under one of the roots."""
    if not re.fullmatch(r"(?:/|[A-Za-z]:[\\/])[A-Za-z0-9._/\-\\ ]{1,4096}", (raw or "").strip()):
        return ""
    path = Path(raw.strip())
    if path.suffix.lower() not in LOCAL_SUFFIXES or not path.is_file():
        return ""
    real = path.resolve()
    return str(real) if any(real.is_relative_to(Path(r).resolve()) for r in roots) else ""


def modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODES.items()), "mode string, label string")


def workflows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, label, mode, d) for k, (label, mode, d) in WORKFLOWS.items()], "workflow string, label string, mode string, defaults map<string, boolean>")


def workflow_plan(inputs: DataFrame) -> DataFrame:
    """(kind, ...) plus workflow and mode: a broadcast join with two fixed tables."""
    spark = inputs.sparkSession
    by_kind = spark.createDataFrame(list(KIND_WORKFLOW.items()), "kind string, workflow string")
    named = inputs.join(F.broadcast(by_kind), "kind", "left").withColumn("workflow", F.coalesce("workflow", F.lit("domain_necropsy")))
    return named.join(F.broadcast(workflows(spark).select("workflow", "mode")), "workflow")


def log_lines(lines: DataFrame) -> DataFrame:
    """(line) without terminal colours, with its channels."""
    clean = T.strip_ansi(F.col("line"))
    return lines.select(clean.alias("line"), T.log_channels(clean).alias("channels")).where("line != ''")


def run_metadata(run_id: str, settings: RunSettings, command: list[str], saved_at: str, baseline: str = "", output_dir: str = "") -> dict[str, object]:
    """What a report and a manifest say of the run itself: its settings, those that are switched on, its command and the software it ran on."""
    config = asdict(settings)
    versions = {}
    for name in ("pyspark", "pandas", "pyarrow", "numpy"):
        try:
            versions[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            versions[name] = "missing"
    return {
        "run_id": run_id, "saved_at": saved_at, "command": list(command), "command_line": " ".join(command), "preset": settings.preset, "mode": settings.mode, "workflow": settings.workflow,
        "baseline_source": baseline, "output_dir": output_dir, "flags": {k: v for k, v in config.items() if isinstance(v, bool)}, "config": config,
        "runtime": {"python_version": platform.python_version(), "platform": platform.platform(), "dependency_versions": versions},
    }


def report_head(target: dict[str, str], counts: dict[str, int], seconds: float, run: dict[str, object]) -> list[str]:
    """The first lines of a Markdown report: the target, the run's counts and its metadata."""
    said = lambda *rows: [f"- {label}: `{value or '-'}`" for label, value in rows]
    return [
        "# Autopsy", "", "## What the target is", *said(("Kind", target.get("kind")), ("Source", target.get("source")), ("Workflow", run["workflow"]), ("Mode", run["mode"]), ("Preset", run["preset"])), "",
        "## Run summary", f"- Pages crawled: {counts.get('visited', 0)}", f"- Skipped: {counts.get('skipped', 0)}", f"- Failed: {counts.get('failures', 0)}", f"- Duration (s): {seconds:.2f}", "",
        "## Run metadata", *said(("Run", run["run_id"]), ("Saved at", run["saved_at"]), ("Command", run["command_line"]), ("Baseline", run["baseline_source"]), ("Python", run["runtime"]["python_version"])), "",
    ]
