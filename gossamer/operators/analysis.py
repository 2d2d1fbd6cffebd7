"""Derived analytics: site anatomy, probes, hidden paths, genealogy, snapshot diffs, input classification."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions import patterns as P
from ..functions import text as T
from ..functions import urls as U
from .crawl import scratch_folder

# Variants that probes try.
FORM_PROBES = (("/admin", "form-neighbor"), ("/dashboard", "form-neighbor"), ("/api/login", "form-auth-api"), ("/old-login", "form-legacy-auth"), ("/signin", "form-auth-alias"), ("/auth/callback", "form-auth-callback"))
AUTH_PROBES = (("/admin", "auth-neighbor"), ("/dashboard", "auth-neighbor"), ("/api/login", "auth-api-neighbor"), ("/old-login", "auth-legacy-neighbor"), ("/signin", "auth-alias"), ("/auth/callback", "auth-callback"))
ADMIN_PROBES = ("/login", "/admin/login", "/dashboard", "/api/admin")
DOCUMENT_AFFIXES = ("draft", "backup", "old", "final", "en", "fr")
MAX_PROBES, MAX_HIDDEN, HIDDEN_SOURCES = 64, 48, 4
SECTIONS = ("auth_surfaces", "docs", "apis", "forms", "static_assets", "admin_ish_routes", "old_paths", "analytics", "cdn_assets", "external_refs", "archive_only_paths", "trust_links", "dead_ends")


def _ends(path: Column, suffixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | path.endswith(s)
    return out


def site_anatomy(entries: DataFrame, main_url: str) -> DataFrame:
    """(dataset, value) -> (section, value), distinct.

    Datasets: internal, external, files, endpoints, forms, failed, scripts, skipped, archived. Each entry is
    classified on its own, so one pass with an explode is enough; only "not found alive" needs a join.
    """
    is_ = lambda *names: F.col("dataset").isin(*names)
    value, path = F.col("value"), F.lower(U.path_of(F.col("value")))
    like = lambda k: value.rlike(P.ANATOMY[k])
    ext = is_("external")
    known = like("analytics") | like("cdn") | like("trust")
    action = F.regexp_extract(value, r"action=([^\s]+)", 1)
    main_net = F.lit(main_url)
    section = lambda name, cond, v=value: F.when(cond, F.struct(F.lit(name).alias("section"), v.alias("value")))
    found = F.array_compact(F.array(
        section("auth_surfaces", is_("internal") & like("auth")), section("auth_surfaces", is_("forms") & (action != ""), action),
        section("auth_surfaces", is_("forms") & F.lower(value).rlike("password|email|token|login|auth")),
        section("docs", is_("files") & _ends(path, P.ANATOMY_DOC_EXTENSIONS)), section("apis", (is_("internal") & like("api")) | is_("endpoints")),
        section("forms", is_("forms")), section("static_assets", (is_("files") & _ends(path, P.ANATOMY_STATIC_EXTENSIONS)) | is_("scripts")),
        section("admin_ish_routes", is_("internal", "failed") & like("admin")), section("old_paths", is_("internal", "failed", "files") & like("old")),
        section("analytics", ext & like("analytics")), section("cdn_assets", ext & like("cdn")),
        section("external_refs", ext & (U.authority(value) != "") & (U.authority(value) != U.authority(main_net)) & ~known),
        section("trust_links", ext & like("trust")), section("dead_ends", is_("failed", "skipped")),
    ))
    some = entries.where("value != ''").select(F.explode(found).alias("s")).select("s.section", "s.value")
    alive = entries.where(is_("internal", "files")).select("value")
    archived = entries.where(is_("archived")).join(alive, "value", "left_anti").select(F.lit("archive_only_paths").alias("section"), "value")
    return some.unionByName(archived).distinct()


def anatomy_lines(anatomy: DataFrame) -> DataFrame:
    return anatomy.select(F.concat(F.lit("section="), "section", F.lit(" value="), "value").alias("line"))


def _document_variants(root: str, path: Column) -> Column:
    """Addresses a document may also be at: earlier years, affixes before and after its name."""
    name = F.substring_index(path, "/", -1)
    folder = F.regexp_replace(F.regexp_replace(path, r"/[^/]*$", ""), "^/+|/+$", "")
    dotted = name.contains(".")
    suffix = F.when(dotted, F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise(F.lit(""))
    stem = F.when(dotted, F.substring(name, F.lit(1), F.length(name) - F.length(suffix))).otherwise(name)
    year = F.regexp_extract(stem, r"(20\d{2})", 1)
    number = F.coalesce(year.try_cast("int"), F.lit(2000))
    older = F.when((year != "") & (number > 2000), F.transform(F.sequence(F.greatest(number - 2, F.lit(2000)), F.greatest(number - 1, F.lit(2000))), lambda y: F.concat(F.replace(stem, year, y.cast("string")), suffix))).otherwise(F.array().cast("array<string>"))
    affixed = F.flatten(F.array(*[F.array(F.concat(stem, F.lit(f"-{a}"), suffix), F.concat(F.lit(f"{a}-"), stem, suffix)) for a in DOCUMENT_AFFIXES]))
    prefix = F.when(folder == "", F.lit(root)).otherwise(F.concat(F.lit(root + "/"), folder))
    return F.transform(F.concat(older, affixed), lambda c: F.concat(prefix, F.lit("/"), c))


def mutation_probes(entries: DataFrame, main_url: str, limit: int = MAX_PROBES) -> DataFrame:
    """(dataset, ord, value) -> ord, probe, source, reason: smart guesses from found paths, the first ``limit`` by order of their sources.

    Sources are internal, then files, then endpoints that are paths, each in its ``ord``. A probe keeps the first
    source that suggests it.
    """
    root = "/".join(main_url.split("/")[:3])
    rank = F.when(F.col("dataset") == "internal", 1).when(F.col("dataset") == "files", 2).otherwise(3)
    rows = entries.where(F.col("dataset").isin("internal", "files") | ((F.col("dataset") == "endpoints") & F.col("value").startswith("/")))
    source = F.when(F.col("dataset") == "endpoints", F.concat(F.lit(root), "value")).otherwise(F.col("value"))
    rows = rows.select(source.alias("source"), F.struct(rank.alias("d"), F.col("ord").cast("bigint").alias("o")).alias("at")).groupBy("source").agg(F.min("at").alias("at"))
    path = F.when(U.path_of(F.col("source")) == "", F.lit("/")).otherwise(U.path_of(F.col("source")))
    row = lambda probe, reason: F.struct(probe.alias("probe"), F.lit(reason).alias("reason"))
    none = F.array().cast("array<struct<probe:string,reason:string>>")
    guesses = F.concat(
        F.when(path.rlike(P.ANATOMY["auth"]), F.array(*[row(F.lit(root + v), r) for v, r in AUTH_PROBES])).otherwise(none),
        F.when(_ends(F.lower(path), P.ANATOMY_DOC_EXTENSIONS), F.transform(_document_variants(root, path), lambda p: row(p, "document-mutation"))).otherwise(none),
        F.when(path.rlike(P.ANATOMY["admin"]), F.array(*[row(F.lit(root + v), "admin-neighbor") for v in ADMIN_PROBES])).otherwise(none),
    )
    each = rows.select("source", "at", F.posexplode(guesses).alias("k", "g")).select("g.probe", F.struct("at.d", "at.o", "k").alias("at"), "source", "g.reason")
    spark = entries.sparkSession
    from_forms = spark.createDataFrame([(root + v, k, root, r) for k, (v, r) in enumerate(FORM_PROBES)], "probe string, k int, source string, reason string")
    has_forms = entries.where("dataset = 'forms'").select(F.lit(1).alias("one")).limit(1)
    from_forms = from_forms.crossJoin(F.broadcast(has_forms)).select("probe", F.struct(F.lit(0).alias("d"), F.lit(0).cast("bigint").alias("o"), "k").alias("at"), "source", "reason")
    first = from_forms.unionByName(each).groupBy("probe").agg(F.min(F.struct("at", "source", "reason")).alias("m"))
    best = first.select("probe", "m.at", "m.source", "m.reason").orderBy("at", "probe").limit(limit)
    return best.select(F.row_number().over(Window.orderBy("at", "probe")).alias("ord"), "probe", "source", "reason")


def probe_lines(probes: DataFrame) -> DataFrame:
    return probes.select(F.concat(F.lit("probe="), "probe", F.lit(" source="), "source", F.lit(" reason="), "reason").alias("line"))


def hidden_candidates(found: DataFrame, main_url: str, user_words: tuple[str, ...] = (), limit: int = MAX_HIDDEN) -> DataFrame:
    """(kind, value) with kind internal, script or endpoint -> ord, probe, token, strategy, source.

    Tokens are path segments and words; the user's first, then learned ones, then the default list, by
    name. Each gives a probe without and with a closing slash, ``limit`` in all.
    """
    root = "/".join(main_url.split("/")[:3]) + "/"
    path = F.when(F.col("kind") == "endpoint", F.col("value")).otherwise(U.path_of(F.col("value")))
    learned = found.select(F.explode(F.transform(F.split(path, "/"), T.hidden_token)).alias("token"), F.concat_ws(":", F.lit("learned"), "kind", "value").alias("source")).where("token != ''").distinct()
    words = found.sparkSession.createDataFrame([(w, "wordlist:default") for w in P.HIDDEN_WORDS] + [(w.strip().strip(".").lower(), "wordlist:user") for w in user_words], "token string, source string")
    words = words.where((F.col("source") == "wordlist:default") | (T.hidden_token(F.col("token")) != ""))
    all_ = learned.unionByName(words).distinct()
    # Only the first sources are shown: a top-k per token before they are gathered.
    ranked = all_.withColumn("k", F.row_number().over(Window.partitionBy("token").orderBy("source")))
    tokens = ranked.groupBy("token").agg(
        F.max(F.col("source").startswith("learned:")).alias("is_learned"), F.max(F.col("source") == "wordlist:user").alias("is_user"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= HIDDEN_SOURCES, F.col("source")))), "|").alias("source"),
    )
    class_ = F.when(F.col("is_user"), 0).when(F.col("is_learned"), 1).otherwise(2)
    top = tokens.withColumn("class", class_).orderBy("class", "token").limit((limit + 1) // 2)
    probes = top.select("class", "token", F.when(F.col("is_learned"), F.lit("learned")).otherwise(F.lit("wordlist")).alias("strategy"), "source", F.posexplode(F.array(F.lit(""), F.lit("/"))).alias("k", "end"))
    place = F.row_number().over(Window.orderBy("class", "token", "k"))
    return probes.select(place.alias("ord"), F.concat(F.lit(root), "token", "end").alias("probe"), "token", "strategy", "source").where(F.col("ord") <= limit)


def untried_probes(probes: DataFrame, known: DataFrame, host: str) -> DataFrame:
    """Probes in scope whose canonical form is not known yet, once each."""
    canonical = probes.withColumn("url", U.normalize_url(F.col("probe"))).where(U.in_scope(F.col("url"), F.lit(host)))
    first = canonical.groupBy("url").agg(F.min_by(F.struct("probe", "token", "strategy", "source"), "ord").alias("m"))
    return first.join(known.select("url"), "url", "left_anti").select("url", "m.*")


# --- genealogy ------------------------------------------------------------------------------


#: Of an artifact's observations, the fields of which the last that is not empty counts, and those that are gathered.
LATEST, GATHERED = ("content_type", "title", "sha256", "size", "archive_presence", "last_seen"), ("found_on", "source_kinds", "notes", "metadata", "redirects")


def genealogy_state(discoveries: DataFrame, observations: DataFrame) -> DataFrame:
    """What is known of each artifact, in a form that merges: of scalars the value with its seq, of gathered ones the set.

    discoveries: url, found_on, source_kind, note. observations: seq, url, content_type, title, metadata, body, archive_presence, redirect, label.
    Save it (runlog) and merge what comes later into it, so that history is not read again.
    """
    some = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    at = lambda value, pick: pick(F.when(value.isNotNull(), F.struct(F.col("seq").alias("seq"), value.alias("value"))))
    found = discoveries.where(some("url").isNotNull()).groupBy("url").agg(*[F.collect_set(some(c)).alias(name) for c, name in (("found_on", "found_on"), ("source_kind", "source_kinds"), ("note", "notes"))])
    hashed = observations.withColumns({"sha256": F.when(F.col("body").isNotNull(), F.sha2("body", 256)), "size": F.when(F.col("body").isNotNull(), F.length("body").cast("bigint"))})
    seen = hashed.groupBy("url").agg(
        *[at(some(c), F.max).alias(c) for c in ("content_type", "title", "sha256")], at(F.col("size"), F.max).alias("size"), at(F.col("archive_presence"), F.max).alias("archive_presence"),
        at(some("label"), F.min).alias("first_seen"), at(some("label"), F.max).alias("last_seen"), F.collect_set(some("metadata")).alias("metadata"), F.collect_set(some("redirect")).alias("redirects"),
    )
    return found.join(seen, "url", "full_outer").select("url", *GATHERED, *LATEST, "first_seen")


def merge_genealogy(*states: DataFrame) -> DataFrame:
    """One state of several, in any order: the same as that of all their observations together."""
    every = states[0]
    for state in states[1:]:
        every = every.unionByName(state)
    gathered = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in GATHERED]
    return every.groupBy("url").agg(*gathered, *[F.max(c).alias(c) for c in LATEST], F.min("first_seen").alias("first_seen"))


def genealogy_rows(state: DataFrame) -> DataFrame:
    """One row per artifact: sets as sorted arrays, scalars as told, and the number of other artifacts with the same hash."""
    empty = F.array().cast("array<string>")
    text = lambda c: F.coalesce(F.col(f"{c}.value"), F.lit("")).alias(c)
    rows = state.select(
        "url", *[F.array_sort(F.coalesce(c, empty)).alias(c) for c in GATHERED], *[text(c) for c in ("content_type", "title", "sha256", "first_seen", "last_seen")],
        F.coalesce("size.value", F.lit(0).cast("bigint")).alias("size"), F.coalesce("archive_presence.value", F.lit(False)).alias("archive_presence"),
    )
    same = rows.where("sha256 != ''").groupBy("sha256").agg(F.count("*").alias("copies"))
    return rows.join(same, "sha256", "left").withColumn("n_duplicates", F.coalesce(F.col("copies") - 1, F.lit(0))).drop("copies")


def genealogy(discoveries: DataFrame, observations: DataFrame) -> DataFrame:
    """genealogy_rows of all discoveries and observations at once."""
    return genealogy_rows(genealogy_state(discoveries, observations))


def content_duplicates(items: DataFrame, key: str, content: str) -> DataFrame:
    """(sha256, n, first): contents that several items share, with their smallest key; aggregated before the shuffle."""
    hashed = items.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("sha256")).where("sha256 IS NOT NULL")
    return hashed.groupBy("sha256").agg(F.count("*").alias("n"), F.min(key).alias("first_id")).where("n > 1")


def duplicate_members(items: DataFrame, key: str, content: str) -> DataFrame:
    """(key, sha256, n_duplicates) of the items whose content others share."""
    groups = content_duplicates(items, key, content)
    hashed = items.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))
    return hashed.join(groups, "sha256").select(key, "sha256", (F.col("n") - 1).alias("n_duplicates"))


def genealogy_lines(rows: DataFrame) -> DataFrame:
    dash = lambda c: F.when(c == "", F.lit("-")).otherwise(c)
    parts = {
        "url": F.col("url"), "content_type": dash(F.col("content_type")), "size": F.col("size").cast("string"), "sha256": dash(F.substring("sha256", 1, 16)), "title": dash(F.col("title")),
        "found_on": dash(F.array_join(F.slice("found_on", 1, 3), ",")), "duplicates": F.col("n_duplicates").cast("string"), "archive": F.col("archive_presence").cast("string"), "first_seen": dash(F.col("first_seen")), "last_seen": dash(F.col("last_seen")),
    }
    return rows.select(F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), v) for k, v in parts.items()]).alias("line"))


# --- snapshot diffs -------------------------------------------------------------------------


def _leaves(doc: str | None) -> list[tuple[list[str], str, str]]:
    """Path, kind and value of each node of a snapshot, to any depth; a list's items are its values as texts, nulls left out."""
    try:
        todo = [([], json.loads(doc or "null"))]
    except (ValueError, RecursionError):
        return []
    out = []
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict):
            out.append((path, "map", ""))
            todo += [([*path, str(k)], v) for k, v in value.items()]
        elif isinstance(value, list):
            out.append((path, "list", ""))
            out += [(path, "item", str(x)) for x in value if x is not None]
        elif value is not None and path:
            out.append((path, "scalar", str(value)))
    return out


def flatten_snapshot(docs: DataFrame) -> DataFrame:
    """(..., doc JSON text) -> path array<string>, kind (map, list, item or scalar), value, and the other columns of docs.

    Null scalars are as good as absent. A text that is no JSON gives no rows. One Arrow pass, a document at a time.
    """
    rest = [c for c in docs.columns if c != "doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *leaf) for i, doc in enumerate(batch.column(len(rest)).to_pylist()) for leaf in _leaves(doc)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            kept = [batch.column(k).take(pa.array(columns[0], pa.int64())) for k in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(columns[1], pa.list_(pa.string())), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], [*rest, "path", "kind", "value"])

    schema = docs.select(*rest).schema if rest else StructType()
    return docs.select(*rest, "doc").mapInArrow(run, schema.add("path", ArrayType(StringType())).add("kind", "string").add("value", "string"))


@pandas_udf(StringType())
def _as_text(values: pd.Series) -> pd.Series:
    """The text of a JSON value as it is shown: True for true, {'b': 2} for {"b": 2}."""
    return values.map(lambda v: None if v is None else str(json.loads(v)))


def flatten_by_level(docs: DataFrame) -> DataFrame:
    """The rows of flatten_snapshot, a level of the documents at a time, for documents whose nodes are too many for one task.

    Objects in lists are shown with their keys in order of name, others as they are.
    Each level is exploded in the JVM (``variant_explode``), its objects and lists are written to the shared folder and make the next; only the
    values of lists and scalars that are no strings go to Python, one by one, to be shown.
    """
    spark, rest, folder = docs.sparkSession, [c for c in docs.columns if c != "doc"], scratch_folder(docs.sparkSession)
    kind = F.when(F.schema_of_variant("v").startswith("OBJECT"), "map").when(F.schema_of_variant("v").startswith("ARRAY"), "list").when(F.schema_of_variant("v").isin("VOID", "NULL"), "null").otherwise("scalar")
    text = F.when(F.schema_of_variant("v") == "STRING", F.expr("variant_get(v, '$', 'string')")).otherwise(_as_text(F.when(F.schema_of_variant("v") != "STRING", F.to_json("v"))))
    rows, level, parts = docs.select(*rest, F.array().cast("array<string>").alias("path"), F.try_parse_json("doc").alias("v")).where("v IS NOT NULL"), 0, []
    while True:
        rows.withColumn("kind", kind).write.parquet(f"{folder}/level={level}")
        nodes = spark.read.parquet(f"{folder}/level={level}")
        told = nodes.where(F.col("kind").isin("map", "list")).select(*rest, "path", "kind", F.lit("").alias("value"))
        parts += [told, nodes.where((F.col("kind") == "scalar") & (F.size("path") > 0)).select(*rest, "path", "kind", text.alias("value"))]
        name = f"gossamer_nodes_{uuid.uuid4().hex}"
        nodes.where(F.col("kind").isin("map", "list")).createOrReplaceTempView(name)
        # (pos, key, value) of objects and lists; pos and key are no words that the other columns use.
        listed = ", ".join(f"n.`{c}`" for c in [*rest, "path", "kind"])
        below = spark.sql(f"SELECT {listed}, e.key AS __key, e.value AS v FROM {name} n, LATERAL variant_explode(n.v) e")
        parts.append(below.where("kind = 'list'").withColumn("kind", kind).where("kind != 'null'").select(*rest, "path", F.lit("item").alias("kind"), text.alias("value")))
        rows, level = below.where("kind = 'map'").select(*rest, F.concat("path", F.array("__key")).alias("path"), "v"), level + 1
        if rows.isEmpty():
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: The files that a run's snapshot may be read from, and what of the report's summary and manifest belongs to it.
BASELINE_FILE, MANIFEST_FILE, REPORT_FILE = "temporal-baseline.json", "crawl-manifest.json", "autopsy.json"


def load_snapshot(spark: SparkSession, folder: str, datasets: tuple[str, ...]) -> DataFrame:
    """path, kind, value of an earlier run's snapshot, from whatever its folder holds; no rows where that is nothing.

    Four sources, of which the first that tells a part is believed: the structured baseline, text files of the ``datasets`` and of ``stats``, the
    manifest (artifact hashes), the report (genealogy, content types). Files may be folders of parts, as Spark writes them.
    """
    jvm = spark._jvm.org.apache.hadoop.fs
    files = jvm.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda name: files.exists(jvm.Path(f"{folder}/{name}"))
    node = lambda df, path, kind, value: df.select(path.alias("path"), F.lit(kind).alias("kind"), value.alias("value"))

    def document(name: str) -> DataFrame:
        return flatten_snapshot(spark.read.text(f"{folder}/{name}", wholetext=True).select(F.col("value").alias("doc"))).where(F.size("path") > 0)

    def below(df: DataFrame, *under: str, named: str) -> DataFrame:
        """What a document has under a path, told as the part ``named``."""
        inside = F.slice("path", 1, len(under)) == F.array(*[F.lit(u) for u in under])
        rest = F.slice(F.col("path"), F.lit(len(under) + 1), F.greatest(F.size("path"), F.lit(1)))
        return df.where(inside).select(F.concat(F.array(F.lit(named)), rest).alias("path"), "kind", "value")

    sources = []
    if there(BASELINE_FILE):
        sources.append(document(BASELINE_FILE))
    texts = []
    for name in datasets:
        if there(f"{name}.txt"):
            lines = spark.read.text(f"{folder}/{name}.txt").where(F.trim("value") != "")
            texts += [node(lines, F.array(F.lit(name)), "item", F.col("value")), node(spark.range(1), F.array(F.lit(name)), "list", F.lit(""))]
    if there("stats.txt"):
        lines = spark.read.text(f"{folder}/stats.txt").where("value LIKE '_%=%'").select(F.substring_index("value", "=", 1).alias("key"), F.expr("substring(value, instr(value, '=') + 1)").alias("v"))
        texts += [node(lines.where("key != ''"), F.array(F.lit("stats"), F.col("key")), "scalar", F.col("v")), node(spark.range(1), F.array(F.lit("stats")), "map", F.lit(""))]
    if texts:
        sources.append(reduce(DataFrame.unionByName, texts))
    if there(MANIFEST_FILE):
        sources.append(below(document(MANIFEST_FILE), "artifacts", named="artifact_hashes"))
    if there(REPORT_FILE):
        report = document(REPORT_FILE)
        sources.append(below(report, "artifact_genealogy", named="artifact_genealogy").unionByName(below(report, "run_summary", "content_types", named="content_types")))
    out, told = spark.createDataFrame([], "path array<string>, kind string, value string"), None
    for source in sources:
        part = source.withColumn("__part", F.col("path")[0])
        fresh = part if told is None else part.join(F.broadcast(told), "__part", "left_anti")  # the parts of a snapshot are a few dozen
        out = out.unionByName(fresh.select("path", "kind", "value"))
        names = part.select("__part").distinct()
        told = names if told is None else told.union(names).distinct()
    return out


def snapshot_diff(previous: DataFrame, current: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(path, kind, value) on both sides -> path, change (added, removed or changed), value, before, after; each within equal ``by``.

    List items compare as sets, scalars by path: one full outer join. Where one side has a map and the other has not, only
    what is below it differs; where one side has a list and the other a scalar, only the items do.
    """
    on = [*by, "path"]
    key = lambda df, side: df.where(F.col("kind").isin("item", "scalar")).select(*on, "kind", F.when(F.col("kind") == "item", F.col("value")).otherwise(F.lit("")).alias("item"), F.col("value").alias(side)).distinct()
    nodes = previous.select(*on, "kind").unionByName(current.select(*on, "kind")).where(F.col("kind").isin("map", "list"))
    nodes = nodes.groupBy(*on).agg(F.max(F.col("kind") == "map").alias("is_map"), F.max(F.col("kind") == "list").alias("is_list"))
    joined = key(previous, "before").join(key(current, "after"), [*on, "kind", "item"], "full_outer").join(nodes, on, "left")
    item = F.col("kind") == "item"
    told = ~F.coalesce(F.col("is_map"), F.lit(False)) & (item | ~F.coalesce(F.col("is_list"), F.lit(False)))
    change = F.when(item & F.col("before").isNull(), F.lit("added")).when(item & F.col("after").isNull(), F.lit("removed")).when(~item & ~F.col("before").eqNullSafe(F.col("after")), F.lit("changed"))
    out = joined.where(told).withColumn("change", change).where("change IS NOT NULL")
    return out.select(*on, "change", F.when(F.col("kind") == "item", F.col("item")).alias("value"), F.when(F.col("kind") == "scalar", F.coalesce("before", F.lit("None"))).alias("before"), F.when(F.col("kind") == "scalar", F.coalesce("after", F.lit("None"))).alias("after"))


def diff_lines(diff: DataFrame) -> DataFrame:
    deep, n = F.array_join(F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(1))), " / "), F.size("path")
    head = F.concat(F.lit("dataset="), F.element_at("path", 1))
    listed = F.concat(head, F.when(n > 1, F.concat(F.lit(" item="), deep)).otherwise(F.lit("")), F.lit(" change="), "change", F.lit(" value="), "value")
    name = F.when(n == 1, F.lit(" metric=value")).when(n == 2, F.concat(F.lit(" metric="), F.element_at("path", -1))).otherwise(F.concat(F.lit(" item="), F.array_join(F.slice("path", F.lit(2), F.greatest(n - 2, F.lit(1))), " / "), F.lit(" field="), F.element_at("path", -1)))
    scalar = F.concat(head, name, F.lit(" before="), "before", F.lit(" after="), "after")
    return diff.select(*[c for c in diff.columns if c not in ("path", "change", "value", "before", "after")], F.when(F.col("change") == "changed", scalar).otherwise(listed).alias("line"))


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count("*").alias("n"))


# --- inputs of a crawl ----------------------------------------------------------------------


def classify_inputs(inputs: DataFrame) -> DataFrame:
    """(raw, explicit) -> raw, kind, confidence. The first rule that holds decides."""
    raw, low = F.trim("raw"), F.lower(F.trim("raw"))
    explicit = F.coalesce("explicit", F.lit(""))
    local = raw.rlike(r"^(?:/|[A-Za-z]:[\\/])") & low.rlike(r"\.(?:js|mjs|cjs|pdf|html|htm)$")
    web = low.rlike("^https?://")
    kind = (
        F.when((explicit != "") & (explicit != "auto"), explicit)
        .when(local & low.endswith(".js"), "js").when(local & low.endswith(".pdf"), "pdf").when(local & low.rlike(r"\.html?$"), "html")
        .when(raw.rlike(P.HTML_SIGN), "html").when(web & U.hostname(raw).isin(*P.ARCHIVE_HOSTS), "archived_url")
        .when(web & (low.contains("dead") | low.contains("404")), "dead_url").when(web & (low.endswith(".xml") | low.contains("sitemap")), "sitemap")
        .when(web & low.endswith(".pdf"), "pdf").when(web & low.rlike(r"\.(?:js|mjs|cjs)$"), "js").when(web, "url")
        .when(raw.rlike(P.DOMAIN), "domain").when(raw.rlike(P.HANDLE) & raw.rlike("^@|[._-]"), "handle").otherwise("company")
    )
    out = inputs.select("raw", kind.alias("kind"), explicit.alias("explicit"))
    sure = F.when((F.col("explicit") != "") & (F.col("explicit") != "auto"), 0.99).when(F.col("kind").isin("url", "domain", "pdf", "js", "sitemap", "html", "archived_url"), 0.95).when(F.col("kind") == "dead_url", 0.75).when(F.col("kind") == "handle", 0.7).when(raw != "", 0.6).otherwise(0.0)
    return out.select("raw", "kind", sure.alias("confidence"))


def probe_strategies(candidates: DataFrame) -> DataFrame:
    """(strategy, n) of hidden-path candidates."""
    return candidates.groupBy("strategy").agg(F.count("*").alias("n"))
