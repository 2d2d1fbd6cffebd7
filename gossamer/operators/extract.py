"""Table-valued extractors: pages, scripts and documents in, typed rows out.

Each takes a DataFrame with ``url`` and a body column and returns rows with ``url`` first. They are projections
and explodes over one scan: no shuffles but where distinct rows are asked for.
Null bodies give no rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.literals import is_open, open_kinds
from ..functions import text as T
from ..functions import urls as U

Extractor = Callable[[DataFrame], DataFrame]
#: Registered extractors by name, of pages and of scripts, in order of registration.
PAGE_EXTRACTORS: dict[str, Extractor] = {}
SCRIPT_EXTRACTORS: dict[str, Extractor] = {}


def page_extractor(f: Extractor) -> Extractor:
    PAGE_EXTRACTORS[f.__name__] = f
    return f


def script_extractor(f: Extractor) -> Extractor:
    SCRIPT_EXTRACTORS[f.__name__] = f
    return f


def _body(df: DataFrame) -> Column:
    return F.col("body") if "body" in df.columns else F.col("html")


def _unfold(rows: DataFrame, items: Column, name: str, *keep: str, at: str | None = None) -> DataFrame:
    """A row per item of an array without nulls, with the columns ``keep`` (url by default) and, if asked for, its place.

    Outer, with the nulls of empty arrays dropped after: before a plain explode Spark puts a filter on the array's size, and
    evaluates the array twice.
    """
    each = F.posexplode_outer(items).alias(at, name) if at else F.explode_outer(items).alias(name)
    return rows.select(*(keep or ("url",)), each).where(F.col(name).isNotNull())


@page_extractor
def links(pages: DataFrame) -> DataFrame:
    """url, ord, raw, target, route: references in attributes, resolved, and whether each is a link, a file or neither."""
    bare = F.substring_index(F.regexp_replace(F.col("g"), "[\"']", ""), "#", 1)
    found = _unfold(pages, T.find_all(_body(pages), P.HREF, 3), "g", at="ord").select("url", "ord", F.col("g").alias("raw"), bare.alias("bare"))
    # Blank or hostless references resolve to nothing and stand for themselves.
    found = found.withColumn("target", U.normalize_url(F.col("bare"), F.col("url")))
    found = found.withColumn("target", F.when(F.coalesce("target", F.lit("")) == "", F.col("bare")).otherwise(F.col("target")))
    return found.select("url", "ord", "raw", "target", U.link_route(F.col("target")).alias("route"))


def mark_scope(found: DataFrame, host: str | None = None, scope: str = "host", target: str = "target", domain: str | None = None, allow: list[str] | None = None, deny: list[str] | None = None) -> DataFrame:
    """Adds ``scope``: internal or external, by the crawl's host, or by each page's own host where none is given."""
    home = F.lit(host) if host is not None else U.hostname(F.col("url"))
    if scope == "host":
        inside = U.in_scope(F.col(target), home, allow=allow, deny=deny)
        return found.withColumn("scope", F.when(inside, F.lit("internal")).otherwise(F.lit("external")))
    named = found.withColumn("__host", U.hostname(F.col(target)))
    domains = U.registered_domains(named.select(F.col("__host").alias("host"))).select(F.col("host").alias("__host"), F.col("domain").alias("__domain"))
    inside = U.in_scope(F.col(target), home, "domain", F.lit(domain), F.col("__domain"), allow, deny)
    return named.join(domains, "__host", "left").withColumn("scope", F.when(inside, F.lit("internal")).otherwise(F.lit("external"))).drop("__host", "__domain")


def _tagged(kind: str, name: str, key: str = "kind"):
    return lambda m: F.struct(F.lit(kind).alias(key), m.alias(name))


def intel_rows(rows: DataFrame, text: str, kinds: tuple[str, ...] | None = None, *keep: str) -> DataFrame:
    """(keep..., kind, match) of the contact and service findings in a text, of all kinds by default, distinct in each row.

    One scan for literals (open_kinds) and one for figures tell which kinds a text can hold; only their patterns are run on it.
    """
    kinds = tuple(kinds or P.INTEL)
    literals = {k: P.INTEL_LITERALS[k] for k in kinds if k in P.INTEL_LITERALS}
    body, none = F.col(text), F.array().cast("array<struct<kind:string,match:string>>")
    opened = rows.select(*keep, text, open_kinds(body, literals).alias("__open"))
    if any(k in P.INTEL_FIGURES for k in kinds):
        opened = opened.withColumn("__figure", body.rlike(P.FIGURE))
    each = []
    for kind in kinds:
        may = is_open(F.col("__open"), kind, literals) if kind in literals else F.col("__figure") & body.rlike(P.INTEL_FIGURES[kind])
        each.append(F.when(may, F.transform(T.find_all(body, P.INTEL[kind]), _tagged(kind, "match"))).otherwise(none))
    return _unfold(opened, F.array_distinct(F.concat(*each)), "m", *keep).select(*keep, "m.kind", "m.match")


@page_extractor
def intel(pages: DataFrame) -> DataFrame:
    """url, kind, match: distinct findings in the visible text, card numbers not yet checked."""
    return intel_rows(pages.select("url", T.visible_text(_body(pages)).alias("text")), "text", None, "url")


def text_intel(docs: DataFrame, key: str = "url", text: str = "text", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(key, kind, match) of plain texts, distinct in each."""
    return intel_rows(docs, text, kinds, key)


def valid_intel(found: DataFrame) -> DataFrame:
    """Card numbers that fail their check digit go; others stay."""
    return found.where((F.col("kind") != "CREDIT_CARD") | T.luhn(F.col("match")))


def intel_lines(found: DataFrame) -> DataFrame:
    return found.select(F.concat_ws(":", "url", "kind", "match").alias("line"))


@page_extractor
def script_references(pages: DataFrame) -> DataFrame:
    """url, script: sources of script tags, resolved."""
    raw = _unfold(pages, T.find_all(_body(pages), P.SCRIPT_SRC, 3), "g")
    return raw.select("url", U.normalize_url(F.regexp_replace("g", "[\"']", ""), F.col("url")).alias("script")).where("script != ''")


def route_scripts(found: DataFrame, host: str, scope: str = "host", domain: str | None = None, allow: list[str] | None = None, deny: list[str] | None = None) -> DataFrame:
    """(script) -> dataset, value: scripts of the crawl itself as scripts, others as external, once each."""
    marked = mark_scope(found, host, scope, "script", domain, allow, deny)
    return marked.select(F.when(F.col("scope") == "internal", F.lit("scripts")).otherwise(F.lit("external")).alias("dataset"), F.col("script").alias("value")).distinct()


@page_extractor
def forms(pages: DataFrame) -> DataFrame:
    """url, ord, action, method, inputs: forms with their named fields as sorted name:type."""

    def attribute(c: Column, name: str) -> Column:
        return F.when(c.rlike(P.ATTRIBUTE[name]), F.regexp_extract(c, P.ATTRIBUTE[name], 2))

    found = _unfold(pages, T.find_groups(_body(pages), P.FORM, 1, 2), "f", at="ord")
    attrs = F.col("f.g0")
    fields = F.transform(
        F.filter(T.find_all(F.col("f.g1"), P.FORM_FIELD, 1), lambda a: a.rlike(P.ATTRIBUTE["name"])),
        lambda a: F.concat(attribute(a, "name"), F.lit(":"), F.lower(F.coalesce(attribute(a, "type"), F.lit("text")))),
    )
    action = U.normalize_url(F.coalesce(attribute(attrs, "action"), F.col("url")), F.col("url"))
    return found.select("url", "ord", F.when(action == "", F.col("url")).otherwise(action).alias("action"), F.upper(F.coalesce(attribute(attrs, "method"), F.lit("GET"))).alias("method"), F.array_sort(fields).alias("inputs"))


def form_lines(found: DataFrame) -> DataFrame:
    return found.select(F.concat(F.lit("action="), "action", F.lit(" method="), "method", F.lit(" inputs="), F.array_join("inputs", ",")).alias("line")).distinct()


def _inline_references(body: Column, hints: bool) -> Column:
    low = F.lower(body)
    none = F.array().cast("array<string>")
    found = F.concat(T.find_all(body, P.INLINE_URL, 1), T.find_all(body, P.INLINE_PATH, 1))
    graphql = T.find_all(body, P.GRAPHQL_HINT)
    if not hints:
        return F.concat(found, F.when(low.contains("graphql"), graphql).otherwise(none))
    return F.concat(
        found,
        F.when(low.contains("swagger") | low.contains("openapi"), F.array(*[F.lit(p) for p in P.API_DOC_PATHS])).otherwise(none),
        F.when(low.contains("graphql"), F.concat(graphql, F.array(F.lit("/graphql")))).otherwise(none),
        F.when(low.contains("asset-manifest"), F.array(F.lit("/asset-manifest.json"))).otherwise(none),
        F.when(low.contains("manifest.json"), F.array(F.lit("/manifest.json"))).otherwise(none),
    )


def route_references(found: DataFrame) -> DataFrame:
    """(url, target) -> url, target, kind: file, endpoint (its folded path) or link; a reference may be several."""
    path = F.lower(U.path_of(F.col("target")))
    is_file = F.lit(False)
    for ext in P.DISCOVERY_FILES:
        is_file = is_file | path.endswith(ext)
    api = path.contains("/graphql") | path.contains("/api/") | path.endswith("/graphiql")
    kinds = F.array_compact(F.array(
        F.when(is_file, F.struct(F.lit("file").alias("kind"), F.col("target").alias("value"))),
        F.when(api, F.struct(F.lit("endpoint").alias("kind"), U.normalize_path(U.path_of(F.col("target"))).alias("value"))),
        F.when(U.link_route(F.col("target")) == "file", F.struct(F.lit("file").alias("kind"), F.col("target").alias("value"))),
        F.when(U.link_route(F.col("target")) == "link", F.struct(F.lit("link").alias("kind"), F.col("target").alias("value"))),
    ))
    return _unfold(found, F.array_distinct(kinds), "k", "url", "target").select("url", "k.kind", "k.value").distinct()


@page_extractor
def structured_references(pages: DataFrame) -> DataFrame:
    """url, kind, value: references quoted inside pages, and the paths that keywords hint at."""
    raw = _unfold(pages, F.array_distinct(_inline_references(_body(pages), True)), "g")
    return route_references(raw.select("url", U.normalize_url(F.col("g"), F.col("url")).alias("target")).where("target != ''"))


def custom_matches(pages: DataFrame, pattern: str) -> DataFrame:
    """url, match: all matches of a user's pattern; the groups, joined by commas, if it has any. A pattern that does not compile is an error."""
    groups = pages.sparkSession._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
    if groups <= 1:
        found = T.find_all(_body(pages), pattern, groups)
    else:
        found = F.transform(T.find_groups(_body(pages), pattern, *range(1, groups + 1)), lambda m: F.concat_ws(", ", *[m[f"g{i}"] for i in range(groups)]))
    return _unfold(pages, F.array_distinct(found), "match")


@page_extractor
def secrets(pages: DataFrame, known: bool = True) -> DataFrame:
    """url, kind, token, entropy, reported: quoted tokens are reported from four bits a character on; ``known`` shapes too."""
    row = lambda kind: lambda m: F.struct(F.lit(kind).alias("kind"), F.trim(m).alias("token"))
    body, none = F.col("__body"), F.array().cast("array<struct<kind:string,token:string>>")
    opened = pages.select("url", _body(pages).alias("__body"))
    each = []
    if known:
        opened = opened.withColumn("__open", open_kinds(body, {}, P.SECRET_LITERALS))
        each = [F.when(is_open(F.col("__open"), k, {}, P.SECRET_LITERALS), F.transform(T.find_all(body, p, 1), row(k))).otherwise(none) for k, p in P.SECRETS.items()]
    each.append(F.transform(T.find_all(body, P.ENTROPY_TOKEN, 1), row("HIGH_ENTROPY")))
    rows = _unfold(opened, F.array_distinct(F.concat(*each)), "s").select("url", "s.*").withColumn("entropy", T.entropy(F.col("token")))
    return rows.withColumn("reported", (F.col("kind") != "HIGH_ENTROPY") | (F.col("entropy") >= P.ENTROPY_LEAST))


@page_extractor
def threads(pages: DataFrame) -> DataFrame:
    """url, thread, post, author, reply_to, quote, text of forum blocks, numbered from 1 in each page."""
    body = _body(pages)
    # The HTML references of title and blocks are decoded once, in one Arrow pass per column.
    path = U.path_of(F.col("url"))
    titled = pages.select("url", body.alias("body"), F.when(body.rlike(P.TITLE), F.regexp_extract(body, P.TITLE, 1)).alias("title"), F.when(path == "", F.col("url")).otherwise(path).alias("fallback"))
    blocks = _unfold(titled, T.find_all(F.col("body"), P.THREAD_BLOCK, 1), "block", "url", "title", "fallback", at="at")
    author = F.coalesce(F.nullif(F.regexp_extract("block", P.AUTHOR, 1), F.lit("")), F.nullif(F.regexp_extract("block", P.AUTHOR, 2), F.lit("")), F.lit("deleted-user"))
    quote = F.when(F.col("block").rlike(P.QUOTE_BLOCK), F.regexp_extract("block", P.QUOTE_BLOCK, 1)).otherwise(F.lit(""))
    out = blocks.select(
        "url", F.when(F.col("title").isNull(), F.col("fallback")).otherwise(T.strip_tags(F.col("title"))).alias("thread"), (F.col("at") + 1).alias("post"),
        T.strip_tags(author).alias("author"), F.when(F.col("block").rlike(P.REPLY), F.regexp_extract("block", P.REPLY, 1)).otherwise(F.lit("root")).alias("reply_to"),
        F.substring(T.strip_tags(quote), 1, 120).alias("quote"), F.substring(T.strip_tags(F.col("block")), 1, 180).alias("text"),
    )
    return out.withColumn("author", F.when(F.col("author") == "", F.lit("deleted-user")).otherwise(F.col("author")))


def _meta(body: Column) -> Column:
    """Map of meta names to contents, names in lower case; of repeated ones the last counts."""
    pairs = F.transform(T.find_groups(body, P.META, 1, 2), lambda m: F.struct(F.lower(m["g0"]).alias("k"), m["g1"].alias("v")))
    # Reversed, then the first of each name.
    back = F.reverse(pairs)
    names = F.transform(back, lambda p: p["k"])
    return F.map_from_entries(F.filter(back, lambda p, i: F.array_position(names, p["k"]) == i + 1))


@page_extractor
def locations(pages: DataFrame) -> DataFrame:
    """url, kind, confidence, source, label, lat, lon: coordinates and places that a page tells."""
    body = _body(pages)
    base = pages.select("url", body.alias("body"), _meta(body).alias("meta"), T.strip_tags(body).alias("text"))

    def row(kind: str, confidence: str, source: str, label: Column, lat: Column | None = None, lon: Column | None = None) -> Column:
        s = lambda x: F.lit(x).alias
        none = F.lit(None).cast("string")
        return F.struct(s(kind)("kind"), s(confidence)("confidence"), s(source)("source"), label.alias("label"), (none if lat is None else lat).alias("lat"), (none if lon is None else lon).alias("lon"))

    said = F.transform(T.find_groups(F.col("body"), P.COORDINATES, 1, 2), lambda m: row("coordinate", "exact", "text", F.lit("coordinate"), m["g0"], m["g1"]))
    tags = []
    for key in P.META_POINT_KEYS:
        value = F.coalesce(F.element_at("meta", key), F.lit(""))
        cut = lambda sep: (F.trim(F.substring_index(value, sep, 1)), F.trim(F.substring(value, F.instr(value, sep) + 1, F.length(value))))
        semicolon = value.contains(";")
        lat, lon = (F.when(semicolon, x).otherwise(y) for x, y in zip(cut(";"), cut(","), strict=True))
        tags.append(F.when((value.contains(";") | value.contains(",")) & (lat != "") & (lon != ""), row("geotag", "high", "meta", F.lit(key), lat, lon)))
    first = lambda keys: F.coalesce(*[F.nullif(F.trim(F.element_at("meta", k)), F.lit("")) for k in keys])
    lat, lon = first(P.META_LAT_KEYS), first(P.META_LON_KEYS)
    tags.append(F.when(lat.isNotNull() & lon.isNotNull(), row("geotag", "high", "meta", F.lit(f"{P.META_LAT_KEYS[0]}+{P.META_LON_KEYS[0]}"), lat, lon)))
    for key in P.META_PLACE_KEYS:
        place = F.trim(F.coalesce(F.element_at("meta", key), F.lit("")))
        tags.append(F.when(place != "", row("place", "medium", "meta", place)))
    good = lambda p: ~p.isin(*P.PLACE_STOPWORDS) & (p.rlike(r"(?U)\s") | (F.length(p) >= 4))
    guesses = F.transform(F.filter(T.find_all(F.col("text"), P.PLACE, 1), good), lambda p: row("place", "weak", "text", p))
    return _unfold(base, F.array_distinct(F.concat(said, F.array_compact(F.array(*tags)), guesses)), "r").select("url", "r.*")


@page_extractor
def stories(pages: DataFrame, closed: bool = False) -> DataFrame:
    """url, story, cluster, relation, title, source, published, lang, refs, value.

    One page and one metadata row for each page with a title; up to ten distinct links in order as
    reference, or mirror where they leave the domain; up to five quotes. With ``closed``, only references with
    their semicolon are decoded in titles and quotes; links stay as the page writes them.
    """
    body = _body(pages)
    plain = lambda t: T.strip_tags(T.closed_references(t) if closed else t)
    base = pages.select("url", body.alias("body"), _meta(body).alias("meta"), F.regexp_extract(body, P.TITLE, 1).alias("tag"), plain(body).alias("text"))
    meta = lambda k: F.nullif(F.element_at("meta", k), F.lit(""))
    domain = U.authority(F.col("url"))
    base = base.select(
        "url", F.coalesce(meta("og:title"), meta("twitter:title"), plain(F.col("tag"))).alias("title"),
        F.coalesce(meta("article:published_time"), F.nullif(F.regexp_extract("body", P.TIME, 1), F.lit(""))).alias("published"),
        F.nullif(F.regexp_extract("body", P.LANG, 1), F.lit("")).alias("lang"), F.coalesce(meta("og:site_name"), domain).alias("source"), domain.alias("domain"),
        F.array_sort(F.array_distinct(T.find_all(F.col("body"), P.ABSOLUTE_LINK, 1))).alias("links"), T.find_all(F.col("text"), P.QUOTE, 1).alias("quotes"),
    ).where("title != ''")
    story = F.when(U.slug(F.col("title")) == "", F.lit("story")).otherwise(U.slug(F.col("title")))
    base = base.withColumn("story", story)
    base = base.withColumn("cluster", F.concat("story", F.lit("@"), F.when(F.col("domain") == "", F.lit("unknown")).otherwise(F.col("domain"))))
    rel = lambda r, v: F.struct(r.alias("relation"), v.alias("value"))
    refs = F.transform(F.slice("links", 1, 10), lambda x: rel(F.when((U.authority(x) != "") & (U.authority(x) != F.col("domain")), F.lit("mirror")).otherwise(F.lit("reference")), x))
    quotes = F.transform(F.slice("quotes", 1, 5), lambda x: rel(F.lit("quote"), x))
    rows = F.array_distinct(F.concat(F.array(rel(F.lit("page"), F.col("title")), rel(F.lit("metadata"), F.lit(""))), refs, quotes))
    return base.select("url", "story", "cluster", "title", "source", "published", "lang", F.size("links").alias("refs"), F.explode(rows).alias("r")).select("url", "story", "cluster", "r.relation", "title", "source", "published", "lang", "refs", "r.value")


@page_extractor
def scam_signals(pages: DataFrame) -> DataFrame:
    """url, signal, evidence: phrases of pressure and false trust."""
    plain = pages.select("url", T.strip_tags(_body(pages)).alias("text"))
    each = [F.transform(T.find_all(F.col("text"), p), _tagged(k, "evidence", "signal")) for k, p in P.SCAM.items()]
    return _unfold(plain, F.array_distinct(F.concat(*each)), "s").select("url", "s.*")


@script_extractor
def endpoints(scripts: DataFrame) -> DataFrame:
    """url, endpoint: quoted paths and addresses of scripts."""
    found = _unfold(scripts, F.array_distinct(T.find_all(_body(scripts), P.ENDPOINT, 1)), "endpoint")
    return found.where((F.col("endpoint") != "") & (F.col("endpoint") != "/") & ~F.col("endpoint").rlike("[}{><\"']"))


@script_extractor
def script_artifacts(scripts: DataFrame) -> DataFrame:
    """url, kind, value: source maps as files, and references quoted in scripts."""
    maps = _unfold(scripts, T.find_all(_body(scripts), P.SOURCE_MAP, 1), "g")
    maps = maps.select("url", F.lit("file").alias("kind"), U.normalize_url(F.col("g"), F.col("url")).alias("value")).where("value != ''")
    raw = _unfold(scripts, F.array_distinct(_inline_references(_body(scripts), False)), "g")
    inline = route_references(raw.select("url", U.normalize_url(F.col("g"), F.col("url")).alias("target")).where("target != ''"))
    return maps.unionByName(inline).distinct()


#: Kinds of script findings, and the pattern that each comes from where the names differ.
JS_KINDS = ("token", "feature", "config", "route", "api", "graphql", "api_url", "analytics_id", "storage", "error_hint", "comment", "view", "env_hint")


@script_extractor
def js_intel(scripts: DataFrame, kinds: tuple[str, ...] = JS_KINDS) -> DataFrame:
    """url, kind, name, value: what scripts tell of tokens, flags, routes, services and the like. Only the patterns of ``kinds`` run."""
    body = F.col("__body")

    def row(kind, value: Column, name: Column | None = None) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("kind"), (F.lit(None).cast("string") if name is None else name).alias("name"), value.alias("value"))

    squeeze = lambda x: F.regexp_replace(x, r"(?U)\s+", " ")
    alone = lambda kind, group=0: F.transform(T.find_all(body, P.JS[kind], group), lambda m: row(kind, m))
    pair = lambda kind, shown: F.transform(T.find_groups(body, P.JS[kind], 1, 2), lambda m: row(kind, shown(m["g1"]), m["g0"]))
    unquote = lambda x: F.regexp_replace(F.regexp_replace(x, '^"+|"+$', ""), "^'+|'+$", "")
    service = lambda m: F.when(F.lower(m).contains("/graphql"), F.lit("graphql")).otherwise(F.lit("api_url"))
    said = lambda m: F.trim(squeeze(F.replace(F.replace(F.replace(m, F.lit("/*"), F.lit("")), F.lit("*/"), F.lit("")), F.lit("//"), F.lit(""))))
    rules = {
        "token": lambda: pair("token", lambda x: x),
        "feature": lambda: pair("feature", unquote),
        "config": lambda: pair("config", lambda x: F.substring(squeeze(x), 1, 220)),
        "route": lambda: alone("route", 1),
        "api": lambda: pair("api", lambda x: x),
        "url": lambda: F.transform(F.filter(T.find_all(body, P.JS["url"]), lambda m: F.lower(m).contains("/graphql") | F.lower(m).contains("/api/")), lambda m: row(service(m), m)),
        "analytics_id": lambda: alone("analytics_id"),
        "storage": lambda: alone("storage"),
        "error_hint": lambda: F.transform(T.find_all(body, P.JS["error_hint"], 1), lambda m: row("error_hint", F.substring(F.trim(m), 1, 140))),
        "comment": lambda: F.transform(F.filter(F.transform(T.find_all(body, P.JS["comment"]), said), lambda c: F.length(c) >= 8), lambda c: row("comment", F.substring(c, 1, 140))),
        "view": lambda: alone("view", 1),
        "env_hint": lambda: alone("env_hint"),
    }
    wanted = dict.fromkeys("url" if k in ("graphql", "api_url") else k for k in kinds)
    none = F.array().cast("array<struct<kind:string,name:string,value:string>>")
    folded, exact = ({k: v for k, v in told.items() if k in wanted} for told in (P.JS_LITERALS, P.JS_EXACT))
    opened = scripts.select("url", _body(scripts).alias("__body"))
    opened = opened.withColumn("__open", open_kinds(body, folded, exact))
    each = [F.when(is_open(F.col("__open"), k, folded, exact), rules[k]()).otherwise(none) for k in wanted]
    found = _unfold(opened, F.array_distinct(F.concat(*each)), "r").select("url", "r.*")
    return found.where(F.col("kind").isin(*kinds)) if "url" in wanted else found


def inline_scripts(pages: DataFrame) -> DataFrame:
    """url, ord, body of the scripts written inside pages."""
    return _unfold(pages, T.find_all(_body(pages), r"(?is)<script\b[^>]*>(.*?)</script>", 1), "body", at="ord").where("body != ''")


# --- documents ------------------------------------------------------------------------------

DOC_SCHEMA = "url string, record string, kind string, value string"


def document_text(content: Column) -> Column:
    """UTF-8, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def document_records(documents: DataFrame) -> DataFrame:
    """(url, content binary, content_type) -> url, record (metadata or leak), kind, value; office archives go to ``office_records``."""
    path = F.lower(U.path_of(F.col("url")))
    docs = documents.select("url", path.alias("path"), F.lower(F.coalesce("content_type", F.lit(""))).alias("ct"), document_text(F.col("content")).alias("text"))
    is_pdf = F.col("path").endswith(".pdf") | F.col("ct").contains("pdf")
    row = lambda record, kind, value: F.struct(F.lit(record).alias("record"), F.lit(kind).alias("kind"), value.alias("value"))
    keyed = [F.when(is_pdf & F.col("text").rlike(rf"(?d)/{k}\s*\((.*?)\)"), row("metadata", k.lower(), F.trim(F.regexp_extract("text", rf"(?d)/{k}\s*\((.*?)\)", 1)))) for k in P.PDF_KEYS]
    legacy = F.col("path").rlike(r"\.(?:doc|xls|ppt|rtf)$") & ~is_pdf & F.col("text").rlike(P.LEGACY_AUTHOR)
    keyed.append(F.when(legacy, row("metadata", "author", F.trim(F.regexp_extract("text", P.LEGACY_AUTHOR, 1)))))
    leaks = F.concat(F.transform(T.find_all(F.col("text"), P.DOC_EMAIL), lambda m: row("leak", "email", m)), F.transform(T.find_all(F.col("text"), P.DOC_PATH), lambda m: row("leak", "path", m)))
    return _unfold(docs, F.array_distinct(F.concat(F.array_compact(F.array(*keyed)), leaks)), "r").select("url", "r.*")


#: Namespaced names of the core properties, and the members listed of an archive at most.
OFFICE_FIELDS = {
    "title": "{http://purl.org/dc/elements/1.1/}title",
    "author": "{http://purl.org/dc/elements/1.1/}creator",
    "last_modified_by": "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}lastModifiedBy",
}
LISTED_MEMBERS = 80
_EMAIL, _PATH = (re.compile(p.removeprefix("(?Ud)")) for p in (P.DOC_EMAIL, P.DOC_PATH))


def _office_rows(url: str, content: bytes) -> list[tuple[str, str, str, str]]:
    rows: dict[tuple[str, str, str, str], None] = {}
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            members = archive.namelist()
            rows |= dict.fromkeys((url, "leak", "internal-path", m) for m in members[:LISTED_MEMBERS])
            if "docProps/core.xml" in members:
                core = ElementTree.fromstring(archive.read("docProps/core.xml"))
                told = {label: (core.findtext(f".//{tag}") or "").strip() for label, tag in OFFICE_FIELDS.items()}
                rows |= dict.fromkeys((url, "metadata", label, value) for label, value in told.items() if value)
            for member in members:
                if member.endswith(".xml"):
                    text = archive.read(member).decode("utf-8", "ignore")
                    rows |= dict.fromkeys((url, "leak", "email", m) for m in _EMAIL.findall(text))
                    rows |= dict.fromkeys((url, "leak", "path", m) for m in _PATH.findall(text))
    except (OSError, zipfile.BadZipFile, ElementTree.ParseError):
        pass  # a damaged archive keeps what was read before the damage
    return list(rows)


def office_records(documents: DataFrame) -> DataFrame:
    """As document_records, for zipped office files: member names, core properties, and leaks in their XML."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for url, content in zip(batch["url"], batch["content"], strict=True) if content is not None for r in _office_rows(url, content)]
            yield pd.DataFrame(rows, columns=["url", "record", "kind", "value"])

    office = F.lower(U.path_of(F.col("url"))).rlike(r"\.(?:docx|xlsx|pptx|odt|ods|odp)$")
    return documents.where(office).select("url", "content").mapInPandas(run, DOC_SCHEMA)


def harvest_documents(files: DataFrame, fetched: DataFrame) -> DataFrame:
    """Records of the fetched documents among the linked files: (url) joined with (url, content, content_type)."""
    path = F.lower(U.path_of(F.col("url")))
    wanted = F.lit(False)
    for ext in P.DOCUMENT_EXTENSIONS:
        wanted = wanted | path.endswith(ext)
    # Both sides meet by address: Spark takes a column of addresses for as small as the keys that it is made of, and would send all to the driver.
    mine = fetched.join(files.where(wanted).select("url").distinct().hint("merge"), "url", "left_semi")
    return document_records(mine).unionByName(office_records(mine)).distinct()


def run_extractors(pages: DataFrame, scripts: DataFrame) -> DataFrame:
    """(url, extractor, row JSON) of all registered extractors: pages (url, html) and scripts (url, body) each by those made for them."""
    out = None
    for registry, bodies in ((PAGE_EXTRACTORS, pages), (SCRIPT_EXTRACTORS, scripts)):
        for name, extractor in registry.items():
            found = extractor(bodies)
            found = found.select("url", F.lit(name).alias("extractor"), F.to_json(F.struct(*[c for c in found.columns if c != "url"])).alias("row"))
            out = found if out is None else out.unionByName(found)
    return out
