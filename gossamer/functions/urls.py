"""URL functions as Column expressions: canonical form, parts, scope, routing."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions that are files, extensions that are not fetched, prefixes that are no links.
FILE_EXTENSIONS = (
    "pdf", "jpg", "jpeg", "png", "gif", "bmp", "svg", "ico", "webp", "mp3", "mp4", "avi", "mov", "webm", "wav", "ogg",
    "zip", "tar", "gz", "bz2", "7z", "rar", "exe", "dll", "so", "bin", "ttf", "woff", "woff2", "eot",
    "xml", "json", "csv", "txt", "map", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "css",
)
BINARY_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "bmp", "svg", "ico", "webp", "mp3", "mp4", "wav", "ogg", "webm", "flv", "avi", "mov",
    "zip", "tar", "gz", "bz2", "7z", "rar", "exe", "dll", "so", "bin", "ttf", "woff", "woff2", "eot",
)
NO_LINK_PREFIXES = ("javascript:", "mailto:", "tel:", "data:", "#", "void")

#: RFC 3986, appendix B.
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def built_once(f: Callable[..., Column]) -> Callable[..., Column]:
    """A large expression of plain columns is built once for each set of names: every part of it is a call to the JVM, and there are hundreds."""
    kept: dict[tuple[str, ...], Column] = {}
    made_for: list[SparkContext] = []

    def name(c: Column | None) -> str | None:
        if c is None:
            return ""
        plain = hasattr(c, "_jc") and c._jc.node().getClass().getSimpleName() == "UnresolvedAttribute"
        return str(c) if plain else None

    @wraps(f)
    def build(*columns: Column | None) -> Column:
        context, names = SparkContext._active_spark_context, tuple(map(name, columns))
        if context is None or None in names:
            return f(*columns)
        if made_for != [context]:
            kept.clear()
            made_for[:] = [context]
        if names not in kept:
            kept[names] = f(*columns)
        return kept[names]

    return build


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def authority(url: Column) -> Column:
    return part(url, 2)


def hostname(url: Column) -> Column:
    """Lower-case host without userinfo, port and brackets; '' if there is none."""
    return F.lower(F.regexp_extract(authority(url), r"^(?:.*@)?\[?((?<=\[)[^\]]*|[^:\[]*)", 1))


def path_of(url: Column) -> Column:
    return part(url, 3)


def query_of(url: Column) -> Column:
    return part(url, 4)


def decode_component(c: Column) -> Column:
    """Percent-decoding with + as space; text that cannot be decoded stays."""
    return F.coalesce(F.try_url_decode(c), c)


def encode_component(c: Column) -> Column:
    """As in forms: letters, digits and _.-~ stay, space becomes +."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(query: Column) -> Column:
    """array<struct<key, at, value>> of the decoded pairs; blank values stay, empty fields do not."""
    fields = F.filter(F.split(query, "&"), lambda x: x != "")

    def pair(x: Column, i: Column) -> Column:
        return F.struct(
            decode_component(F.substring_index(x, "=", 1)).alias("key"), i.alias("at"),
            F.when(F.instr(x, "=") > 0, decode_component(F.substring(x, F.instr(x, "=") + 1, F.length(x)))).otherwise(F.lit("")).alias("value"),
        )

    return F.transform(fields, pair)


def normalize_query(query: Column) -> Column:
    """Pairs in stable order of their keys, encoded anew."""
    pairs = F.transform(F.array_sort(query_pairs(query)), lambda p: F.concat(encode_component(p["key"]), F.lit("="), encode_component(p["value"])))
    return F.when(F.coalesce(query, F.lit("")) == "", F.lit("")).otherwise(F.array_join(pairs, "&"))


def normalize_path(path: Column) -> Column:
    """Absolute path without dot segments, doubled and trailing slashes."""

    def fold(done: Column, x: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when((x == "") | (x == "."), done).when(x == "..", up).otherwise(F.concat(done, F.array(x)))

    # Only paths with something to fold pay for it.
    plain = path.rlike(r"^/") & ~path.rlike(r"//|/\.{1,2}(?:/|$)|.(?<=/)$")
    folded = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), fold), "/"))
    return F.when(plain, path).otherwise(folded)


def resolve(url: Column, base: Column) -> Column:
    """The reference ``url`` seen from ``base``, RFC 3986 section 5.2; dot segments are left to normalize_path."""
    root = F.concat(part(base, 1), F.lit("://"), authority(base))
    base_path = path_of(base)
    folder = F.when(base_path == "", F.lit("/")).otherwise(F.regexp_replace(base_path, r"[^/]*$", ""))
    base_query = F.when(query_of(base) != "", F.concat(F.lit("?"), query_of(base))).otherwise(F.lit(""))
    return (
        F.when((part(url, 1) != "") | (part(base, 1) == ""), url)
        .when(url.startswith("//"), F.concat(part(base, 1), F.lit(":"), url))
        .when(url.startswith("/"), F.concat(root, url))
        .when(url.startswith("?"), F.concat(root, base_path, url))
        .when(url.startswith("#") | (url == ""), F.concat(root, base_path, base_query, url))
        .otherwise(F.concat(root, folder, url))
    )


@built_once
def normalize_url(url: Column, base: Column | None = None) -> Column:
    """Canonical http(s) URL.

    Trimmed; resolved against ``base``; scheme and host in lower case; userinfo, default ports and
    fragment dropped; path folded; query in stable key order. '' for null, blank and hostless ones;
    other schemes come back as they are after resolving; a port that is no number gives null.
    """
    base = F.lit("") if base is None else F.coalesce(base, F.lit(""))

    def joined(text: Column) -> Column:
        lone = F.when(text.startswith("//"), F.concat(F.lit("http:"), text)).otherwise(text)
        return F.when(text == "", text).when(base == "", lone).otherwise(resolve(text, base))

    def parts(whole: Column) -> Column:
        raw_path = path_of(whole)
        return F.struct(
            whole.alias("whole"), scheme(whole).alias("kind"), hostname(whole).alias("host"),
            F.regexp_extract(authority(whole), r":([^:\]]*)$", 1).alias("port"),
            F.when(raw_path.startswith("/"), raw_path).otherwise(F.concat(F.lit("/"), raw_path)).alias("path"),
            query_of(whole).alias("query"),
        )

    def canonical(u: Column) -> Column:
        kind, host = u["kind"], u["host"]
        web = kind.isin("http", "https")
        number = F.when(u["port"] == "", F.lit(0)).otherwise(u["port"].try_cast("int"))
        shown = F.when((number == 0) | ((kind == "http") & (number == 80)) | ((kind == "https") & (number == 443)), F.lit("")).otherwise(F.concat(F.lit(":"), number.cast("string")))
        prefix = F.when(kind != "", F.concat(kind, F.lit("://"))).when(host != "", F.lit("//")).otherwise(F.lit(""))
        query = F.when(u["query"] == "", F.lit("")).otherwise(let(normalize_query(u["query"]), lambda q: F.when(q == "", q).otherwise(F.concat(F.lit("?"), q))))
        done = F.concat(prefix, host, shown, normalize_path(u["path"]), query)
        return F.when(u["whole"] == "", F.lit("")).when((kind != "") & ~web, u["whole"]).when(web & (host == ""), F.lit("")).otherwise(done)

    return let(let(let(strip(F.coalesce(url, F.lit(""))), joined), parts), canonical)


def fuzzable_url(normalized: Column) -> Column:
    """A canonical URL with its distinct parameter names, sorted and blank; '' without parameters."""
    keys = F.array_sort(F.array_distinct(F.transform(query_pairs(query_of(normalized)), lambda p: p["key"])))
    bare = F.substring_index(normalized, "?", 1)
    shown = F.array_join(F.transform(keys, lambda k: F.concat(encode_component(k), F.lit("="))), "&")
    return F.when((normalized == "") | (F.size(keys) == 0) | (query_of(normalized) == ""), F.lit("")).otherwise(F.concat(bare, F.lit("?"), shown))


def extension(url: Column) -> Column:
    """What follows the last dot before the query, in lower case; '' without a dot."""
    front = F.substring_index(url, "?", 1)
    return F.when(front.contains("."), F.lower(F.substring_index(front, ".", -1))).otherwise(F.lit(""))


def link_route(url: Column) -> Column:
    """skip, file or link: what becomes of a discovered reference."""
    skipped = F.coalesce(url, F.lit("")) == ""
    for prefix in NO_LINK_PREFIXES:
        skipped = skipped | url.startswith(prefix)
    return F.when(skipped, F.lit("skip")).when(extension(url).isin(*FILE_EXTENSIONS), F.lit("file")).otherwise(F.lit("link"))


def is_binary_url(url: Column) -> Column:
    """Whether the path's extension is one that is never fetched."""
    front = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*", 0))
    return F.regexp_extract(front, r"\.([^./]*)$", 1).isin(*BINARY_EXTENSIONS)


def remove_file(url: Column) -> Column:
    """Without the last path segment, where there is one."""
    last = F.regexp_extract(url, r"/[^/]*$", 0)
    return F.when((F.length(url) - F.length(F.replace(url, F.lit("/"), F.lit(""))) > 2) & (last != "/") & (last != ""), F.replace(url, last, F.lit(""))).otherwise(url)


def matches_filters(url: Column, allow: list[str] | None = None, deny: list[str] | None = None) -> Column:
    """No deny pattern occurs and, if allow patterns are given, one of them does."""
    ok = F.lit(True)
    for p in deny or ():
        ok = ok & ~url.rlike(p)
    if allow:
        some = F.lit(False)
        for p in allow:
            some = some | url.rlike(p)
        ok = ok & some
    return ok


def in_scope(url: Column, host: Column, scope: str = "host", domain: Column | None = None, url_domain: Column | None = None, allow: list[str] | None = None, deny: list[str] | None = None) -> Column:
    """Whether the URL belongs to the crawl: same host, or same registrable domain (``url_domain`` given by registered_domains)."""
    own, target = hostname(url), F.lower(F.substring_index(F.coalesce(host, F.lit("")), ":", 1))
    same = own == target
    if scope == "domain":
        same = same | (url_domain == F.lower(domain))
    elif scope != "host":
        same = F.lit(False)
    return (own != "") & (target != "") & matches_filters(url, allow, deny) & same


def original_archive_target(url: Column) -> Column:
    """The archived page's own URL, from the query or from the path; other URLs as they are."""
    given = F.get(F.transform(F.filter(query_pairs(query_of(url)), lambda p: p["key"] == "url"), lambda p: p["value"]), F.lit(0))
    path = decode_component(F.replace(path_of(url), F.lit("+"), F.lit("%2B")))
    at = F.instr(path, "/http")
    return F.when(hostname(url) != "web.archive.org", url).when(F.coalesce(given, F.lit("")) != "", given).when(at > 0, F.substring(path, at + 1, F.length(path))).otherwise(url)


def seedable_robot_path(path: Column) -> Column:
    bare = strip(path)
    return F.when((bare == "") | (bare == "/") | bare.contains("*") | bare.contains("$"), F.lit("")).when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))


def slug(c: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def target_slug(url: Column) -> Column:
    """A target's name for folders: its host, else its path, as a slug."""
    host = F.coalesce(F.nullif(authority(url), F.lit("")), F.nullif(path_of(url), F.lit("")), F.lit("target"))
    return F.when(slug(host) == "", F.lit("target")).otherwise(slug(host))


def run_folder(host: Column, mode: Column, at: Column) -> Column:
    """Folder of a run started at ``at``: time, host and mode."""
    name = F.when(slug(host) == "", F.lit("specimen")).otherwise(slug(host))
    return F.concat(F.lit("sealed-runs/"), F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("-"), name, F.lit("-"), mode)


def evidence_stem(url: Column) -> Column:
    """Name of a rendered page's evidence: its host with dashes for signs, and the digest of the address."""
    base = F.coalesce(F.nullif(authority(url), F.lit("")), F.nullif(path_of(url), F.lit("")), F.lit("rendered-page"))
    safe = F.regexp_replace(F.regexp_replace(F.lower(base), r"[^\p{L}\p{N}]", "-"), "^-+|-+$", "")
    return F.concat(F.when(safe == "", F.lit("rendered-page")).otherwise(safe), F.lit("-"), F.substring(F.sha2(F.coalesce(url, F.lit("")).cast("binary"), 256), 1, 12))


# --- registrable domains --------------------------------------------------------------------


def public_suffixes(spark: SparkSession) -> DataFrame:
    """(rule, kind) of the public suffix list that ships with Spark's HTTP client, its ICANN section: plain, * and ! rules. About 7000 rows."""
    jvm = spark._jvm
    stream = jvm.Thread.currentThread().getContextClassLoader().getResourceAsStream("mozilla/public-suffix-list.txt")
    text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    rules = []
    for line in text.split("===END ICANN DOMAINS===")[0].splitlines():
        line = line.strip()
        if line and not line.startswith("//"):
            kind = "wild" if line.startswith("*.") else "except" if line.startswith("!") else "plain"
            rules.append((line.removeprefix("*.").removeprefix("!"), kind))
    return spark.createDataFrame(rules, "rule string, kind string")


def registered_domains(hosts: DataFrame, host: str = "host") -> DataFrame:
    """(host, domain): the registrable domain of each distinct host; the host itself for addresses and bare suffixes.

    The longest matching rule wins and ``!`` rules beat all. Each host's suffixes meet the rules, a fixed
    list, in one broadcast equi-join.
    """
    spark = hosts.sparkSession
    one = hosts.select(F.lower(F.col(host)).alias("host")).where("host is not null").distinct()
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.struct(i.alias("at"), F.array_join(F.slice("labels", i, F.size("labels")), ".").alias("tail")))
    each = one.withColumn("labels", labels).select("host", "labels", F.explode(tails).alias("t")).select("host", "labels", "t.at", "t.tail")
    hit = each.join(F.broadcast(public_suffixes(spark)), F.col("tail") == F.col("rule"))
    # Place of the first label of the suffix: a wildcard takes one more, an exception one fewer.
    start = F.when(F.col("kind") == "plain", F.col("at")).when(F.col("kind") == "wild", F.col("at") - 1).otherwise(F.col("at") + 1)
    best = hit.where(start >= 1).groupBy("host").agg(
        F.min_by("at", F.when(F.col("kind") == "except", F.col("at"))).alias("except_at"), F.min(F.when(F.col("kind") != "except", start)).alias("suffix_at")
    )
    known = one.join(best, "host", "left")
    labels = F.split("host", r"\.")
    suffix = F.coalesce(F.col("except_at") + 1, F.col("suffix_at"))
    is_address = F.col("host").rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") | F.col("host").contains(":")
    domain = F.array_join(F.slice(labels, (suffix - 1).cast("int"), F.size(labels)), ".")
    return known.select("host", F.when(is_address | suffix.isNull() | (suffix < 2), F.col("host")).otherwise(domain).alias("domain"))
