"""Queries over literal runs, seeds, files and scripts. The SQL states the rows to expect; the comment above each query, by which rule."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.functions import text as T
from gossamer.functions import urls as U
from gossamer.operators import analysis, crawl, extract, ledger, runs
from gossamer.sources import fetch, readers, seeds, sinks
from gossamer.plans import control
from literal_cases import QUERIES, SITE, SQL, query, table  # noqa: F401  one registry for both modules

# --- extractors, kind by kind ---------------------------------------------------------------

# One text for each kind of finding; what a text holds besides is no finding of another kind.
_INTEL_TEXTS = {
    "EMAIL": ("mail ann@example.com now", "ann@example.com"), "PHONE": ("call 555-123-4567 now", "555-123-4567"), "IP_ADDRESS": ("host 10.0.0.1 up", "10.0.0.1"),
    "AWS_BUCKET": ("at a-b.s3-eu-west-1.amazonaws.com here", "a-b.s3-eu-west-1.amazonaws.com"), "AWS_BUCKET_URI": ("cp s3://my-data/x .", "s3://my-data"), "GCP_BUCKET": ("storage.googleapis.com/bucket_1/o", "storage.googleapis.com/bucket_1"),
    "AZURE_BLOB": ("get https://acct.blob.core.windows.net/c/f.txt now", "https://acct.blob.core.windows.net/c/f.txt"), "CREDIT_CARD": ("paid 4111111111111111 once", "4111111111111111"), "SOCIAL_SECURITY": ("no 123-45-6789 here", "123-45-6789"),
    "BITCOIN": ("to 1BoatSLRHtKNngkdXEeobR76b53LETtpyT please", "1BoatSLRHtKNngkdXEeobR76b53LETtpyT"), "GITHUB": ("github.com/acme/x", "github.com/acme"), "FACEBOOK": ("facebook.com/acme.page?x", "facebook.com/acme.page"),
    "INSTAGRAM": ("instagram.com/acme_1/", "instagram.com/acme_1"), "REDDIT": ("reddit.com/user/acme", "reddit.com/user/acme"), "TWITTER": ("twitter.com/acme", "twitter.com/acme"), "DISCORD_INVITE": ("discord.com/invite/abc123", "discord.com/invite/abc123"),
    "TELEGRAM": ("t.me/acme", "t.me/acme"), "PASTEBIN": ("pastebin.com/AbC1", "pastebin.com/AbC1"), "LINKEDIN": ("linkedin.com/in/acme-1", "linkedin.com/in/acme-1"), "YOUTUBE": ("youtube.com/@acme", "youtube.com/@acme"),
}


@query("intel_kinds", "i, kind, match", [(i, kind, match) for i, (kind, (_, match)) in enumerate(_INTEL_TEXTS.items())])
def intel_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, "i int, text string", *((i, text) for i, (text, _) in enumerate(_INTEL_TEXTS.values())))
    return extract.text_intel(texts, "i")


# Group 1 of each shape, which of the access key is its prefix. Quoted tokens of twenty signs count by their entropy: twenty different
# letters have log2 20 = 4.32 bits, above the least of 4; one letter has none.
_SECRETS = (
    ("AWS_ACCESS_KEY_ID", "AKIA" + "ABCD1234" * 2, "AKIA", True), ("GITHUB_TOKEN", "gho_" + "a1" * 18, "gho_" + "a1" * 18, True), ("SLACK_TOKEN", "xoxb-" + "12345-abcde", "xoxb-" + "12345-abcde", True),
    ("STRIPE_LIVE_SECRET", "sk_" + "live_" + "a1" * 8, "sk_" + "live_" + "a1" * 8, True), ("GOOGLE_API_KEY", "AIza" + "b2" * 17 + "c", "AIza" + "b2" * 17 + "c", True), ("JSON_WEB_TOKEN", "eyJabc.def.ghi", "eyJabc.def.ghi", True),
    ("PRIVATE_KEY", "-----BEGIN EC PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----", True), ("HIGH_ENTROPY", '"abcdefghijklmnopqrst"', "abcdefghijklmnopqrst", True), ("HIGH_ENTROPY", "'" + "a" * 22 + "'", "a" * 22, False),
)


@query("secret_shapes", "i, kind, token, reported", [(i, kind, token, reported) for i, (kind, _, token, reported) in enumerate(_SECRETS)])
def secret_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.secrets(table(spark, "url int, body string", *((i, f"x {text} y") for i, (_, text, _, _) in enumerate(_SECRETS))))
    return found.select(F.col("url").alias("i"), "kind", "token", "reported")


# A statement for each kind. What follows // is a comment wherever it stands, in addresses too, from eight signs on.
_STATEMENTS = (
    ('token: "abcdef123"', [("token", "token", "abcdef123")]), ("newFeature = true", [("feature", "newFeature", "true")]), ('settings = {"a": 1}', [("config", "settings", '{"a": 1}')]), ('route("/home")', [("route", None, "/home")]),
    ('GET "/v/x"', [("api", "GET", "/v/x")]), ('"https://h.com/graphql"', [("graphql", None, "https://h.com/graphql"), ("comment", None, 'h.com/graphql"')]), ('"https://h.com/api/v1"', [("api_url", None, "https://h.com/api/v1"), ("comment", None, 'h.com/api/v1"')]),
    ('gtag("G-ABCDEF12")', [("analytics_id", None, "G-ABCDEF12")]), ('"https://my.cdn.x.net/a.js"', [("storage", None, "https://my.cdn.x.net/a.js"), ("comment", None, 'my.cdn.x.net/a.js"')]),
    ('error: "went wrong"', [("error_hint", None, "went wrong")]), ("console.warn(nothing here)", [("error_hint", None, "nothing here)")]), ("/* a longer note */", [("comment", None, "a longer note")]), ("/* short */", []),
    ('view = "Main"', [("view", None, "Main")]), ("process.env.KEY_A", [("env_hint", None, "process.env.KEY_A")]), ("VITE_MODE", [("env_hint", None, "VITE_MODE")]),
)


@query("js_kinds", "i, kind, name, value", [(i, *row) for i, (_, rows) in enumerate(_STATEMENTS) for row in rows])
def js_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.js_intel(table(spark, "url int, body string", *((i, text) for i, (text, _) in enumerate(_STATEMENTS))))
    return found.select(F.col("url").alias("i"), "kind", "name", "value")


# Quoted references resolve against the page; an interface's path is an endpoint and a link, .json a file. "openapi" hints at four
# documents, "asset-manifest" at one.
_STRUCTURED = "<script>fetch('/api/items'); openapi; 'asset-manifest'; load(\"https://h.com/data.json\")</script>"


@query("structured_kinds", "kind, value", [
    ("endpoint", "/api/items"), ("link", SITE + "/api/items"), ("file", "https://h.com/data.json"), ("file", SITE + "/openapi.json"), ("file", SITE + "/swagger.json"), ("link", SITE + "/v2/api-docs"), ("link", SITE + "/v3/api-docs"),
    ("file", SITE + "/asset-manifest.json"),
])
def structured_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.structured_references(table(spark, "url string, html string", (SITE + "/p", _STRUCTURED))).select("kind", "value")


# Bounds of a story: ten of twelve links, in order of their text, and five of seven quotes; the title's slug names the story.
_LINKS = [f"https://other.example.net/{k:02d}" for k in range(12)]
_QUOTES = [f"a quoted sentence {k}" for k in range(7)]


@query("story_bounds", "relation, n, least, most", [
    ("page", 1, "Big news", "Big news"), ("metadata", 1, "", ""), ("mirror", 10, _LINKS[0], _LINKS[9]), ("quote", 5, _QUOTES[0], _QUOTES[4]),
])
def story_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = "<title>Big news</title>" + "".join(f'<a href="{x}">x</a>' for x in reversed(_LINKS)) + "".join(f' "{q}" ' for q in _QUOTES)
    rows = extract.stories(table(spark, "url string, html string", (SITE + "/n", page)))
    return rows.groupBy("relation").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


# Script and style bodies and comments are no text of a page; references are decoded, blank nodes dropped, nodes joined by a space.
@query("visible_text_cases", "i, visible, plain", [
    (0, "<b> a & b", "a & b x"), (1, "one two", "one two"), (2, "", ""), (3, "é ", "é"), (4, "a b", "p{} a b"),
])
def visible_text_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = ["&lt;b&gt; a &amp; b<script>x</script>", "<p>one</p>\n <p>two</p><!-- no -->", None, "&eacute;&nbsp;", "<style>p{}</style><i>a</i><script></script><u>b</u>"]
    rows = table(spark, "i int, h string", *enumerate(pages))
    return rows.select("i", F.replace(T.visible_text(F.col("h")), F.lit(" "), F.lit(" ")).alias("visible"), T.strip_tags(F.col("h")).alias("plain"))


# Deny wins; with allow patterns one of them must occur.
@query("scope_filters", "url, scope", [(SITE + "/a", "internal"), (SITE + "/a/private", "external"), (SITE + "/b", "external"), ("https://else.example.net/a", "external")])
def scope_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, "target string", (SITE + "/a",), (SITE + "/a/private",), (SITE + "/b",), ("https://else.example.net/a",))
    return extract.mark_scope(rows, "site.example.com", allow=["/a"], deny=["private"]).select(F.col("target").alias("url"), "scope")


# A script of the crawl's host is scanned, one of another host is an external link.
@query("script_routes", "dataset, value", [("scripts", SITE + "/a.js"), ("external", "https://cdn.example.net/b.js")])
def script_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.route_scripts(table(spark, "script string", (SITE + "/a.js",), ("https://cdn.example.net/b.js",), (SITE + "/a.js",)), "site.example.com")


# Each of the thirteen sections once or more: an entry may stand in several (/login/admin in two; the archive in one as it is nowhere alive).
_ANATOMY = (
    ("internal", SITE + "/login"), ("internal", SITE + "/admin"), ("internal", SITE + "/api/x"), ("internal", SITE + "/old/x"), ("files", SITE + "/r.pdf"), ("files", SITE + "/s.css"), ("scripts", SITE + "/a.js"),
    ("forms", "action=/submit method=POST inputs=q:text"), ("external", "https://www.google-analytics.com/x"), ("external", "https://d1.cloudfront.net/x"), ("external", "https://github.com/a"), ("external", "https://else.example.net/"),
    ("failed", SITE + "/gone"), ("skipped", SITE + "/big.zip"), ("archived", SITE + "/was"), ("archived", SITE + "/login"), ("endpoints", "/v9/items"),
)


@query("anatomy_sections", "line", [(f"section={section} value={value}",) for section, value in [
    ("auth_surfaces", SITE + "/login"), ("auth_surfaces", "/submit"), ("admin_ish_routes", SITE + "/admin"), ("apis", SITE + "/api/x"), ("apis", "/v9/items"), ("old_paths", SITE + "/old/x"), ("docs", SITE + "/r.pdf"), ("static_assets", SITE + "/s.css"),
    ("static_assets", SITE + "/a.js"), ("forms", "action=/submit method=POST inputs=q:text"), ("analytics", "https://www.google-analytics.com/x"), ("cdn_assets", "https://d1.cloudfront.net/x"), ("trust_links", "https://github.com/a"),
    ("external_refs", "https://else.example.net/"), ("dead_ends", SITE + "/gone"), ("dead_ends", SITE + "/big.zip"), ("archive_only_paths", SITE + "/was"),
]])
def anatomy_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.anatomy_lines(analysis.site_anatomy(table(spark, "dataset string, value string", *_ANATOMY), SITE + "/"))


# An administration page gives four neighbours; 70 login-like pages in all but these give the same six addresses once. The limit cuts.
@query("probe_lines", "line", [(f"probe={SITE}/{p} source={SITE}/admin reason=admin-neighbor",) for p in ("login", "admin/login", "dashboard")])
def probe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.probe_lines(analysis.mutation_probes(table(spark, "dataset string, ord bigint, value string", ("internal", 1, SITE + "/admin")), SITE + "/", limit=3))


# --- fetching -------------------------------------------------------------------------------


# Statuses 429 and 5xx are asked again three times at most; what then stands counts. Binary names are never asked for.
@query("fetch_outcomes_of_retries", "url, attempts, status_code, body, state, error_kind", [
    (SITE + "/ok", 1, 200, "1 yes", "completed", None), (SITE + "/flaky", 2, 200, "2 yes", "completed", None), (SITE + "/down", 4, 500, "", "failed", "server-error"), (SITE + "/lost", 4, None, None, "failed", "timeout"),
    (SITE + "/moved", 1, 200, "1", "completed", None), (SITE + "/a.png", 0, None, None, "skipped", "binary-extension"),
])
def fetch_outcomes_of_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.dataSource.register(fetch.FetchSource)
    urls = [SITE + p for p in ("/ok", "/flaky", "/down", "/lost", "/moved", "/a.png")]
    options = {"urls": json.dumps(urls), "fetcher": "tests.scripted_answers:scripted", "headers": json.dumps({"X-Crawl": "yes"}), "backoff": "0"}
    listed = spark.read.format("crawl_fetch").options(**options).load()
    got = fetch.fetch_pages(table(spark, "url string", *((u,) for u in urls)), options).intersect(listed)  # both ways give the same rows
    return crawl.fetch_outcome(got.withColumn("purpose", F.lit("page"))).select("url", "attempts", "status_code", "body", "state", "error_kind")


# Rendered bodies stand in for fetched ones unless empty; the addresses that rendering met are links of the page.
_RENDERED = ((SITE + "/a", "<p>made</p>", SITE + "/a#x", [SITE + "/x", SITE + "/x", SITE + "/y"]), (SITE + "/b", "", SITE + "/b", []))


@query("rendered_views", "url, html, targets", [(SITE + "/a", "<p>made</p>", 2), (SITE + "/b", "<p>plain</p>", 0), (SITE + "/c", "<p>c</p>", 0)])
def rendered_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, "url string, html string, final_url string, urls array<string>", *_RENDERED)
    pages = runs.rendered_pages(table(spark, "url string, html string", (SITE + "/a", "<p>raw</p>"), (SITE + "/b", "<p>plain</p>"), (SITE + "/c", "<p>c</p>")), made)
    met = runs.rendered_links(made).groupBy("url").agg(F.count("*").alias("n"))
    return pages.join(met, "url", "left").select("url", "html", F.coalesce("n", F.lit(0)).alias("targets"))


@query("rendered_proofs", "url, final_url, urls, digest", [(SITE + "/a", SITE + "/a#x", 3, 64), (SITE + "/b", None, 0, 64)])
def rendered_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = runs.rendered_evidence(table(spark, "url string, html string, final_url string, urls array<string>", *_RENDERED))
    said = lambda k: F.get_json_object("evidence", f"$.{k}")
    return told.select("url", said("final_url").alias("final_url"), said("urls").cast("int").alias("urls"), F.length(said("dom_sha256")).alias("digest"))


# Seven exception classes have kinds of their own; invalid schemas are invalid addresses, proxies and connections are blocked.
@query("exception_kinds", "name, kind", [
    ("Timeout", "timeout"), ("ConnectTimeout", "timeout"), ("SSLError", "ssl"), ("InvalidURL", "invalid-url"), ("InvalidSchema", "invalid-url"), ("ProxyError", "blocked"), ("ConnectionError", "blocked"), ("ChunkedEncodingError", "request-error"),
])
def exception_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("Timeout", "ConnectTimeout", "SSLError", "InvalidURL", "InvalidSchema", "ProxyError", "ConnectionError", "ChunkedEncodingError")
    return table(spark, "name string", *((n,) for n in names)).select("name", T.classify_request_error(F.col("name")).alias("kind"))


@query("proxy_lists", "i, proxies", [(0, "http://a:1|http://b:2"), (1, "")])
def proxy_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, "i int, raw string", (0, " a:1, ,b:2"), (1, None)).select("i", F.array_join(T.proxy_addresses(F.col("raw")), "|").alias("proxies"))


@query("clean_lines", "line, channels", [("Drained 200", "logs,feed"), ("x", "logs")])
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, "line string", ("\x1b[31mDrained 200\x1b[0m\r",), ("  x ",), ("\x1b[0m",))
    return control.log_lines(rows).select("line", F.array_join("channels", ",").alias("channels"))


# --- seeds ----------------------------------------------------------------------------------


# The three newest of four indexes are asked, 200 entries of each; the page index collapses by its key. The star of a subdomain stays.
@query("archive_requests", "target, index, address", [
    (t, index, address) for t in ("a.com", "*.a.com") for index, address in [
        ("", f"https://web.archive.org/cdx/search/cdx?url={t}%2F*&output=text&fl=original&collapse=urlkey&limit=200"),
        *((i, f"https://index.commoncrawl.org/{i}-index?url={t}%2F*&output=json&limit=200") for i in ("C-2024-30", "C-2024-20", "C-2024-10")),
    ]
])
def archive_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, "id string", ("C-2023-50",), ("C-2024-30",), ("",), ("C-2024-10",), ("C-2024-20",))
    return seeds.archive_requests(table(spark, "target string", ("a.com",), ("*.a.com",)), listed)


# All registered providers that have input are run; a seed that two tell is one.
@query("harvested_seeds", "url, providers", [(SITE + "/a", "archives,robots"), (SITE + "/p", "sitemaps"), (SITE + "/z", "archives")])
def harvested_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    robots = table(spark, "url string, body string", (SITE, "User-agent: *\nDisallow: /a\nDisallow: /c*\n"))
    maps = table(spark, "url string, body string", (SITE + "/map.xml", '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>/p</loc></url></urlset>'))
    found = seeds.harvest_seeds({"robots": (robots,), "sitemaps": (maps, table(spark, "url string", (SITE + "/map.xml",))), "archives": (table(spark, "line string", (SITE + "/a",), (SITE + "/z",)),)})
    return found.select("url", F.array_join("providers", ",").alias("providers"))


@query("merged_seeds", "url", [("a",), ("b",), ("c",)])
def merged_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.merge_seeds(table(spark, "url string", ("a",), ("b",)), table(spark, "url string, depth int", ("b", 1), ("c", 0)), table(spark, "url string", ("a",)))


# Thirty nested sitemaps in a chain: 25 are read, the first at depth 0, so the last page that is found is at depth 24.
@query("sitemap_bound", "pages, deepest", [(25, 24)])
def sitemap_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    nested = [(f"{SITE}/m{k}.xml", f"<sitemapindex {ns}><sitemap><loc>/m{k + 1}.xml</loc></sitemap></sitemapindex>") for k in range(30)]
    # A body is an index or a list of pages; text that is no XML lists its lines.
    lists = [(f"{SITE}/m{k}.xml", f"<urlset {ns}><url><loc>/p{k}</loc></url></urlset>") for k in range(30)]
    found = seeds.sitemap_urls(table(spark, "url string, body string", *nested, *lists), table(spark, "url string", (SITE + "/m0.xml",)))
    return found.agg(F.count("*").alias("pages"), F.max("depth").alias("deepest"))


# --- files ----------------------------------------------------------------------------------


def _written(spark: SparkSession, name: str, *texts: str) -> str:
    """A folder with one text file for each of the texts."""
    folder = f"{crawl.scratch_folder(spark)}/{name}"
    table(spark, "i int, value string", *enumerate(texts)).repartitionByRange(len(texts), "i").select("value").write.text(folder)
    return folder


@query("local_specimens", "kind, n, chars", [("binary", 2, 12), ("inline", 1, 4), ("lines", 3, 8), ("script", 2, 12)])
def local_specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files, "ab\\n \\ncde\\n" and "xyz\\n" as written: whole scripts and binaries keep all signs, lines drop the blank one."""
    folder = _written(spark, "specimens", "ab\n\ncde", "xyz")
    rows = [
        ("binary", readers.document_files(spark, folder).select(F.length("content").alias("n"))),
        ("inline", readers.inline_page(spark, "<p/>").select(F.length("html").alias("n"))), ("lines", readers.text_lines(spark, folder).select(F.length("value").alias("n"))), ("script", readers.script_files(spark, folder).select(F.length("body").alias("n"))),
    ]
    out = None
    for kind, df in rows:
        one = df.where("n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("chars")).select(F.lit(kind).alias("kind"), "n", "chars")
        out = one if out is None else out.unionByName(one)
    return out


# Sets in order, lists in theirs; an empty dataset has no file.
@query("text_export", "dataset, i, value", [("files", 0, "a"), ("files", 1, "b"), ("steps", 0, "z"), ("steps", 1, "y")])
def text_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{crawl.scratch_folder(spark)}/texts"
    data = {"files": table(spark, "value string", ("b",), ("a",)), "steps": table(spark, "value string, ord int", ("z", 1), ("y", 2)), "none": table(spark, "value string", ("x",)).where("false")}
    out = None
    for name in sinks.write_text(data, folder):
        lines = spark.read.text(f"{folder}/{name}", wholetext=True).where("value != ''").select(F.lit(name).alias("dataset"), F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("i", "value"))
        out = lines if out is None else out.unionByName(lines)
    return out


@query("json_export", "category, value", [("files", "a"), ("files", "b")])
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{crawl.scratch_folder(spark)}/results.json"
    sinks.write_json({"files": table(spark, "value string", ("b",), ("a",))}, path)
    return spark.read.schema("category string, value string").json(path)


# The digest of "a\n" and its two bytes.
@query("run_manifest", "files, sha256, size", [(1, "87428fc522803d31065e7bce3cf03fe475096631e5e07bbd7a0fde60c4cf25c7", 2)])
def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sinks.manifest(spark, _written(spark, "manifest", "a"), {"id": 1})
    return made.select(F.expr("filter(files, f -> f.size > 0)").alias("f")).select(F.size("f").alias("files"), F.col("f")[0]["sha256"].alias("sha256"), F.col("f")[0]["size"].alias("size"))


@query("checkpoint_tables", "url, depth", [("u", 1), ("v", 2)])
def checkpoint_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{crawl.scratch_folder(spark)}/checkpoint"
    sinks.save_checkpoint({"records": table(spark, "url string, depth int", ("u", 1), ("v", 2))}, folder)
    return sinks.load_checkpoint(spark, folder)["records"]


@query("printed_dataset", "i, line", [(0, "failures=1"), (1, "visited=3")])
def printed_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sinks.selected({"stats": table(spark, "key string, value int", ("visited", 3), ("failures", 1))}, "stats")
    return lines.coalesce(1).select(F.monotonically_increasing_id().cast("int").alias("i"), "line")


@query("event_lines", "line", [('[EVENT]{"type":"queue","payload":{"n":1}}',)])
def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.event_lines(table(spark, "type string, payload string", ("queue", '{"n": 1}')))


# --- runs -----------------------------------------------------------------------------------

# r1 has text files; r2 has none, so its checkpoint's lists count; r1's checkpoint does not.
_FINDINGS = (
    ("r1", "internal", SITE + "/a"), ("r1", "internal", SITE + "/b"), ("r1", "files", SITE + "/r.PDF"), ("r1", "files", SITE + "/x.zip"), ("r1", "intel", SITE + ":EMAIL:a@b.co"), ("r1", "intel", SITE + ":PHONE:555"), ("r1", "scripts", SITE + "/a.js"),
    ("r1", "failed", SITE + "/gone"), ("r1", "forms", "action=/x method=GET inputs="),
)
_CHECKPOINTED = (("r1", "internal", "old"), ("r2", "internal", SITE + "/c"), ("r2", "failed", SITE + "/d"))
_STATS = (("r1", "visited", 7), ("r1", "failures", 3), ("r1", "skipped", 1))


def _artifacts(spark: SparkSession) -> DataFrame:
    return runs.run_artifacts(table(spark, "run_id string, name string, value string", *_FINDINGS), table(spark, "run_id string, name string, value string", *_CHECKPOINTED)).withColumnRenamed("name", "dataset")


def _stats(spark: SparkSession) -> DataFrame:
    return table(spark, "run_id string, key string, value bigint", *_STATS)


@query("run_artifacts", "run_id, dataset, value", [*_FINDINGS, *_CHECKPOINTED[1:]])
def run_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _artifacts(spark)


# Statistics say how many were visited and failed; without them none was visited and the failed ones are counted.
_COUNTS = [("r1", 7, 3, 2, 2, 1, 1, 1, 1), ("r2", 0, 1, 1, 0, 0, 0, 0, 1)]


@query("run_counts", "run_id, visited, failures, links, files, mail, scripts, documents, broken", _COUNTS)
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_counts(_artifacts(spark), _stats(spark))


# r2's records show three that ended, two of them failed or skipped; r1's show fewer than its statistics.
@query("live_counts", "run_id, visited, failures", [("r1", 7, 3), ("r2", 3, 2)])
def live_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, "run_id string, url string, state string", ("r1", "a", "completed"), ("r2", "a", "completed"), ("r2", "b", "failed"), ("r2", "c", "skipped"), ("r2", "d", "pending"))
    return runs.live_counts(runs.run_counts(_artifacts(spark), _stats(spark)), records).select("run_id", "visited", "failures")


# By mode: the panels in their order, without empty ones; the vitals list the statistics by key and stay when there are none.
@query("mode_panels", "mode, ord, panel, n, items", [
    ("generic", 3, "links", 2, f"{SITE}/a|{SITE}/b"), ("generic", 4, "mail", 1, SITE + ":EMAIL:a@b.co"), ("generic", 5, "documents", 1, SITE + "/r.PDF"), ("generic", 6, "relics", 2, f"{SITE}/r.PDF|{SITE}/x.zip"), ("generic", 7, "scripts", 1, SITE + "/a.js"),
    ("generic", 8, "broken", 1, SITE + "/gone"), ("generic", 9, "forms", 1, "action=/x method=GET inputs="), ("generic", 10, "vitals", 3, "failures=3|skipped=1|visited=7"),
    ("scam", 2, "links", 2, f"{SITE}/a|{SITE}/b"), ("scam", 3, "forms", 1, "action=/x method=GET inputs="), ("scam", 4, "vitals", 0, ""),
])
def mode_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, stats = _artifacts(spark).where("run_id = 'r1'"), _stats(spark)
    shown = lambda mode, s: runs.mode_panels(found, s, mode).select(F.lit(mode).alias("mode"), "ord", "panel", "n", F.array_join("items", "|").alias("items"))
    return shown("generic", stats).unionByName(shown("scam", stats.where("false")))


_RUNS = (
    ("r1", json.dumps({"target": {"main_url": SITE + "/", "mode": "news"}, "resolved_config": {"preset": "quick"}, "lineage": {"temporal_baseline": "r0"}}), '{"main_url": "no"}', None),
    ("r2", '{"target": {}}', json.dumps({"main_url": SITE + "/two", "mode": "geo", "queue_state": {"pending": [f"u{k:02d}" for k in range(14)], "active": []}, "robots_metadata": {"rules": [1, 2], "crawl_delay": 2.5}, "sitemap_metadata": {"sitemap_urls": ["m"], "queued_urls": None}}), '{"target_url": "no"}'),
    ("r3", "{broken", None, json.dumps({"target_url": SITE + "/three", "mode": "scam"})), ("r4", None, None, None),
)
_RUN_SCHEMA = "run_id string, manifest string, checkpoint string, history string"


# The manifest's target, else the checkpoint, else the history; presets and modes that nobody says are the defaults.
@query("saved_settings", "run_id, target, specimen, preset, mode, workflow, baseline", [
    ("r1", SITE + "/", SITE + "/", "quick", "news", "", "r0"), ("r2", SITE + "/two", SITE + "/two", "balanced", "geo", "", ""), ("r3", SITE + "/three", SITE + "/three", "balanced", "scam", "", ""), ("r4", "", "", "balanced", "generic", "", ""),
])
def saved_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.saved_settings(table(spark, _RUN_SCHEMA, *_RUNS))


# Twelve of fourteen waiting URLs are shown.
@query("checkpoint_queues", "run_id, queue, n, items", [("r2", "pending", 14, ",".join(f"u{k:02d}" for k in range(12))), ("r2", "active", 0, "")])
def checkpoint_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.checkpoint_queues(table(spark, _RUN_SCHEMA, *_RUNS)).select("run_id", "queue", "n", F.array_join("items", ",").alias("items"))


@query("checkpoint_seeds", "run_id, crawl_delay, rules, sitemap_urls, queued_urls", [("r1", None, 0, "", ""), ("r2", 2.5, 2, "m", "")])
def checkpoint_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.checkpoint_seeds(table(spark, _RUN_SCHEMA, *_RUNS[:2]))
    return found.select("run_id", "crawl_delay", "rules", F.array_join("sitemap_urls", ",").alias("sitemap_urls"), F.array_join("queued_urls", ",").alias("queued_urls"))


# A run without a status is complete if it has findings or statistics, else empty.
@query("browser_entries", "run_id, target, mode, status, ended_at, is_current, visited, failures, links, files", [
    ("r1", SITE + "/", "news", "complete", "2024-01-01", False, 7, 3, 2, 2), ("r2", SITE + "/two", "geo", "running", None, True, 0, 1, 1, 0), ("r4", "", "generic", "empty", None, False, 0, 0, 0, 0),
])
def browser_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, "run_id string, status string, started_at string, ended_at string, is_current boolean", ("r1", None, None, "2024-01-01", False), ("r2", "running", "x", None, True), ("r4", None, None, None, False))
    return runs.browser_entries(listed, runs.saved_settings(table(spark, _RUN_SCHEMA, *_RUNS)), runs.run_counts(_artifacts(spark), _stats(spark))).drop("started_at")


# b against a: one link more, one fewer, the count changed, the new artifact's fields changed from nothing (three of seven: the others are empty
# or zero and equal only where both say so). c has no snapshot, so it differs in nothing.
@query("run_diffs", "id, against, added, removed, changed, lines", [
    ("c", "b", 0, 0, 0, ""), ("b", "a", 1, 1, 1, "dataset=internal change=added value=y|dataset=internal change=removed value=x|dataset=stats metric=visited before=1 after=2"),
])
def run_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = table(spark, "url string, content_type string, sha256 string, size bigint, archive_presence boolean, first_seen string, last_seen string, title string", ("f", "text/css", "00", 1, False, "d", "d", ""))
    def snapshot(run: str, links: tuple[str, ...], visited: int) -> DataFrame:
        found = table(spark, "dataset string, value string", *(("internal", x) for x in links))
        types = table(spark, "content_type string, n bigint", ("text/html", 3))
        return runs.snapshot_leaves(found, table(spark, "key string, value bigint", ("visited", visited)), types, empty, {"mode": "generic"}).withColumn("run_id", F.lit(run))

    listed = table(spark, "id string, ended_at string", ("a", "2024-01-01"), ("b", "2024-01-02"), ("c", "2024-01-03"))
    found = runs.run_diffs(listed, snapshot("a", ("x", "z"), 1).unionByName(snapshot("b", ("y", "z"), 2)))
    return found.select("id", "against", "added", "removed", "changed", F.array_join("lines", "|").alias("lines"))


@query("snapshot_leaves", "path, kind, value", [
    ("internal", "item", "x"), ("stats/visited", "scalar", "1"), ("content_types/text/html", "scalar", "3"), ("snapshot_version", "scalar", "2"), ("report_metadata/mode", "scalar", "generic"),
    *((f"artifact_genealogy/f/{k}", "scalar", v) for k, v in (("content_type", "text/css"), ("sha256", "00"), ("size", "1"), ("archive_presence", "False"), ("first_seen", "d"), ("last_seen", "d"), ("title", ""))),
])
def snapshot_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, "url string, content_type string, sha256 string, size bigint, archive_presence boolean, first_seen string, last_seen string, title string", ("f", "text/css", "00", 1, False, "d", "d", ""))
    leaves = runs.snapshot_leaves(table(spark, "dataset string, value string", ("internal", "x")), table(spark, "key string, value bigint", ("visited", 1)), table(spark, "content_type string, n bigint", ("text/html", 3)), one, {"mode": "generic"})
    path = f"{crawl.scratch_folder(spark)}/snapshot"
    leaves.write.parquet(path)
    return spark.read.parquet(path).select(F.array_join("path", "/").alias("path"), "kind", "value")


# Failed before skipped, signals before trust links; twelve of thirteen probes.
@query("report_sections", "section, n, first, last", [("what_broke", 3, "b", "a"), ("what_looks_fake", 2, "s", "t"), ("worth_probing_next", 12, "p01", "p12")])
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, "dataset string, value string", ("failed", "b"), ("failed", "c"), ("skipped", "a"), ("trust_links", "t"), ("scam_signals", "s"), ("internal", "i"))
    rows = runs.report_sections(found, table(spark, "ord int, probe string", *((k, f"p{k:02d}") for k in range(1, 14))))
    return rows.groupBy("section").agg(F.count("*").alias("n"), F.min_by("value", "ord").alias("first"), F.max_by("value", "ord").alias("last"))


@query("exposure", "internal_links, forms, documents, apis, scripts", [(2, 1, 1, 0, 1)])
def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.exposure(table(spark, "dataset string, value string", ("internal", "a"), ("internal", "b"), ("forms", "f"), ("docs", "d"), ("scripts", "s"), ("files", "x")))


# Known ones by their discovery, others after by name.
@query("ordered_urls", "i, url", [(0, "c"), (1, "a"), (2, "b"), (3, "d")])
def ordered_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crawl.ordered_urls(table(spark, "url string", ("d",), ("a",), ("b",), ("c",), ("a",)), table(spark, "url string, discovery_time bigint, state string", ("a", 5, "completed"), ("c", 2, "failed")))
    return rows.coalesce(1).select(F.monotonically_increasing_id().cast("int").alias("i"), "url")


# The eight most frequent of nine types; of equals the first by name.
@query("top_content_types", "content_type, n", [("h", 9), ("a", 5), ("b", 5), ("c", 4), ("d", 4), ("e", 3), ("f", 2), ("g", 1)])
def top_content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.top_content_types(table(spark, "content_type string, n bigint", ("i", 1), ("g", 1), ("f", 2), ("e", 3), ("d", 4), ("c", 4), ("b", 5), ("a", 5), ("h", 9)))


_EIGHT = (
    ("internal", "a"), ("files", "r.pdf"), ("intel", "x:EMAIL:y"), ("failed", "f"), ("document_metadata", "m"), ("document_metadata", "n"), ("document_leaks", "l"), ("js_intel", "j"), ("scripts", "s"), ("threads", "t reply_to=p1"), ("threads", "t"),
    ("locations", "confidence=exact"), ("locations", "confidence=weak"), ("locations", "confidence=weak x"), ("stories", "x relation=page y"), ("stories", "x relation=mirror y"), ("stories", "x relation=mirror z"), ("hidden_paths", "h"), ("hidden_probe_sources", "p"),
    ("scam_signals", "signal=A x"), ("scam_signals", "signal=A y"), ("scam_signals", "signal=B z"), ("temporal_diffs", "d"),
)
_MODE_CARDS = {"document": (2, 1), "js-intel": (1, 1), "forum": (2, 1), "geo": (1, 2), "news": (1, 2), "hidden": (1, 1), "scam": (3, 2), "temporal": (1, 0), "generic": (1, 1)}


# The four common cards, then the mode's two in their order; of dark patterns the second counts different signals.
@query("mode_cards", "mode, i, value", [(mode, i, v) for mode, own in _MODE_CARDS.items() for i, v in enumerate((1, 1, 1, 1, *own))])
def mode_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, out = table(spark, "dataset string, value string", *_EIGHT), None
    for mode in _MODE_CARDS:
        cards = ledger.summary_cards(found, mode).coalesce(1).select(F.lit(mode).alias("mode"), F.monotonically_increasing_id().cast("int").alias("i"), "value")
        out = cards if out is None else out.unionByName(cards)
    return out


# Hosts as slugs, times in UTC; an evidence stem ends in twelve digits of the address's digest.
@query("output_names", "slug, folder, stem", [("site-example-com", "sealed-runs/20240102-030405-site-example-com-geo", "site-example-com-"), ("target", "sealed-runs/20240102-030405-specimen-geo", "rendered-page-")])
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, "url string", (SITE + "/a?b",), ("",))
    at = F.to_timestamp_ntz(F.lit("2024-01-02 03:04:05"))
    return rows.select(U.target_slug(F.col("url")).alias("slug"), U.run_folder(U.hostname(F.col("url")), F.lit("geo"), at).alias("folder"), F.regexp_replace(U.evidence_stem(F.col("url")), "[0-9a-f]{12}$", "").alias("stem"))


# Names that are unknown read as the default; depth and threads are one at least, and bounded over the web.
@query("coerced_settings", "i, mode, preset, workflow, depth, threads", [(0, "generic", "balanced", "domain_necropsy", 2, 4), (1, "geo", "polite", "js_bone_saw", 8, 32)])
def coerced_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = [control.web_bounds(control.RunSettings.from_mapping(raw)) for raw in ({"mode": "?", "preset": None, "workflow": "x", "depth": 0}, {"mode": "geo", "preset": "polite", "workflow": "js_bone_saw", "depth": 99, "threads": 99})]
    return table(spark, "i int, mode string, preset string, workflow string, depth int, threads int", *((i, s.mode, s.preset, s.workflow, s.depth, s.threads) for i, s in enumerate(got)))


# url, type, size, sixteen digits of the digest, title, three finders at most, duplicates, archive, first and last seen; a dash for nothing.
@query("genealogy_lines", "line", [
    ("url=u content_type=- size=0 sha256=- title=- found_on=a,b,c duplicates=0 archive=false first_seen=- last_seen=-",),
    (f"url=v content_type=text/css size=1 sha256={'ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb'[:16]} title=T found_on=- duplicates=1 archive=true first_seen=d1 last_seen=d2",),
    (f"url=w content_type=- size=1 sha256={'ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb'[:16]} title=- found_on=- duplicates=1 archive=false first_seen=- last_seen=-",),
])
def genealogy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, "url string, found_on string, source_kind string, note string", *(("u", x, "link", None) for x in "dcba"))
    seen = table(
        spark, "seq bigint, url string, content_type string, title string, metadata string, body binary, archive_presence boolean, redirect string, label string",
        (1, "v", "text/css", "T", None, b"a", True, None, "d1"), (2, "v", None, None, None, None, None, None, "d2"), (3, "w", None, None, None, b"a", None, None, None),
    )
    return analysis.genealogy_lines(analysis.genealogy(found, seen))


# Three pages are reached in steps; a walk resumed from what two levels found goes on where they ended.
@query("resumed_walk", "url, depth", [("a", 0), ("b", 1), ("c", 2), ("d", 3)])
def resumed_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, "src string, dst string", ("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"))
    half = crawl.walk(edges, table(spark, "url string", ("a",)), max_depth=1)
    return crawl.walk(edges, half, max_depth=3)


# A user's own pattern must compile before a run starts; what is wrong is told by name.
@query("pattern_problems", "name, ok", [("allow", True), ("deny", False), ("exclude", False), ("regex", True)])
def pattern_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = control.pattern_problems(spark, {"allow": ["/a", "b+"], "deny": ["("], "exclude": ["[z"], "regex": []})
    return table(spark, "name string, ok boolean", *((name, not found.get(name)) for name in ("allow", "deny", "exclude", "regex")))


# Every registered extractor is run on what it is for; the form's action and the script's source are both links.
@query("extractor_registry", "name, n", [("endpoints", 1), ("forms", 1), ("intel", 1), ("links", 2), ("script_references", 1)])
def extractor_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, "url string, html string", (SITE + "/", '<form action="/f"></form><script src="/s.js"></script> x@y.co'))
    found = extract.run_extractors(pages, table(spark, "url string, body string", (SITE + "/s.js", "'/v/x'")))
    wanted = found.where(F.col("extractor").isin("endpoints", "forms", "intel", "links", "script_references"))
    return wanted.groupBy(F.col("extractor").alias("name")).agg(F.countDistinct("row").alias("n"))


# Hops are trimmed of blanks and of nothing else.
@query("redirect_hops", "url, chain", [("http://a/", "http://x/0|http://y/1"), ("http://b/", "")])
def redirect_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, "line string", ("http://a/ => http://x/0 -> http://y/1 ",), ("http://b/",))
    return rows.select(T.parse_redirect(F.col("line")).alias("r")).select("r.url", F.array_join("r.chain", "|").alias("chain"))


# Scripts written inside a page, in its order; those that are empty, as of a source elsewhere, have no body.
@query("inline_script_bodies", "ord, body", [(0, "let a = 1;"), (2, "\nb()")])
def inline_script_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = '<script>let a = 1;</script><script src="/x.js"></script><SCRIPT type="module">\nb()</SCRIPT>'
    return extract.inline_scripts(table(spark, "url string, html string", (SITE + "/", page))).select("ord", "body")


# Thirteen sections of the anatomy and four others, each a heading, its items or what stands for none, and a gap; 20 of 25 documents are listed.
@query("report_markdown", "part, n, first, last", [
    (0, 3, "# Autopsy", "## Site anatomy"), (1, 3, "### Auth Surfaces", ""), (2, 22, "### Docs", ""), *((k, 3, f"### {title}", "") for k, title in enumerate([
        "Apis", "Forms", "Static Assets", "Admin Ish Routes", "Old Paths", "Analytics", "Cdn Assets", "External Refs", "Archive Only Paths", "Trust Links", "Dead Ends"], start=3)),
    (14, 4, "## What broke", ""), (15, 3, "## What changed", ""), (16, 3, "## What looks fake", ""), (17, 14, "## Worth probing next", ""),
])
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    anatomy = table(spark, "section string, value string", *(("docs", f"{SITE}/{k:02d}.pdf") for k in range(25)))
    found = table(spark, "dataset string, value string", ("failed", "a"), ("skipped", "b"))
    sections = runs.report_sections(found, table(spark, "ord int, probe string", *((k, f"p{k:02d}") for k in range(1, 14))))
    lines = runs.report_lines(["# Autopsy", ""], anatomy, sections)
    return lines.groupBy("part").agg(F.count("*").alias("n"), F.min_by("line", "ord").alias("first"), F.max_by("line", "ord").alias("last"))


# The lines of sections without items, and of the last one with some.
@query("report_items", "part, line", [(1, "- None observed"), (15, "- No temporal changes recorded"), (16, "- No strong fake signals recorded"), (17, "- p01")])
def report_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = runs.report_sections(table(spark, "dataset string, value string", ("failed", "a")), table(spark, "ord int, probe string", (1, "p01")))
    lines = runs.report_lines([], table(spark, "section string, value string", ("docs", "d")), sections)
    return lines.where("part IN (1, 15, 16, 17) AND ord = 1").select("part", "line")


# Of ninety members of an archive eighty are named, in its order; leaks are looked for in all of them.
@query("office_bound", "kind, n, last", [("email", 1, "late@x.org"), ("internal-path", 80, "word/079.xml")])
def office_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(90):
            z.writestr(f"word/{k:03d}.xml", "<w>late@x.org</w>" if k == 89 else "<w/>")
    found = extract.office_records(table(spark, "url string, content binary, content_type string", (SITE + "/p.docx", out.getvalue(), "")))
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.max("value").alias("last"))
