"""Cases over literal inputs: each function's rows must be those that its decorator states."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.functions import text as T
from gossamer.functions import urls as U
from gossamer.operators import analysis, crawl, extract, ledger
from gossamer.sources import readers, seeds, sinks
from gossamer.plans import control

QUERIES: dict = {}
SQL: dict[str, str] = {}

SITE = "https://site.example.com"


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def query(name: str, columns: str, rows: list[tuple]):
    """Registers a query with the rows that it must give."""

    def register(f):
        QUERIES[name] = f
        values = ", ".join("(" + ", ".join(_sql(v) for v in row) + ")" for row in rows)
        SQL[name] = f"SELECT * FROM (VALUES {values}) AS t({columns})"
        return f

    return register


def table(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


@query("url_cases", "i, canonical", [
    (0, "http://example.com/b/c?a=2&z=1"), (1, "http://example.com/x"), (2, "http://h.com/"), (3, "https://h.com:8443/"), (4, "mailto:a@b.c"), (5, "/foo"),
    (6, ""), (7, "http://h.com/?a=~%2A+x&b=&b=%C3%A9"), (8, None), (9, "http://h.com/a b|c"), (10, ""),
])
def url_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = ["HTTP://Example.COM/a/../b//c/?z=1&a=2#frag", "//example.com/x", "http://u:p@h.com:80/", "https://h.com:8443", "mailto:a@b.c", "foo", "http:///x", "http://h.com/?b&a=%7E*+x&b=%C3%A9", "http://h.com:abc/", "http://h.com/a b|c", "  "]
    return table(spark, "i int, u string", *enumerate(cases)).select("i", U.normalize_url(F.col("u")).alias("canonical"))


@query("url_resolve_cases", "i, canonical", [(0, "https://h.com/p?x=1"), (1, "https://h.com/a/c"), (2, "https://h.com/c"), (3, "https://h.com/a/b?q=2"), (4, "https://cdn.com/x.js"), (5, "https://h.com/a/b?x=1")])
def url_resolve_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = ["/p?x=1", "c", "../c", "?q=2", "//cdn.com/x.js", "#top"]
    return table(spark, "i int, u string", *enumerate(cases)).select("i", U.normalize_url(F.col("u"), F.lit("https://h.com/a/b?x=1")).alias("canonical"))


@query("domain_cases", "host, domain", [("a.b.example.co.uk", "example.co.uk"), ("example.com", "example.com"), ("x.y.foo.ck", "y.foo.ck"), ("www.ck", "www.ck"), ("1.2.3.4", "1.2.3.4"), ("localhost", "localhost")])
def domain_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.registered_domains(table(spark, "host string", ("a.b.example.co.uk",), ("example.com",), ("x.y.foo.ck",), ("www.ck",), ("1.2.3.4",), ("localhost",)))


@query("archive_targets", "raw, target", [("https://web.archive.org/web/2020/http://x.com/a", "http://x.com/a"), ("https://web.archive.org/cdx?url=http%3A%2F%2Fy.com", "http://y.com"), ("https://z.com/", "https://z.com/")])
def archive_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, "raw string", ("https://web.archive.org/web/2020/http://x.com/a",), ("https://web.archive.org/cdx?url=http%3A%2F%2Fy.com",), ("https://z.com/",))
    return rows.select("raw", U.original_archive_target(F.col("raw")).alias("target"))


_FORM_HTML = '<form action="/submit" method="post"><input name="email" type="EMAIL"><input type="x"><textarea name="body"></textarea></form><FORM><select name="pick"></select></FORM>'


@query("forms_extract", "ord, action, method, inputs", [(0, SITE + "/submit", "POST", "body:text,email:email"), (1, SITE + "/p", "GET", "pick:text")])
def forms_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.forms(table(spark, "url string, html string", (SITE + "/p", _FORM_HTML)))
    return found.select("ord", "action", "method", F.array_join("inputs", ",").alias("inputs"))


@query("form_lines", "line", [(f"action={SITE}/submit method=POST inputs=body:text,email:email",), (f"action={SITE}/p method=GET inputs=pick:text",)])
def form_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.form_lines(extract.forms(table(spark, "url string, html string", (SITE + "/p", _FORM_HTML))))


@query("script_references", "url, script", [(SITE + "/", SITE + "/app.js"), (SITE + "/", "https://cdn.example.net/lib.js")])
def script_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.script_references(table(spark, "url string, html string", (SITE + "/", '<script src="/app.js"></script>\n<script async src="https://cdn.example.net/lib.js"></script>')))


_THREAD = (
    '<title>Old &amp; new</title><div class="post"><span data-author="ann">x</span><a href="#p0">re</a>First &lt;b&gt; text</div>'
    '<li id="reply-2" data-parent="p1"><blockquote>said so</blockquote><b class="username">bob</b> Second</li><article class="comment">Third</article>'
)


@query("thread_posts", "thread, post, author, reply_to, quote", [("Old & new", 1, "ann", "p0", ""), ("Old & new", 2, "bob", "root", "said so"), ("Old & new", 3, "deleted-user", "root", "")])
def thread_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.threads(table(spark, "url string, html string", (SITE + "/t", _THREAD)))
    return found.select("thread", "post", "author", "reply_to", "quote")


@query("geo_records", "kind, confidence, source, label, lat, lon", [
    ("coordinate", "exact", "text", "coordinate", "51.5074", "-0.1278"), ("geotag", "high", "meta", "geo.position", "48.85", "2.35"),
    ("geotag", "high", "meta", "place:location:latitude+place:location:longitude", "40.1", "-70.2"), ("place", "medium", "meta", "Paris", None, None), ("place", "weak", "text", "New York", None, None),
])
def geo_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = (
        '<meta name="geo.position" content="48.85; 2.35"><meta name="geo.placename" content="Paris"><meta property="og:latitude" content="40.1">'
        '<meta property="og:longitude" content="-70.2"><p>Seen at 51.5074, -0.1278 and in New York, from Abc.</p>'
    )
    return extract.locations(table(spark, "url string, html string", (SITE + "/g", page))).drop("url")


@query("scam_signals", "signal, evidence", [("FAKE_URGENCY", "Act now"), ("LOW_STOCK", "only 3 left"), ("PRESSURE_PAYMENT", "gift card"), ("TRUST_CLONE", "verified seller")])
def scam_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.scam_signals(table(spark, "url string, html string", (SITE, "<p>Act now: <b>only 3 left</b>, pay by gift&nbsp;card or gift card to a verified seller</p>"))).drop("url")


@query("story_rows", "relation, value, refs", [("page", "Big news", 2), ("metadata", "", 2), ("mirror", "https://other.example.net/a", 2), ("reference", "https://site.example.com/b", 2), ("quote", "a quote of some length", 2)])
def story_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = '<html lang="en"><meta property="og:title" content="Big news"><a href="https://other.example.net/a">x</a><a href="https://site.example.com/b">y</a> "a quote of some length" '
    return extract.stories(table(spark, "url string, html string", (SITE + "/n", page))).select("relation", "value", "refs")


_SCRIPT = 'const betaFlag = true; config = {"a": 1}; path: "/home"; POST "/api/x"; fetch("https://h.com/api/v1"); view = "Main"; process.env.KEY_A; throw new Error("went wrong"); // a comment here\n//# sourceMappingURL=app.js.map\ntoken: "abcdef123"'


@query("js_intel_rows", "kind, name, value", [
    ("feature", "betaFlag", "true"), ("config", "config", '{"a": 1}'), ("route", None, "/home"), ("api", "POST", "/api/x"), ("api_url", None, "https://h.com/api/v1"), ("view", None, "Main"),
    ("env_hint", None, "process.env.KEY_A"), ("token", "token", "abcdef123"), ("comment", None, "h.com/api/v1\"); view = \"Main\"; process.env.KEY_A; throw new Error(\"went wrong\"); a comment here"), ("comment", None, "# sourceMappingURL=app.js.map"),
])
def js_intel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.js_intel(table(spark, "url string, body string", (SITE + "/app.js", _SCRIPT))).where("kind != 'error_hint'").drop("url")


@query("script_endpoints", "endpoint", [("/home",), ("/api/x",), ("https://h.com/api/v1",)])
def script_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.endpoints(table(spark, "url string, body string", (SITE + "/app.js", _SCRIPT))).select("endpoint")


@query("script_artifact_rows", "kind, value", [("file", SITE + "/app.js.map"), ("link", SITE + "/home"), ("endpoint", "/api/x"), ("link", SITE + "/api/x"), ("endpoint", "/api/v1"), ("link", "https://h.com/api/v1")])
def script_artifact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.script_artifacts(table(spark, "url string, body string", (SITE + "/app.js", _SCRIPT))).select("kind", "value")


@query("secret_tokens", "kind, token", [("AWS_ACCESS_KEY_ID", "AKIA"), ("GITHUB_TOKEN", "ghp_" + "a1" * 18), ("PRIVATE_KEY", "-----BEGIN RSA PRIVATE KEY-----")])
def secret_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "AKIA" + "ABCD1234" * 2 + " ghp_" + "a1" * 18 + " -----BEGIN RSA PRIVATE KEY-----"
    return extract.secrets(table(spark, "url string, body string", (SITE, body))).where("reported").select("kind", "token")


@query("custom_regex", "match", [("a, 1",), ("b, 2",)])
def custom_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.custom_matches(table(spark, "url string, html string", (SITE, "a=1 b=2 a=1")), "([a-z])=([0-9])").select("match")


def _office() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("docProps/core.xml", '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Plan</dc:title><dc:creator>Eve</dc:creator></cp:coreProperties>')
        z.writestr("word/document.xml", "<w>mail eve@x.org at /home/eve/plan</w>")
    return out.getvalue()


@query("document_metadata", "record, kind, value", [
    ("metadata", "title", "Report"), ("metadata", "author", "Ann"), ("leak", "email", "ann@x.org"), ("leak", "path", "C:\\Users\\ann\\a.doc"), ("metadata", "author", "Bob"),
    ("leak", "internal-path", "docProps/core.xml"), ("leak", "internal-path", "word/document.xml"), ("metadata", "title", "Plan"), ("metadata", "author", "Eve"), ("leak", "email", "eve@x.org"), ("leak", "path", "/home/eve/plan"),
])
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(
        spark, "url string, content binary, content_type string",
        (SITE + "/r.pdf", rb"%PDF /Title (Report) /Author (Ann) ann@x.org C:\Users\ann\a.doc " + b"\xe9", "application/pdf"), (SITE + "/o.doc", b"Author: Bob\n", ""), (SITE + "/p.docx", _office(), ""), (SITE + "/bad.docx", b"PK broken", ""),
    )
    return extract.harvest_documents(docs.select("url"), docs).select("record", "kind", "value")


_ROBOTS = "User-agent: other\nDisallow: /no\n\nUser-agent: *\nDisallow: /a # why\nAllow: /b\nCrawl-delay: 2\n\nSitemap: https://site.example.com/map.xml\nUser-agent: *\nDisallow: /a\nDisallow: /c*\nCrawl-delay: 3\n"


@query("robots_rules", "ord, directive, path, crawl_delay", [(1, "DISALLOW", "/a", 3.0), (2, "ALLOW", "/b", 3.0), (3, "DISALLOW", "/c*", 3.0)])
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.robots_rules(table(spark, "url string, body string", (SITE, _ROBOTS))).drop("url")


@query("robots_agent_rules", "directive, path", [("DISALLOW", "/mine")])
def robots_agent_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "User-agent: *\nDisallow: /all\n\nUser-agent: gossamer\nUser-agent: x\nDisallow: /mine\nUser-agent: zzz\nDisallow: /z\n"
    return seeds.robots_rules(table(spark, "url string, body string", (SITE, body))).select("directive", "path")


@query("robots_seeds", "seed", [(SITE + "/a",), (SITE + "/b",)])
def robots_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.robots_seeds(table(spark, "url string, body string", (SITE, _ROBOTS))).select("seed")


@query("robots_dataset", "value", [("/a",), ("/b",), ("/c*",), (SITE + "/map.xml",)])
def robots_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.robots_dataset(table(spark, "url string, body string", (SITE, _ROBOTS))).select("value")


@query("sitemap_urls", "url, depth", [(SITE + "/p1", 1), (SITE + "/p2", 2), (SITE + "/t", 0)])
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    bodies = table(
        spark, "url string, body string",
        (SITE + "/map.xml", f"<sitemapindex {ns}><sitemap><loc>{SITE}/one.xml</loc></sitemap><sitemap><loc>{SITE}/map.xml</loc></sitemap></sitemapindex>"),
        (SITE + "/one.xml", f"<urlset {ns}><url><loc> /p1 </loc></url></urlset>"), (SITE + "/list.txt", f"{SITE}/t\n"), (SITE + "/unlinked.xml", f"<urlset {ns}><url><loc>/x</loc></url></urlset>"),
        (SITE + "/index2.xml", f"<sitemapindex {ns}><sitemap><loc>{SITE}/map2.xml</loc></sitemap></sitemapindex>"), (SITE + "/map2.xml", f"<sitemapindex {ns}><sitemap><loc>{SITE}/two.xml</loc></sitemap></sitemapindex>"), (SITE + "/two.xml", f"<urlset {ns}><url><loc>/p2</loc></url></urlset>"),
    )
    return seeds.sitemap_urls(bodies, table(spark, "url string", (SITE + "/map.xml",), (SITE + "/list.txt",), (SITE + "/index2.xml",)))


@query("archive_urls", "url", [("http://a.com/x",), ("http://b.com/",)])
def archive_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.archive_urls(table(spark, "line string", ("http://a.com/x",), ('{"url": "http://a.com:80/x/"}',), ("{broken",), ("",), ("http://b.com",)))


@query("archive_queries", "ord, target", [(0, "www.a.com"), (1, "a.com"), (2, "*.a.com")])
def archive_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.archive_targets(table(spark, "host string, domain string", ("www.a.com", "a.com"))).select("ord", "target")


@query("input_kinds", "raw, kind, confidence", [
    ("https://web.archive.org/web/x", "archived_url", 0.95), ("https://a.com/404", "dead_url", 0.75), ("https://a.com/sitemap.xml", "sitemap", 0.95), ("https://a.com/r.pdf", "pdf", 0.95), ("https://a.com/x.js", "js", 0.95),
    ("https://a.com/", "url", 0.95), ("example.com", "domain", 0.95), ("@ann", "handle", 0.7), ("Acme Corp", "company", 0.6), ("<html><body>", "html", 0.95), ("/tmp/a.js", "js", 0.95), ("thing", "company", 0.6),
])
def input_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = ["https://web.archive.org/web/x", "https://a.com/404", "https://a.com/sitemap.xml", "https://a.com/r.pdf", "https://a.com/x.js", "https://a.com/", "example.com", "@ann", "Acme Corp", "<html><body>", "/tmp/a.js", "thing"]
    return analysis.classify_inputs(table(spark, "raw string, explicit string", *[(r, None) for r in raw]))


_ENTRIES = (("internal", 1, SITE + "/login"), ("files", 1, SITE + "/docs/report-2024.pdf"), ("forms", 1, "action=/submit method=POST inputs=password:password"), ("endpoints", 1, "/api/me"))


# Forms give six probes of the site. The login page gives the same six addresses, which stay with the forms. The document of
# 2024 gives the two years before and twelve affixed names, in the order of the affixes. /api/me is neither login nor admin.
_DOCUMENT_PROBES = ["report-2022", "report-2023"] + [name for affix in ("draft", "backup", "old", "final", "en", "fr") for name in (f"report-2024-{affix}", f"{affix}-report-2024")]


@query("mutation_probes", "ord, probe, source, reason", [
    *((i + 1, SITE + path, SITE, reason) for i, (path, reason) in enumerate([
        ("/admin", "form-neighbor"), ("/dashboard", "form-neighbor"), ("/api/login", "form-auth-api"), ("/old-login", "form-legacy-auth"), ("/signin", "form-auth-alias"), ("/auth/callback", "form-auth-callback"),
    ])), *((i + 7, f"{SITE}/docs/{name}.pdf", SITE + "/docs/report-2024.pdf", "document-mutation") for i, name in enumerate(_DOCUMENT_PROBES)),
])
def mutation_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.mutation_probes(table(spark, "dataset string, ord bigint, value string", *_ENTRIES), SITE + "/")


@query("genealogy", "url, found_on, source_kinds, content_type, n_duplicates, first_seen, last_seen", [
    ("http://a/x.pdf", "http://a/,http://b/", "linked-file", "application/pdf", 1, "d1", "d2"), ("http://a/y.pdf", "", "", "", 1, "d1", "d1"), ("http://a/z.js", "http://a/", "script-reference", "", 0, "", ""),
])
def genealogy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, "url string, found_on string, source_kind string, note string", ("http://a/x.pdf", "http://b/", "linked-file", None), ("http://a/x.pdf", "http://a/", "linked-file", "n"), ("http://a/z.js", "http://a/", "script-reference", ""))
    seen = table(
        spark, "seq bigint, url string, content_type string, title string, metadata string, body binary, archive_presence boolean, redirect string, label string",
        (1, "http://a/x.pdf", "text/plain", "", None, b"same", None, None, "d1"), (2, "http://a/x.pdf", "application/pdf", None, "m", None, True, None, "d2"), (1, "http://a/y.pdf", "", "", None, b"same", None, None, "d1"),
    )
    rows = analysis.genealogy(found, seen)
    return rows.select("url", F.array_join("found_on", ",").alias("found_on"), F.array_join("source_kinds", ",").alias("source_kinds"), "content_type", "n_duplicates", "first_seen", "last_seen")


@query("snapshot_diff_lines", "line", [
    ("dataset=internal change=added value=http://a/2",), ("dataset=internal change=removed value=http://a/0",), ("dataset=stats metric=visited before=1 after=2",), ("dataset=anatomy item=docs change=added value=d.pdf",), ("dataset=meta item=run field=id before=None after=7",),
])
def snapshot_diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, "doc string", ('{"internal": ["http://a/0", "http://a/1"], "stats": {"visited": 1, "same": 3}, "anatomy": {"docs": []}}',))
    new = table(spark, "doc string", ('{"internal": ["http://a/1", "http://a/2"], "stats": {"visited": 2, "same": 3}, "anatomy": {"docs": ["d.pdf"]}, "meta": {"run": {"id": 7}}}',))
    return analysis.diff_lines(analysis.snapshot_diff(analysis.flatten_snapshot(old), analysis.flatten_snapshot(new)))


_RESPONSES = (
    (SITE + "/a", "page", 200, "text/html; charset=utf-8", "x", "", ["http://old/"], SITE + "/a"), (SITE + "/b.png", "page", None, "", None, "", [], None), (SITE + "/c", "page", 403, "text/html", "x", "", [], None), (SITE + "/d", "page", 500, "", "", "", [], None),
    (SITE + "/e", "page", None, "", None, "ReadTimeout", [], None), (SITE + "/f", "page", 200, "application/pdf", "x", "", [], None), (SITE + "/g", "page", 200, "text/html", " ", "", [], None), (SITE + "/h", "script", 200, "text/css", "x", "", [], None),
)


def _outcomes(spark: SparkSession) -> DataFrame:
    schema = "url string, purpose string, status_code int, content_type string, body string, error string, redirect_chain array<string>, final_url string"
    return crawl.fetch_outcome(table(spark, schema, *_RESPONSES))


@query("fetch_outcomes", "url, state, skip_reason, error_kind", [
    (SITE + "/a", "completed", None, None), (SITE + "/b.png", "skipped", "binary-extension", "binary-extension"), (SITE + "/c", "failed", None, "blocked"), (SITE + "/d", "failed", None, "server-error"), (SITE + "/e", "failed", None, "timeout"),
    (SITE + "/f", "skipped", "binary-content", "binary-content"), (SITE + "/g", "skipped", "empty-response", "empty-response"), (SITE + "/h", "skipped", "content-type:text/css", "unsupported-content-type"),
])
def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark).select("url", "state", "skip_reason", "error_kind")


@query("crawl_counters", "requests, redirects, failures, client_errors, server_errors, skipped, markup_pages", [(7, 1, 3, 1, 1, 4, 1)])
def crawl_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.crawl_counters(_outcomes(spark)).select("requests", "redirects", "failures", "client_errors", "server_errors", "skipped", "markup_pages")


@query("redirect_lines", "line", [(f"{SITE}/a => http://old/ -> {SITE}/a",)])
def redirect_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.redirect_lines(_outcomes(spark))


@query("log_channels", "line, channels", [("Internal page: x", "logs,feed"), ("Could not open", "logs,errors"), ("plain", "logs")])
def log_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, "line string", ("Internal page: x",), ("Could not open",), ("plain",)).select("line", F.array_join(T.log_channels(F.col("line")), ",").alias("channels"))


@query("scalar_functions", "i, entropy, luhn, slug, words, token", [(0, 1.0, True, "ab-ab", "a,b", "adm.in"), (1, 0.0, False, "4111111111111112", "4111111111111112", "4111111111111112")])
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, "i int, e string, n string, s string, w string, t string", (0, "abab", "4111 1111 1111 1111", "--Ab  Ab!", "A, b a", ".Adm.in."), (1, "", "4111111111111112", "4111111111111112", "4111111111111112", "4111111111111112"))
    return rows.select("i", T.entropy(F.col("e")).alias("entropy"), T.luhn(F.col("n")).alias("luhn"), U.slug(F.col("s")).alias("slug"), F.array_join(T.word_list(F.col("w")), ",").alias("words"), T.hidden_token(F.col("t")).alias("token"))


@query("retry_after", "i, seconds", [(0, 2.0), (1, 60.0), (2, 0.0), (3, None)])
def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, "i int, v string", (0, "2"), (1, "Mon, 01 Jan 2024 00:01:00 GMT"), (2, "-5"), (3, "soon"))
    return rows.select("i", T.retry_after_seconds(F.col("v"), F.to_timestamp_ltz(F.lit("2024-01-01 00:00:00+00:00"))).alias("seconds"))


@query("http_headers", "i, value", [(0, "text/html"), (1, "b")])
def http_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, "i int, raw string", (0, "Accept: text/html\nX-A: b"), (1, "Accept: b"))
    return rows.select("i", F.element_at(T.parse_headers(F.col("raw")), "Accept").alias("value"))


@query("cookie_pairs", "name, value", [("a", "1"), ("b", "x=y")])
def cookie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, "c string", ("a=1; b=x=y; junk; =z",)).select(F.explode(T.cookies(F.col("c"))).alias("c")).select("c.*")


@query("stats_lines", "key, kind, value", [("visited", "int", "3"), ("rate", "double", "1.5"), ("mode", "text", "geo")])
def stats_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.stats_lines(table(spark, "value string", ("visited=3",), ("rate=1.5",), ("mode=geo",), ("junk",)))
    kind = F.when(F.col("int").isNotNull(), "int").when(F.col("double").isNotNull(), "double").otherwise("text")
    return rows.select("key", kind.alias("kind"), F.coalesce(F.col("int").cast("string"), F.col("double").cast("string"), "text").alias("value"))


@query("json_objects", "n", [(1,)])
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.json_lines(table(spark, "value string", ('{"a": 1}',), ("[1]",), ("{bad",))).agg(F.count("*").alias("n"))


@query("source_precedence", "name, value", [("internal", "new"), ("files", "text")])
def source_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.with_precedence(table(spark, "name string, value string", ("internal", "new")), table(spark, "name string, value string", ("internal", "old"), ("files", "text")))


@query("long_export", "category, value", [("files", "a"), ("files", "b"), ("stats", "visited=3")])
def long_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.long_form({"files": table(spark, "value string", ("b",), ("a",))}, {"stats": table(spark, "key string, value int", ("visited", 3))}).select("category", "value")


@query("run_list", "id, against", [("r3", "r2"), ("r2", "r1"), ("r1", None)])
def run_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, "id string, source int, is_current boolean, ended_at string", ("r1", 1, False, "2024-01-01"), ("r3", 0, True, "2024-01-03"), ("r3", 1, False, "2024-01-03"), ("r2", 1, False, "2024-01-02"))
    return ledger.older_run(ledger.list_runs(runs))


@query("subdomain_candidates", "n, first", [(20, "admin.a.com")])
def subdomain_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.subdomain_candidates(table(spark, "domain string", ("a.com",))).agg(F.count("*").alias("n"), F.min("candidate").alias("first"))


@query("autopsy_report", "urls, completed, failed, skipped, datasets", [(3, 1, 1, 1, 2)])
def autopsy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, "url string, state string", ("a", "completed"), ("b", "failed"), ("c", "skipped"))
    found = table(spark, "dataset string, value string", ("internal", "a"), ("files", "b"))
    report = ledger.autopsy_report(records, found, table(spark, "content_type string, n bigint", ("text/html", 2)), 1.5)
    return report.select("urls", "completed", "failed", "skipped", F.size("exposure").alias("datasets"))


@query("workflow_plans", "kind, workflow, mode", [("url", "domain_necropsy", "generic"), ("js", "js_bone_saw", "js-intel"), ("dead_url", "dead_page_resurrection", "temporal"), ("odd", "domain_necropsy", "generic")])
def workflow_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.workflow_plan(table(spark, "kind string", ("url",), ("js",), ("dead_url",), ("odd",))).select("kind", "workflow", "mode")


@query("mode_table", "n", [(9,)])
def mode_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.modes(spark).agg(F.count("*").alias("n"))


@query("request_errors", "name, kind", [("ReadTimeout", "timeout"), ("SSLError", "ssl"), ("ConnectionError", "blocked"), ("Other", "request-error")])
def request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, "name string", ("ReadTimeout",), ("SSLError",), ("ConnectionError",), ("Other",)).select("name", T.classify_request_error(F.col("name")).alias("kind"))


@query("untried_probes", "url, strategy", [(SITE + "/x", "learned")])
def untried_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, "ord int, probe string, token string, strategy string, source string", (1, SITE + "/x", "x", "learned", "s"), (2, SITE + "/x/", "x", "learned", "s"), (3, SITE + "/known", "known", "wordlist", "s"), (4, "https://else.example.net/x", "x", "learned", "s"))
    return analysis.untried_probes(probes, table(spark, "url string", (SITE + "/known",)), "site.example.com").select("url", "strategy")


@query("crawl_rates", "minutes, seconds, per_request", [(2, 5, 12.5)])
def crawl_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, "s double, n int", (125.0, 10)).select(T.crawl_rate(F.col("s"), F.col("n")).alias("r")).select("r.*")


@query("ledger_chain", "url, chain, panel, bucket", [("http://a/", "http://b/", "links", "2xx"), ("http://c/s.js", "", "scripts", "other")])
def ledger_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, "url string, status_code int, content_type string, state string, error_kind string, source_kind string, source_page string", ("http://a/", 200, "text/html", "completed", "", "seed", ""), ("http://c/s.js", None, "", "active", "", "script-queue", "http://a/"))
    rows = ledger.ledger_rows(records, table(spark, "line string", ("http://a/ => http://b/",)))
    return rows.select("url", F.array_join("redirect_chain", ",").alias("chain"), "panel", "bucket")


@query("probe_strategies", "strategy, n", [("learned", 4), ("wordlist", 32)])
def probe_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, "kind string, value string", ("internal", SITE + "/ab/cd"))
    return analysis.probe_strategies(analysis.hidden_candidates(found, SITE, ("zz",)))


@query("timeline_array", "timeline", [('[{"timestamp":"1"},{"timestamp":"2"}]',)])
def timeline_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.timeline_array(table(spark, "value string", ('{"timestamp":"2"}',), ("junk{",), ('{"timestamp":"1"}',)))
