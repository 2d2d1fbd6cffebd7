"""Text, hash, HTTP and HTML functions as Column expressions; the two that need an HTML parser are Arrow UDFs."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from . import patterns

# How content types are read.
MARKUP_TYPES = ("text/html", "application/xhtml+xml", "application/xml", "text/xml")
SKIPPED_TYPES = ("application/octet-stream", "application/pdf", "application/zip", "application/x-zip-compressed", "application/x-7z-compressed", "application/x-rar-compressed")


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches' group; null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def find_groups(text: Column, pattern: str, *groups: int) -> Column:
    """All matches as array<struct<g0, g1, ...>> of the given groups."""
    return F.arrays_zip(*[find_all(text, pattern, g).alias(f"g{i}") for i, g in enumerate(groups)])


def entropy(text: Column) -> Column:
    """Shannon bits a character; 0 for empty text."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.size(chars)
    # Lengths of the runs of the sorted characters, then the sum over them.
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)))
    bits = F.aggregate(counts, F.lit(0.0), lambda s, k: s - (k / n) * F.log2(k / n))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0.0)).otherwise(bits)


def luhn(number: Column) -> Column:
    """Check digit of the digits in a text; a text without digits passes."""
    bare = F.regexp_replace(F.coalesce(number, F.lit("")), r"\D", "")
    return F.when(bare == "", F.lit(True)).otherwise(F.call_function("luhn_check", bare))


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden: list[str] = []
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            self.hidden.reverse()
            self.hidden.remove(tag)
            self.hidden.reverse()

    def handle_data(self, data: str) -> None:
        if not self.hidden and data.strip():
            self.found.append(data)


@pandas_udf(StringType())
def visible_text(pages: pd.Series) -> pd.Series:
    """Text nodes outside scripts and styles, blank ones dropped, joined by spaces; references decoded."""

    def one(page: str | None) -> str:
        parser = _Visible()
        parser.feed(page or "")
        return " ".join(parser.found)

    return pages.map(one)


@pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: html.unescape(t) if t is not None else None)


def strip_tags(text: Column) -> Column:
    """References decoded first, then tags as spaces and white space as one space; script bodies stay."""
    text = F.coalesce(text, F.lit(""))
    # Only texts with a reference go to Python.
    plain = F.coalesce(_unescape(F.when(text.contains("&"), text)), text)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, patterns.TAG, " "), r"(?U)\s+", " "), "^ | $", "")


def closed_references(text: Column) -> Column:
    """Text in which only references with their semicolon are read as such: other ampersands are written out.

    HTML takes ``&amp`` for a reference too, which may be one that the end of a text has cut off.
    """
    return F.regexp_replace(text, "&(?!(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);)", "&amp;")


def content_type(raw: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(raw, F.lit("")), ";", 1)))


def extracts_markup(ct: Column) -> Column:
    return (F.coalesce(ct, F.lit("")) == "") | ct.isin(*MARKUP_TYPES) | ct.startswith("text/")


def extracts_script(ct: Column) -> Column:
    return (F.coalesce(ct, F.lit("")) == "") | ct.contains("javascript") | ct.contains("ecmascript") | ct.isin("application/json", "text/plain")


def skip_reason(ct: Column) -> Column:
    """binary-content, or null where the content is read."""
    return F.when(ct.rlike("^(?:image|audio|video|font)/") | ct.isin(*SKIPPED_TYPES), F.lit("binary-content"))


def error_kind(status: Column) -> Column:
    return F.when(status.isin(401, 403, 429), F.lit("blocked")).when(status.between(400, 499), F.lit("client-error")).when(status >= 500, F.lit("server-error"))


def status_bucket(kind: Column, status: Column, state: Column) -> Column:
    """Blocked before the classes of status codes, those before the states."""
    return (
        F.when((kind == "blocked") | status.isin(401, 403, 429), F.lit("blocked"))
        .when(status.between(200, 299), F.lit("2xx")).when(status.between(300, 399), F.lit("3xx"))
        .when(status.between(400, 499), F.lit("4xx")).when(status.between(500, 599), F.lit("5xx"))
        .when(state == "failed", F.lit("failed")).when(state == "skipped", F.lit("skipped")).otherwise(F.lit("other"))
    )


def related_panel(state: Column, source_kind: Column, ct: Column) -> Column:
    kind, ct = F.lower(F.coalesce(source_kind, F.lit(""))), F.lower(F.coalesce(ct, F.lit("")))
    return (
        F.when(state.isin("failed", "skipped"), F.lit("broken"))
        .when(kind.contains("script") | ct.contains("javascript"), F.lit("scripts"))
        .when(kind.contains("document") | ct.rlike("pdf|msword|officedocument"), F.lit("documents"))
        .otherwise(F.lit("links"))
    )


def classify_request_error(name: Column) -> Column:
    """Kind of a failed request by its exception's name."""
    n = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(n.contains("timeout"), F.lit("timeout")).when(n.contains("ssl"), F.lit("ssl")).when(n.contains("invalidurl") | n.contains("invalidschema"), F.lit("invalid-url"))
        .when(n.contains("proxy") | n.contains("connection"), F.lit("blocked")).otherwise(F.lit("request-error"))
    )


def parse_headers(raw: Column) -> Column:
    """Map of ``Name: value`` lines; a line without a colon is an error."""
    lines = F.filter(F.split(raw, r"\r?\n"), lambda x: F.trim(x) != "")
    pair = lambda x: F.when(F.instr(x, ":") > 0, F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v"))).otherwise(F.raise_error(F.concat(F.lit("not a header: "), x)).cast("struct<k:string,v:string>"))
    return F.map_from_entries(F.transform(lines, pair))


def cookies(header: Column) -> Column:
    """array<struct<name, value>> of a cookie header; nameless ones dropped."""
    parts = F.transform(F.filter(F.split(header, ";"), lambda x: F.instr(x, "=") > 0), lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("name"), F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("value")))
    return F.filter(parts, lambda x: x["name"] != "")


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After value, a number or an HTTP date; never negative, null if neither."""
    text = F.trim(value)
    date = F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]+,\s*", ""), F.lit("dd MMM yyyy HH:mm:ss zzz"))
    seconds = F.coalesce(text.try_cast("double"), date.cast("double") - now.cast("double"))
    return F.when(seconds.isNotNull(), F.greatest(seconds, F.lit(0.0)))


def strip_ansi(text: Column) -> Column:
    """Without terminal colours, carriage returns and outer white space."""
    return F.regexp_replace(F.regexp_replace(text, "\x1b\\[[0-9;]*[A-Za-z]|\r", ""), r"(?U)^\s+|\s+$", "")


def proxy_addresses(text: Column) -> Column:
    """array<string> of a comma-separated list of proxies, as http addresses."""
    return F.transform(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != ""), lambda p: F.concat(F.lit("http://"), p))


def word_list(text: Column) -> Column:
    """Distinct lower-case words in order, split at white space and commas."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s,]+"), lambda x: x != ""))


def hidden_token(text: Column) -> Column:
    """A path segment usable as a probe, or ''."""
    token = F.lower(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^\.+|\.+$", ""))
    return F.when(token.rlike(r"^[a-z0-9][a-z0-9._-]{1,24}$"), token).otherwise(F.lit(""))


def log_channels(line: Column) -> Column:
    """Channels of a log line: always logs, and feed or errors by what it says."""
    low = F.lower(line)
    feed = low.rlike("internal page:|external page:|descending to depth|drained |subdomain:|harvest summary")
    errors = low.rlike("failed to feed|rejected by the prey|fought back|could not|malformed|disabled")
    return F.array_compact(F.array(F.lit("logs"), F.when(feed, F.lit("feed")), F.when(errors, F.lit("errors"))))


def parse_redirect(line: Column) -> Column:
    """struct<url, chain> of ``url => hop -> hop``."""
    return F.struct(F.trim(F.substring_index(line, " => ", 1)).alias("url"), F.when(line.contains(" => "), F.transform(F.split(F.substring_index(line, " => ", -1), " -> "), lambda hop: F.trim(hop))).otherwise(F.array().cast("array<string>")).alias("chain"))


def crawl_rate(seconds: Column, processed: Column) -> Column:
    """struct<minutes, seconds, per_request> of a run."""
    return F.struct(F.floor(seconds / 60).alias("minutes"), F.floor(seconds % 60).alias("seconds"), (seconds / F.greatest(processed, F.lit(1))).alias("per_request"))


def one_line(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()
