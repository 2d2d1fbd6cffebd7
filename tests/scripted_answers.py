"""Answers to the fetching test, by path; imported by Spark's Python workers."""

from gossamer.sources import fetch

SITE = "https://site.example.com"


def scripted(url: str, attempt: int, headers: dict[str, str]) -> fetch.Response:
    """A server of this test: by the path, always one answer, or one that comes right at the second attempt."""
    path = url.removeprefix(SITE)
    if path == "/flaky" and attempt == 1:
        return fetch.Response(503, "text/html", "", url, headers={"Retry-After": "0"})
    if path == "/down":
        return fetch.Response(500, "text/html", "", url)
    if path == "/lost":
        raise TimeoutError("no answer")
    if path == "/moved":
        return fetch.Response(200, "text/html; charset=utf-8", f"{attempt}", SITE + "/new", (url,))
    return fetch.Response(200, "text/html", f"{attempt} {headers.get('X-Crawl', '')}", url)
