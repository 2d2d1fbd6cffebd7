"""A frontier as a stream: batches by host budgets, and each address once over restarts."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gossamer.sources import fetch, frontier
from gossamer.streaming import crawl_stream


@pytest.fixture
def pages(spark, tmp_path):
    for host, n in (("a", 7), ("b", 3), ("c", 1)):
        (tmp_path / host).mkdir()
        for k in range(n):
            (tmp_path / host / f"{k}.html").write_text(f"page {host}{k}")
    urls = [f"file://{p}" for p in sorted(tmp_path.rglob("*.html"))] + [f"file://{tmp_path}/gone.html", None, f"file://{tmp_path}/a/0.html"]
    return spark.createDataFrame([(u,) for u in urls], "url string")


def batches(spark, pages, folder, runs):
    """Runs the stream so often; the rows of each run's one batch."""
    out = []
    for _ in range(runs):
        stream = frontier.frontier_stream(spark, pages, f"{folder}/frontier", per_host=4, parts=3, options={"backoff": "0"})
        out.append(crawl_stream.run_available(stream, f"{folder}/run").collect())
    return out


def test_three_batches_each_address_once_after_restarts(spark, pages, tmp_path):
    seen = batches(spark, pages, str(tmp_path), 4)
    # All addresses are of one host, the local one: twelve of them, four a batch, and nothing in the fourth run.
    assert [len(rows) for rows in seen] == [4, 8, 12, 12]
    got = Counter(r.url.rsplit("/", 2)[-2] + "/" + r.url.rsplit("/", 1)[-1] for r in seen[-1])
    assert max(got.values()) == 1 and sum(r.status_code == 200 for r in seen[-1]) == 11 and sum(r.status_code == 404 for r in seen[-1]) == 1
    assert {r.body for r in seen[-1] if r.status_code == 200} == {f"page {h}{k}" for h, n in (("a", 7), ("b", 3), ("c", 1)) for k in range(n)}


def test_a_batch_takes_the_next_of_every_host(spark, tmp_path):
    urls = spark.createDataFrame([(f"gopher://h{h}.com/{k:02d}",) for h in range(5) for k in range(h + 1)], "url string")
    seen = []
    for _ in range(4):
        stream = frontier.frontier_stream(spark, urls, str(tmp_path / "f"), per_host=2, parts=4, options={"retries": "0"})
        seen.append({r.url for r in crawl_stream.run_available(stream, str(tmp_path / "run")).collect()})
    assert [len(s) for s in seen] == [9, 14, 15, 15] and all(a <= b for a, b in zip(seen, seen[1:]))
    assert {u for u in seen[0] if "h4" in u} == {"gopher://h4.com/00", "gopher://h4.com/01"}
    assert not frontier.left_over({"folder": str(tmp_path / "f"), "turns": "5", "parts": "4"}) and frontier.left_over({"folder": str(tmp_path / "f"), "turns": "9", "parts": "4"})


def test_a_batch_that_fails_is_fetched_again(spark, pages, tmp_path):
    options = {"backoff": "0", "fetcher": "gossamer.sources.fetch:read_nothing"}
    stream = frontier.frontier_stream(spark, pages, f"{tmp_path}/frontier", per_host=4, parts=3, options=options)
    with pytest.raises(Exception, match="read_nothing"):
        crawl_stream.run_available(stream, f"{tmp_path}/run")
    # The first run takes the lost batch again, by the options of now, and goes on.
    sizes = [len(rows) for rows in batches(spark, pages, str(tmp_path), 3)]
    assert sizes[0] >= 4 and sizes[-1] == 12, sizes
    assert max(Counter(r.url for r in batches(spark, pages, str(tmp_path), 1)[0]).values()) == 1


def test_an_empty_frontier(spark, tmp_path):
    stream = frontier.frontier_stream(spark, spark.createDataFrame([], "url string"), str(tmp_path / "f"), parts=2)
    assert crawl_stream.run_available(stream, str(tmp_path / "run")).count() == 0


def test_refusals_make_the_hosts_next_address_wait(monkeypatch):
    waits, clock = [], [100.0]
    monkeypatch.setattr(time, "sleep", lambda s: (waits.append(round(s, 3)), clock.__setitem__(0, clock[0] + s)))
    monkeypatch.setattr(time, "monotonic", lambda: clock[0])
    answers = {"http://h/1": 503, "http://h/2": 429, "http://h/3": 200, "http://h/4": 200, "http://g/1": 200}
    monkeypatch.setattr(fetch, "read_local", lambda url, attempt, headers: fetch.Response(answers[url], "text/html", "x", url))
    rows = list(fetch.fetch_all(iter(answers), {"retries": "0", "delay": "0.5"}))
    assert [r[1] for r in rows] == list(answers.values()) and waits == [0.0, 1.0, 2.0, 0.5, 0.0]
