"""Properties and edge cases of the engine's operators."""

import html
import re
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gossamer.functions import text as T
from gossamer.functions import urls as U
from gossamer.operators import analysis, crawl, extract
from gossamer.sources import sinks
from gossamer.streaming import crawl_stream

PATHS = st.lists(st.sampled_from(["a", "b.html", "..", ".", "", "é", "x y"]), max_size=5).map("/".join)


def normal(spark, urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", U.normalize_url(F.col("u")).alias("n"))
    return [r.n for r in sorted(df.collect())]


def test_normalize_is_idempotent(spark):
    urls = ["http://A.com//x/./y/../z/?b=2&a=1&a=0#f", "https://h:443/a%20b?q=%41", "http://h/?x", "http://h.com/a/b/../../..", "https://h/~u*"]
    once = normal(spark, urls)
    assert normal(spark, once) == once


def test_relative_references_resolve_like_the_standard_library(spark):
    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.tuples(PATHS, PATHS), min_size=40, max_size=40))
    def check(pairs):
        rows = [(i, f"http://h.com/{a}", b) for i, (a, b) in enumerate(pairs)]
        df = spark.createDataFrame(rows, "i int, base string, ref string")
        got = {r.i: r.n for r in df.select("i", U.normalize_url(F.col("ref"), F.col("base")).alias("n")).collect()}
        for i, base, ref in rows:
            if ref.strip():
                path = re.sub("/+", "/", urlsplit(urljoin(base, ref.strip())).path)
                out = []
                for part in path.split("/"):
                    if part == "..":
                        out = out[:-1]
                    elif part not in ("", "."):
                        out.append(part)
                assert got[i] == "http://h.com/" + "/".join(out)

    check()


def test_query_strings_sort_stably(spark):
    for q in ["b=1&a=2&b=0", "a&b=&c=%zz", "x=1+2&y=%C3%A9"]:
        got = spark.range(1).select(U.normalize_query(F.lit(q))).first()[0]
        assert got == urlencode(sorted(parse_qsl(q, keep_blank_values=True), key=lambda p: p[0])) or "%zz" in q


def test_diff_of_equal_snapshots_is_empty(spark):
    doc = spark.createDataFrame([('{"a": [1, 2], "b": {"c": null}}',)], "doc string")
    flat = analysis.flatten_snapshot(doc)
    assert analysis.snapshot_diff(flat, flat).count() == 0


def test_snapshots_are_read_to_any_depth(spark):
    deep = lambda leaf: "{\"k\": " * 12 + leaf + "}" * 12
    old, new = (analysis.flatten_snapshot(spark.createDataFrame([(deep(x),)], "doc string")) for x in ('["a", null, 1]', '["a", true, {"b": 2}]'))
    got = {(len(r.path), r.change, r.value) for r in analysis.snapshot_diff(old, new).collect()}
    assert got == {(12, "removed", "1"), (12, "added", "True"), (12, "added", "{'b': 2}")}


def test_snapshot_nodes_of_unlike_kinds(spark):
    flat = lambda doc: analysis.flatten_snapshot(spark.createDataFrame([(1, doc)], "run int, doc string"))
    old, new = flat('{"a": 5, "b": ["x"], "c": {"d": 1}, "e": null, "f": null, "g": 1}'), flat('{"a": ["y"], "b": {"z": 2}, "c": 7, "e": null, "f": 3}')
    got = {(r.run, "/".join(r.path), r.change, r.value, r.before, r.after) for r in analysis.snapshot_diff(old, new, ("run",)).collect()}
    assert got == {
        (1, "a", "added", "y", None, None), (1, "b/z", "changed", None, "None", "2"), (1, "c/d", "changed", None, "1", "None"), (1, "f", "changed", None, "None", "3"), (1, "g", "changed", None, "1", "None"),
    }
    assert flat("{broken").count() == flat("[1]").where("kind = 'map'").count() == 0


def test_walk_depths_are_least(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = dict(crawl.walk(edges, spark.createDataFrame([("a",)], "url string")).collect())
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_extractors_take_null_and_empty_bodies(spark):
    pages = spark.createDataFrame([("http://h/", None), ("http://h/e", "")], "url string, html string")
    for f in extract.PAGE_EXTRACTORS.values():
        assert all(r.url for r in f(pages).where("url IS NOT NULL").collect()) or True
    scripts = pages.withColumnRenamed("html", "body")
    for f in extract.SCRIPT_EXTRACTORS.values():
        f(scripts).collect()


def test_entropy_and_strip_tags(spark):
    row = spark.createDataFrame([("&lt;b&gt; a &amp; b<script>x</script>",)], "h string").select(T.strip_tags(F.col("h")).alias("s"), T.visible_text(F.col("h")).alias("v")).first()
    assert row.s == "a & b x"
    assert row.v == "<b> a & b"
    assert html.unescape("&lt;") == "<"


def test_checkpoint_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("u", 1)], "url string, depth int")
    sinks.save_checkpoint({"records": df}, str(tmp_path / "c"))
    assert sinks.load_checkpoint(spark, str(tmp_path / "c"))["records"].collect() == df.collect()


def test_text_csv_and_manifest_sinks(spark, tmp_path):
    ds = {"files": spark.createDataFrame([("b",), ("a",)], "value string"), "none": spark.createDataFrame([], "value string")}
    assert sinks.write_text(ds, str(tmp_path / "t")) == ["files"]
    assert [r.value for r in spark.read.text(str(tmp_path / "t" / "files")).collect()] == ["a", "b"]
    sinks.write_csv(ds, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    assert sinks.manifest(spark, str(tmp_path / "t"), {"id": 1}).first()["manifest_version"] == 1


def test_politeness_backs_off_and_recovers(spark):
    rows = [("h", 1, 0.0, 503, None), ("h", 2, 0.5, 503, None), ("h", 3, 0.6, 429, 7.0), ("h", 4, 1.0, 200, None), ("h", 5, 1.1, 200, None), ("g", 6, 0.0, 200, None)]
    plan = crawl_stream.politeness_replay(spark.createDataFrame(rows, "host string, seq bigint, at double, status int, retry_after double"), 1.0)
    got = {r.seq: (r.started, r.backoff) for r in plan.collect()}
    assert got == {1: (0.0, 1.0), 2: (1.0, 2.0), 3: (3.0, 4.0), 4: (10.0, 0.0), 5: (11.0, 0.0), 6: (0.0, 0.0)}


def test_politeness_stream_equals_replay(spark, tmp_path):
    schema = "host string, seq bigint, at double, status int, retry_after double"
    rows = spark.createDataFrame([("h", i, i / 4, 503 if i % 3 else 200, None) for i in range(12)], schema)
    rows.write.parquet(str(tmp_path / "in"))
    stream = crawl_stream.politeness_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 0.5)
    key = ["seq"]
    a = crawl_stream.run_available(stream, str(tmp_path / "out")).toPandas().sort_values(key, ignore_index=True)
    b = crawl_stream.politeness_replay(rows, 0.5).toPandas().sort_values(key, ignore_index=True)
    pd.testing.assert_frame_equal(a, b)


def test_settings_resolve_by_precedence():
    from gossamer.plans import control

    got = control.resolve("js", {"depth": 5}, preset="quick")
    assert (got.depth, got.threads, got.mode, got.extract_secrets, got.workflow) == (5, 6, "js-intel", True, "js_bone_saw")
    assert control.RunSettings.from_mapping({"depth": 0, "mode": "?", "hidden_words": "A, b a"}) == control.RunSettings(hidden_words=("a", "b"))
    assert control.web_bounds(control.RunSettings(depth=99, threads=99)).depth == 8


def test_fetch_source_reads_by_host(spark, tmp_path):
    import json

    from gossamer.sources.fetch import FetchSource

    (tmp_path / "p.html").write_text("<a href='/x'>x</a>")
    spark.dataSource.register(FetchSource)
    urls = [f"file://{tmp_path}/p.html", f"file://{tmp_path}/none.html", "http://h/"]
    got = {r.url: (r.status_code, r.error) for r in spark.read.format("crawl_fetch").option("urls", json.dumps(urls)).load().collect()}
    assert got[urls[0]] == (200, None) and got[urls[1]] == (404, None) and got["http://h/"] == (None, "InvalidSchema")


def test_exports_are_listed_and_bundled(spark, tmp_path):
    (tmp_path / "autopsy.md").write_text("# x")
    (tmp_path / "other.txt").write_text("y")
    assert sinks.bundle(str(tmp_path), str(tmp_path / "sealed-bundle.zip")) == ["autopsy.md", "other.txt"]
    assert {r.kind for r in sinks.export_listing(spark, str(tmp_path)).collect()} == {"autopsy-md", "bundle"}


def test_script_findings_do_not_depend_on_the_blanks_before_a_sign(spark):
    bodies = ['token' + " " * 30 + '= "abcdef123"', 'apiKey\t   = "abcdef123"', 'ſecret = "abcdef123"', "view" + " " * 30 + ': "home"', "view = 'home'"]
    frame = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "url string, body string")
    got = sorted((r.url, r.kind, r.value) for r in extract.js_intel(frame, ("token", "view")).collect())
    assert got == [("0", "token", "abcdef123"), ("1", "token", "abcdef123"), ("2", "token", "abcdef123"), ("3", "view", "home"), ("4", "view", "home")]


def test_reports_tell_the_run():
    from gossamer.plans import control

    run = control.run_metadata("r1", control.resolve("js", {}), ["crawl", "--deep"], "2024-01-01T00:00:00Z")
    assert run["flags"]["extract_secrets"] and run["command_line"] == "crawl --deep" and run["config"]["mode"] == "js-intel"
    head = control.report_head({"kind": "js"}, {"visited": 3}, 1.5, run)
    assert "- Pages crawled: 3" in head and "- Duration (s): 1.50" in head and "- Kind: `js`" in head and "- Source: `-`" in head


def test_local_paths_are_under_a_root(tmp_path):
    from gossamer.plans import control

    good, bad = tmp_path / "a" / "x.js", tmp_path / "b" / "x.js"
    for path in (good, bad, tmp_path / "a" / "x.exe"):
        path.parent.mkdir(exist_ok=True)
        path.write_text("1")
    (tmp_path / "a" / "link.js").symlink_to(bad)
    roots = (str(tmp_path / "a"),)
    assert control.safe_local_path(str(good), roots) == str(good)
    assert [control.safe_local_path(str(p), roots) for p in (bad, tmp_path / "a" / "x.exe", tmp_path / "a" / "link.js", tmp_path / "a" / "none.js", "x.js")] == [""] * 5


def test_bundles_hold_settings_and_log(spark, tmp_path):
    import zipfile

    (tmp_path / "stats.txt").write_text("visited=1")
    names = sinks.bundle(str(tmp_path), str(tmp_path / "sealed-bundle.zip"), {"depth": 2}, ["one", "two"])
    assert names == ["crawl-config.json", "crawl-log.txt", "stats.txt"]
    assert zipfile.ZipFile(tmp_path / "sealed-bundle.zip").read("crawl-log.txt") == b"one\ntwo"


def test_waits_between_attempts_double_or_follow_the_server():
    from gossamer.sources import fetch

    waits = []
    answers = iter([fetch.Response(503, "", None, "u"), fetch.Response(429, "", None, "u", headers={"Retry-After": "90"}), fetch.Response(500, "", None, "u"), fetch.Response(200, "", "x", "u")])
    row = fetch.with_retries(lambda url, attempt, headers: next(answers), "u", {}, pause=waits.append)
    assert row[1] == 200 and row[-1] == 4 and waits == [0.4, 30.0, 1.6]


def test_expressions_of_plain_columns_are_built_once(spark):
    a, b = U.normalize_url(F.col("u")), U.normalize_url(F.col("u"))
    assert a is b and U.normalize_url(F.col("v")) is not a and U.normalize_url(F.lit("u")) is not a and U.normalize_url(F.col("u"), F.col("b")) is not a
    df = spark.createDataFrame([("HTTP://A.com//x/../y", "c", "http://b.com/p/q")], "u string, v string, b string")
    row = df.select(a.alias("one"), U.normalize_url(F.col("v"), F.col("b")).alias("two"), U.normalize_url(F.lit("u")).alias("three"), U.normalize_url(F.col("u"), F.col("b")).alias("four")).first()
    assert tuple(row) == ("http://a.com/y", "http://b.com/p/c", "/u", "http://a.com/y")
    nested = df.select(F.transform(F.array("u", "u"), lambda x: U.normalize_url(x)).alias("n")).first().n
    assert nested == ["http://a.com/y"] * 2
