"""SQL plug-ins, the findings sink, merged genealogies and snapshots flattened by level."""

import itertools
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gossamer.functions import literals
from gossamer.functions import patterns as P
from gossamer.functions import text as T
from gossamer.operators import analysis, extract, ledger, plugins
from gossamer.plans import control
from gossamer.sources import readers, writer


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@plugins.plugin("letters", "letter string, n int")
def letters(url, body):
    for c in sorted(set(body)):
        yield c, body.count(c)


@plugins.plugin("address", "url string")
def address(url, body):
    yield (url.upper(),)


def test_plugins_by_name_and_together_read_each_body_once(spark):
    pages = spark.createDataFrame([("u", "aab"), ("v", None), (None, "c")], "url string, body string")
    together = plugins.run_plugins(pages, ["letters", "address", "letters"])
    pages.createOrReplaceTempView("plugin_pages")
    alone = spark.sql(
        "SELECT p.url, 'letters' AS extractor, to_json(struct(f.*)) AS row FROM plugin_pages p, LATERAL find_letters(p.url, p.body) f UNION ALL SELECT p.url, 'address', to_json(struct(f.*)) FROM plugin_pages p, LATERAL find_address(p.url, p.body) f"
    )
    assert rows(together) == rows(alone) and together.count() == 6
    plan = together._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") == 1
    with pytest.raises(Exception, match="no plug-in"):
        plugins.run_plugins(pages, ["nobody"]).collect()
    with pytest.raises(ValueError):
        plugins.plugin("not a name", "a int")


def sink(df, folder, mode="append", kind="jsonl"):
    df.sparkSession.dataSource.register(writer.FindingsSink)
    df.write.format("crawl_findings").mode(mode).option("path", folder).option("kind", kind).save()


@pytest.mark.parametrize("kind", ["jsonl", "csv", "text"])
def test_what_is_written_is_read_back_in_order(spark, tmp_path, kind):
    values = ['a "b", c', "é\\", "z", "x,y", "l1"] + [f"v{i:03d}" for i in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "value string").repartitionByRange(5, "value").sortWithinPartitions("value")
    sink(df, str(tmp_path / "f"), kind=kind)
    assert rows(writer.read_findings(spark, str(tmp_path / "f"), "value string", kind)) == sorted((v,) for v in values)
    entry = json.loads((tmp_path / "f" / "_published").read_text())["writes"][0]
    assert entry["rows"] == len(values) and len(entry["files"]) == 5
    if kind == "text":
        lines = "".join((tmp_path / "f" / entry["folder"] / n).read_text() for n in entry["files"]).split("\n")[:-1]
        assert lines == sorted(values)


def test_a_failed_task_leaves_nothing_and_overwriting_is_whole(spark, tmp_path):
    folder = str(tmp_path / "f")
    sink(spark.range(10).selectExpr("string(id) AS value"), folder)
    names = lambda: sorted(p.name for p in (tmp_path / "f").iterdir() if not p.name.startswith("_staging-"))
    before = names()
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="lost"):
            sink(spark.range(0, 10, 1, 4).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).cast("string").alias("value")), folder, mode)
        assert names() == before
    assert writer.read_findings(spark, folder, "value string").count() == 10
    sink(spark.range(3).selectExpr("string(id) AS value"), folder)
    assert writer.read_findings(spark, folder, "value string").count() == 13 and not list((tmp_path / "f").glob("_staging-*"))
    sink(spark.range(2).selectExpr("string(id) AS value"), folder, "overwrite")
    assert rows(writer.read_findings(spark, folder, "value string")) == [("0",), ("1",)] and len(list((tmp_path / "f").glob("write-*"))) == 1
    assert writer.read_findings(spark, str(tmp_path / "none"), "value string").count() == 0


def test_a_streams_batches_are_folders_by_number(spark, tmp_path):
    spark.dataSource.register(writer.FindingsSink)
    for k in range(2):
        spark.range(10 * k, 10 * k + 10).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
        query = stream.writeStream.format("crawl_findings").option("path", str(tmp_path / "f")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert rows(writer.read_findings(spark, str(tmp_path / "f"), "id bigint")) == sorted(((i,) for i in range(20)), key=str)
    assert sorted(p.name for p in (tmp_path / "f").glob("batch-*")) == ["batch-000000000", "batch-000000001"]
    folder = writer.Folder(str(tmp_path / "f"), "jsonl", ["id"])
    system, staged = folder.at(folder.staging)
    system.create_dir(staged)
    (tmp_path / "f" / folder.staging / "part-x.jsonl").write_text('{"id": 5}\n')
    folder.publish([writer.Written(folder.staging, "part-x.jsonl", 1), None], "batch-000000001", replace=False)  # the batch comes a second time
    assert writer.read_findings(spark, str(tmp_path / "f"), "id bigint").count() == 11


SEEN = "seq bigint, url string, content_type string, title string, metadata string, body binary, archive_presence boolean, redirect string, label string"


def test_genealogies_merge_in_any_order_to_that_of_all(spark):
    found = [("u", f"from{i % 3}", "linked" if i % 2 else "", f"n{i}") for i in range(6)] + [("only", "f", None, None), (None, "f", "x", "y")]
    seen = [(i, "uvw"[i % 3], ["text/a", "", None][i % 3], f"t{i}" if i % 4 else None, f"m{i % 2}", b"same" if i % 5 == 0 else None, [True, None, False][i % 3], None, f"d{i}") for i in range(20)]
    frames = lambda f, s: (spark.createDataFrame(f, "url string, found_on string, source_kind string, note string"), spark.createDataFrame(s, SEEN))
    want = rows(analysis.genealogy(*frames(found, seen)))
    states = [analysis.genealogy_state(*frames(found[k::3], seen[k::3])) for k in range(3)]
    for order in itertools.permutations(states):
        assert rows(analysis.genealogy_rows(analysis.merge_genealogy(*order))) == want
    assert rows(analysis.genealogy_rows(analysis.merge_genealogy(analysis.merge_genealogy(*states[:2]), states[2]))) == want
    assert len(want) == 4 and {r[1] for r in want} == {"u", "v", "w", "only"}


def test_flattening_by_level_equals_flattening_whole_documents(spark):
    deep = '{"k": ' * 9 + '["a", null, 1, true, 2.5, {"b": 1, "c": [false]}, [], {}]' + "}" * 9
    docs = [deep, "{broken", "null", "3", '"x"', "[1, 2]", "{}", '{"a": {"b": null, "c": ""}, "d": "Tru\\u00e9", "e": 10000000000, "f": -0.5, "g": [[1], ["x"]]}', None, '{"path": 1, "kind": 2, "n": {"v": 3}}']
    df = spark.createDataFrame(list(enumerate(docs)), "run int, doc string")
    key = lambda df: sorted((r.run, tuple(r.path), r.kind, r.value) for r in df.collect())
    assert key(analysis.flatten_by_level(df)) == key(analysis.flatten_snapshot(df))
    assert analysis.flatten_by_level(df.limit(0)).count() == 0


def test_one_scan_for_literals_loses_no_finding(spark):
    texts = ["see GITHUB.com/x and Key", "toKen = 'abcdefg'", "my.S3.amazonaws.com at a-b.ſ3.amazonaws.com", "nothing here", None, "", "İ mail a@b.co", "PROCESS.ENV.A vite_b", "GET '/x' get '/y'", "t.ME/abc x.ı"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "url int, body string")
    for name, patterns, folded, exact in (("intel", P.INTEL, P.INTEL_LITERALS, {}), ("js", P.JS, P.JS_LITERALS, P.JS_EXACT), ("secrets", P.SECRETS, {}, P.SECRET_LITERALS)):
        masked = df.withColumn("mask", literals.open_kinds(F.col("body"), folded, exact))
        for kind in [*folded, *exact]:
            lost = masked.where(F.size(T.find_all(F.col("body"), patterns[kind])) > 0).where(~literals.is_open(F.col("mask"), kind, folded, exact))
            assert lost.count() == 0, (name, kind)
    assert {r.kind for r in extract.text_intel(df, "url", "body").collect()} >= {"GITHUB", "EMAIL", "TELEGRAM", "AWS_BUCKET"}
    assert literals.kinds_in("abc", (), True) == 0


def test_older_runs_and_spread(spark):
    runs = spark.createDataFrame([(f"r{i}", f"2024-{1 + i % 3:02d}") for i in range(30)] + [("lone", None)], "id string, ended_at string")
    got = {r.id: r.against for r in ledger.older_run(runs).collect()}
    order = sorted((r.ended_at or "", r.id) for r in runs.collect())
    assert got == {b[1]: (a[1] if a else None) for a, b in zip([None, *order], order)}
    one = spark.range(100).coalesce(1)
    assert readers.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and rows(readers.spread(one)) == rows(one)
    assert readers.spread(spark.range(0, 100, 1, 50)).rdd.getNumPartitions() == 50


def test_patterns_are_compiled_by_the_engine_that_runs_them(spark):
    found = control.pattern_problems(spark, {"java": ["[a-z&&[^b]]", "a++", r"\p{Alpha}"], "python": ["(?P<x>a)", "("]})
    assert set(found) == {"python"} and len(found["python"]) == 2 and found["python"][1].startswith("(: ")
    pages = spark.createDataFrame([("u", "aab bbc")], "url string, html string")
    assert rows(extract.custom_matches(pages, "(?<one>a++)(b)")) == [("u", "aa, b")] and rows(extract.custom_matches(pages, "[a-z&&[^a]]+")) == [("u", "b"), ("u", "bbc")]
    with pytest.raises(Exception, match="(?i)pattern|unclosed"):
        extract.custom_matches(pages, "(")
