"""Checkpoints and logged walks: whole or not there, and taken up by another session."""

import threading

import pytest
from pyspark.sql import functions as F

from gossamer.operators import crawl
from gossamer.sources import runlog


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def broken(spark):
    return spark.range(3).select(F.raise_error(F.lit("lost")).cast("string").alias("url"))


def test_a_save_that_fails_midway_leaves_the_checkpoint_before(spark, tmp_path):
    folder = str(tmp_path / "c")
    first = spark.createDataFrame([("u", 1)], "url string, depth int")
    runlog.save_checkpoint({"records": first, "seen": first.select("url")}, folder)
    before = sorted(p.name for p in (tmp_path / "c" / "tables").iterdir())
    with pytest.raises(Exception, match="lost"):
        runlog.save_checkpoint({"records": first.withColumn("depth", F.lit(9)), "seen": broken(spark)}, folder)
    saved = runlog.load_checkpoint(spark, folder)
    assert rows(saved["records"]) == [("u", 1)] and rows(saved["seen"]) == [("u",)]
    assert sorted(p.name for p in (tmp_path / "c" / "tables").iterdir()) == before
    assert runlog.save_checkpoint({"records": first.withColumn("depth", F.lit(2))}, folder) == 2
    assert rows(runlog.load_checkpoint(spark, folder)["records"]) == [("u", 2)]


def test_a_checkpoint_can_be_made_from_the_one_that_it_replaces(spark, tmp_path):
    folder = str(tmp_path / "c")
    runlog.save_checkpoint({"n": spark.range(1).toDF("n")}, folder)
    for k in range(1, 5):
        held = runlog.load_checkpoint(spark, folder)["n"]
        assert runlog.save_checkpoint({"n": held.select((F.col("n") + 1).alias("n"))}, folder) == k + 1
        assert rows(held) == [(k - 1,)]  # who has looked it up can still read it
    assert len(list((tmp_path / "c" / "published").glob("0*"))) == len(list((tmp_path / "c" / "tables").iterdir())) == 2
    assert rows(runlog.load_checkpoint(spark, folder, number=4)["n"]) == [(3,)]


def test_of_two_writers_of_a_number_one_fails(spark, tmp_path):
    log = runlog.RunLog(spark, str(tmp_path / "log"))
    taken, done = [], []

    def put(k):
        try:
            done.append(log.commit("x", {"n": spark.range(k, k + 1).toDF("n")}, after=0))
        except runlog.EntryTaken:
            taken.append(k)

    threads = [threading.Thread(target=put, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(done) == len(taken) == 1 and [e.number for e in log.entries()] == [1]
    with pytest.raises(runlog.EntryTaken):
        log.commit("y", after=0)
    assert rows(log.table(log.entries()[0], "n")) == [(1 - taken[0],)] and len(list((tmp_path / "log" / "tables").iterdir())) == 1


def test_versions_and_missing_checkpoints_are_told(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        runlog.load_checkpoint(spark, str(tmp_path / "none"))
    runlog.save_checkpoint({"empty": spark.createDataFrame([], "a int, b array<string>")}, str(tmp_path / "c"), version=2)
    with pytest.raises(ValueError, match="version 2"):
        runlog.load_checkpoint(spark, str(tmp_path / "c"))
    assert runlog.load_checkpoint(spark, str(tmp_path / "c"), version=2)["empty"].dtypes == [("a", "int"), ("b", "array<string>")]


EDGES = [("a", "b"), ("a", "c"), ("c", "d"), ("b", "d"), ("d", "e"), ("e", "a"), ("e", "f"), ("x", "y"), (None, "a"), ("f", None)]


def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string")


def test_a_stopped_walk_is_taken_up_by_another_session(spark, tmp_path):
    roots = spark.createDataFrame([("a",)], "url string")
    whole = crawl.walk_logged(edges(spark), roots, str(tmp_path / "one"), 9)
    assert [e.phase for e in runlog.RunLog(spark, str(tmp_path / "one")).entries()][:2] == ["seeded", "depth-1"]
    crawl.walk_logged(edges(spark), roots, str(tmp_path / "two"), 2)
    # What the log has of the edges counts, and the other session is given none.
    again = crawl.walk_logged(None, None, str(tmp_path / "two"), 9, spark=spark.newSession())
    assert rows(again) == rows(whole) == [("a", 0, None), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "b"), ("e", 3, "d"), ("f", 4, "e"), (None, 5, "f")]
    log = runlog.RunLog(spark, str(tmp_path / "two"))
    n = len(log.entries())
    assert log.entries()[-1].phase == "complete" and rows(crawl.walk_logged(None, None, str(tmp_path / "two"), 9, spark=spark)) == rows(whole) and len(log.entries()) == n


def test_a_walk_that_breaks_in_a_level_goes_on_after_the_level_before(spark, tmp_path, monkeypatch):
    roots = spark.createDataFrame([("a",)], "url string")
    publish, folder = runlog.RunLog._publish, str(tmp_path / "log")

    def fails(self, entry):
        if entry.phase == "depth-2":
            raise OSError("killed")
        publish(self, entry)

    monkeypatch.setattr(runlog.RunLog, "_publish", fails)
    with pytest.raises(OSError, match="killed"):
        crawl.walk_logged(edges(spark), roots, folder, 9)
    monkeypatch.setattr(runlog.RunLog, "_publish", publish)
    assert [e.phase for e in runlog.RunLog(spark, folder).entries()] == ["seeded", "depth-1"]
    got = crawl.walk_logged(None, None, folder, 3, spark=spark)
    assert rows(got.select("url", "depth")) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]


def test_paths_by_doubling(spark):
    chain = spark.createDataFrame([(f"u{k:03d}", k, f"u{k - 1:03d}" if k else None) for k in range(40)] + [("lone", 3, "unknown")], "url string, depth int, parent string")
    got = {r.url: r.path for r in crawl.walk_paths(chain).collect()}
    assert got["u039"] == [f"u{k:03d}" for k in range(40)] and got["u000"] == ["u000"] and got["lone"] == ["lone"]
    walked = crawl.walk_logged(edges(spark), spark.createDataFrame([("a",), ("x",), ("a",)], "url string"), crawl.scratch_folder(spark), 9)
    told = {r.url: r.path for r in crawl.walk_paths(walked).collect()}
    assert told["f"] == ["a", "b", "d", "e", "f"] and told["y"] == ["x", "y"]
