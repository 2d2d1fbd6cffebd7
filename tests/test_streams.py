"""Streams over files: restarts, timers, bounded state, and batches that come twice."""

import json

import pandas as pd
from pyspark.sql import functions as F

from gossamer.operators import ledger
from gossamer.sources.runlog import RunLog
from gossamer.streaming import crawl_stream, ingest

REQUESTS = "host string, seq bigint, at double, status int, retry_after double"


def arrive(rows, folder):
    rows.coalesce(1).write.mode("append").parquet(folder)


def test_politeness_goes_on_after_a_restart(spark, tmp_path):
    data = [(f"h{i % 3}", i, i / 4, [200, 503, 429, None][i % 4], 2.5 if i % 7 == 0 else None) for i in range(60)]
    data += [("", 100 + k, 3.0 + k, 503, None) for k in range(3)]
    rows, run = spark.createDataFrame(data, REQUESTS), str(tmp_path / "run")
    for low, high in ((0, 4), (4, 9), (9, 99)):
        arrive(rows.where((F.col("at") >= low) & (F.col("at") < high)), str(tmp_path / "in"))
        stream = crawl_stream.politeness_stream(spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in")), 0.5)
        got = crawl_stream.run_available(stream, run).toPandas()
    a, b = (x.sort_values("seq", ignore_index=True) for x in (got, crawl_stream.politeness_replay(rows, 0.5).toPandas()))
    pd.testing.assert_frame_equal(a, b)


def test_an_idle_host_is_let_go_and_starts_anew(spark, tmp_path):
    batches = [[("h", 1, 10.0, 503, None), ("h", 2, 11.0, 503, None)], [("g", 3, 500.0, 200, None)], [("g", 4, 501.0, 200, None)], [("h", 5, 502.0, 503, None)]]
    for rows in batches:
        arrive(spark.createDataFrame(rows, REQUESTS), str(tmp_path / "in"))
        stream = crawl_stream.politeness_stream(spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in")), 1.0, idle=60.0)
        got = {r.seq: r.backoff for r in crawl_stream.run_available(stream, str(tmp_path / "run")).collect()}
    # Its third refusal would double to 4 seconds; as the host was let go it is the first again.
    assert got == {1: 1.0, 2: 2.0, 3: 0.0, 4: 0.0, 5: 1.0}


def test_the_last_entries_are_capped_in_state(spark, tmp_path):
    schema = "channel string, seq bigint, line string"
    for k in range(3):
        rows = [(c, 100 * k + i, f"{c}{i}") for c in ("a", None) for i in range(40 if c else 3)]
        arrive(spark.createDataFrame(rows + rows[:5], schema), str(tmp_path / "in"))
        stream = crawl_stream.last_entries_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 10)
        told = crawl_stream.run_available(stream, str(tmp_path / "run"), "update")
        assert told.agg(F.max(F.size("entries"))).first()[0] == 10 or k == 0
    last = {r.channel: [e.seq for e in r.entries] for r in crawl_stream.latest_by_key(told, "channel", "newest").collect()}
    assert last["a"] == list(range(230, 240)) and last[""] == [0, 1, 2, 100, 101, 102, 200, 201, 202]
    held = spark.read.format("statestore").option("stateVarName", "entries").load(str(tmp_path / "run" / "checkpoint"))
    assert held.count() == 10 + 9
    rows = spark.read.parquet(str(tmp_path / "in")).where("channel = 'a'").distinct()
    assert sorted(r.seq for r in ledger.last_entries(rows, 10).collect()) == last["a"]


def line(kind, payload):
    return json.dumps({"type": kind, "payload": payload})


LINES = [
    [(1, line("result", {"url": "u", "status_code": 200, "depth": 1})), (2, line("result", {"url": "u", "state": "done", "content_type": "text/html"})), (3, line("result", {"url": ""})), (4, "{broken"), (5, line("error", {})), (6, line("other", {"a": 1})), (7, line("result", [1]))],
    [(8, line("queue", {"pending": {"count": 2, "items": ["a", "b"]}, "active": None})), (9, line("queue", {"pending": {"count": 1, "items": ["a"]}})), (10, line("robots", {"rules": ["/x"], "crawl_delay": 2})), (11, line("error", {"message": "m", "status_code": 404, "url": "u"}))],
    [(12, line("result", {"url": "v", "discovery_time": 7})), (13, line("sitemap", {"sitemap_urls": ["s"], "queued_urls": None})), (14, line("error", None))],
    [(15, line("result", {"url": "u", "state": "failed"})), (16, line("robots", {}))],
]


def tables(spark, folder):
    return {name: sorted(map(tuple, df.drop("payload").collect()), key=str) for name, df in ingest.ingested(spark, folder).items()}


def test_events_are_taken_in_and_a_batch_that_comes_twice_counts_once(spark, tmp_path):
    batches = [spark.createDataFrame(rows, "seq bigint, line string") for rows in LINES]
    told = []
    for folder, merge_every, times in ((str(tmp_path / "a"), 16, 1), (str(tmp_path / "b"), 2, 2), (str(tmp_path / "c"), 1, 1)):
        for number, batch in enumerate(batches):
            for _ in range(times):
                ingest.ingest_batch(batch, number, folder, merge_every)
        ingest.ingest_batch(batches[0], 0, folder, merge_every)
        told.append(tables(spark, folder))
    assert told[0] == told[1] == told[2]
    got = told[0]
    assert got["results"] == [(12, "v", None, "", None, "", 7, "pending", "", "", ""), (15, "u", None, "", None, "", 0, "failed", "", "", "")]
    assert got["queue"] == [("pending", 1, ["a"])] and got["robots"] == [([], None)] and got["sitemap"] == [(["s"], [])]
    assert got["errors"] == [(11, "m | status=404 | url=u"), (14, "The rite failed."), (5, "The rite failed.")]
    assert sorted(s for s, _ in got["timeline"]) == [1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16]


def test_a_batch_that_breaks_between_its_tables_is_taken_whole_the_next_time(spark, tmp_path, monkeypatch):
    batch, folder, publish = spark.createDataFrame(LINES[0], "seq bigint, line string"), str(tmp_path / "t"), RunLog._publish

    def fails(self, entry):
        if self.folder.endswith("state"):
            raise OSError("killed")
        publish(self, entry)

    monkeypatch.setattr(RunLog, "_publish", fails)
    try:
        ingest.ingest_batch(batch, 0, folder)
    except OSError:
        pass
    monkeypatch.setattr(RunLog, "_publish", publish)
    assert set(ingest.ingested(spark, folder)) == {"errors", "timeline"}
    ingest.ingest_batch(batch, 0, folder)
    got = tables(spark, folder)
    assert len(got["errors"]) == 1 and len(got["timeline"]) == 6 and [r[1] for r in got["results"]] == ["u"]


def test_an_ingesting_stream_is_taken_up_again(spark, tmp_path):
    for rows in LINES:
        arrive(spark.createDataFrame(rows, "seq bigint, line string"), str(tmp_path / "in"))
        ingest.ingest_stream(spark.readStream.schema("seq bigint, line string").parquet(str(tmp_path / "in")), str(tmp_path / "t"), 2).awaitTermination()
    ingest.ingest_stream(spark.readStream.schema("seq bigint, line string").parquet(str(tmp_path / "in")), str(tmp_path / "t"), 2).awaitTermination()
    got = tables(spark, str(tmp_path / "t"))
    assert [r[0] for r in got["results"]] == [12, 15] and len(got["errors"]) == 3 and len(got["timeline"]) == 15
