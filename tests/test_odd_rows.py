"""Queries against their SQL, and plans, on rows that the smallest tables lack."""

import re
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pytest

from gossamer.llm import lm
from gossamer.operators import extract
from gossamer.plans import catalogue


def same_as_sql(spark, folder, name, table, df: pd.DataFrame):
    df.to_parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = catalogue.queries()[name](spark, str(folder)).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_documents_meet_their_addresses_by_key(spark):
    fetched = spark.range(9).selectExpr("concat('https://x/', id, '.pdf') AS url", "cast('a@x.org' AS binary) AS content", "'' AS content_type")
    files = spark.range(9).selectExpr("concat('https://x/', id, '.pdf') AS url")
    joins = re.findall(r"\w+Join", extract.harvest_documents(files, fetched)._jdf.queryExecution().executedPlan().toString())
    assert joins and set(joins) == {"SortMergeJoin"}


def test_checksums_of_archives_are_no_findings(spark, tmp_path):
    # The archive of part 93016 has a checksum that reads as "c:" and a backslash.
    parts = pd.DataFrame({"p_partkey": [93016, 52824, 63302, 7], "p_name": "hot bolt", "p_size": pd.array([3, 3, 3, 2], "int32")})
    same_as_sql(spark, tmp_path, "documents_of_parts", "part", parts)


def test_keys_that_hold_404_are_no_dead_addresses(spark, tmp_path):
    keys = [k for k in range(40_000) if "404" in str(k)] + list(range(9))
    same_as_sql(spark, tmp_path, "input_kinds_of_customers", "customer", pd.DataFrame({"c_custkey": keys}))


@pytest.mark.parametrize("name", ["story_records", "strip_tags", "visible_text"])
def test_references_that_the_end_cut_off_stay(spark, tmp_path, name):
    html = ['<html lang="en"><title>Ä &amp;&amp; b&amp</title><p>x &lt; y&amp</p>', "<title>R&D &amp;amp; &am</title><p>a && b &lt</p>", "<title>no</title>", None]
    urls = [f"https://h{i}.example.com/p" for i in range(len(html))]
    same_as_sql(spark, tmp_path, name, "pages", pd.DataFrame({"page_id": range(len(html)), "url": urls, "html": html}))


def test_quotes_that_the_end_cut_off_are_none(spark, tmp_path):
    html = ["<title>a</title><p>x &quot;one that is cut off&quot</p>", "<title>b</title><p>x &quot;one that is whole&quot; and &quot</p><p>one more, &quot;whole again&quot;</p>",
            '<title>c&quot</title><a href="https://h2.example.com/?a=1&b=2"></a><a href="https://h2.example.com/?a=1&amp;b=2"></a><a href="https://x.example.org/&quot"></a>']
    urls = [f"https://h{i}.example.com/p" for i in range(len(html))]
    same_as_sql(spark, tmp_path, "story_relations", "pages", pd.DataFrame({"page_id": range(len(html)), "url": urls, "html": html}))


def test_a_chunk_holds_numbers_of_words_not_words():
    text = " ".join(f"{i:040b}" for i in range(100_000)).encode()
    chunk = lm._Chunk(0, lm.DEPTH)
    tracemalloc.start()
    chunk.add([text], np.array([False]))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 8_000_000
    assert sum(rows["token"].notna().sum() for rows in chunk.rows()) == 100_001
