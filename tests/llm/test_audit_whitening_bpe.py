"""Filter audit, whitening and byte-pair encoding against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gossamer.llm import bpe, common, filter_audit, queries, whitening

DATA = "/root/testdata/sf0.001"


# Filter audit


def brute_masks(rows):
    """(doc_id, text, source) -> Counter of (part, mask)."""
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    out = []
    for d, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), d is not None and d > first[t])
        out.append((d, s or "", sum(f << k for k, f in enumerate(fails))))
    return out


def brute_audit(rows, labels):
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    masks = brute_masks(rows)
    out = {}
    for part in {p for _, p, _ in masks}:
        for order in permutations("ABCDE"):
            for step in range(5):
                bit, before = 1 << "ABCDE".index(order[step]), sum(1 << "ABCDE".index(c) for c in order[:step])
                own = [(d, m) for d, p, m in masks if p == part]
                gone = [d for d, m in own if m & bit and not m & before]
                out[part, "".join(order), step + 1] = [
                    sum(not m & (bit | before) for _, m in own), len(gone), sum(bool(m & bit and m & before) for _, m in own), sum(m == bit for _, m in own),
                    sum(d in good for d in gone), sum(d in toxic for d in gone),
                ]
    total = Counter()
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] += v[1]
    return {k: [*v, total[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LONG = " ".join(f"word{i}" for i in range(40_000))
TEXTS = ["", " \n", "Short", "short # text", LONG, LONG + "x", LONG[:-1] + "y", "AB " * 60, " ".join(f"w{i}" for i in range(60)), "é" * 64, "é" * 63 + "e", "日本 " * 400]


def edge_rows():
    rng = random.Random(4)
    rows = [(i, rng.choice(TEXTS), rng.choice(["a", "b", None, ""])) for i in range(60)] + [(None, TEXTS[2], "a"), (None, None, None), (-5, None, "b"), (7, TEXTS[8], "a"), (7, TEXTS[8], "a"), (8, TEXTS[8], "c")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(2, 1, 1), (None, 1, 1), (99, 1, 1)]
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({c: F.lit("clash") for c in ("length", "hashes", "class", "n", "content", "part", "mask", "duplicate", "first")})
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("clash"))


def audited(spark, rows, labels):
    got = filter_audit.audit(*frames(spark, rows, labels))
    assert got.columns == ["part", "filter_order", "step", *MEASURES]
    return {(r.part, r.filter_order, r.step): [r[m] for m in MEASURES] for r in got.collect()}


def test_audit_equals_brute_force_on_edges(spark):
    rows, labels = edge_rows()
    assert audited(spark, rows, labels) == brute_audit(rows, labels)


def test_audit_on_a_hot_class_and_where_classes_are_too_many_to_broadcast(spark, monkeypatch):
    rows = [(i, TEXTS[8] if i % 3 else f"{TEXTS[8]} {i}", "hot" if i % 2 else "b") for i in range(1500)]
    labels = [(i, i % 2, i % 5 == 0) for i in range(0, 1500, 7)]
    labels = [(a, b, int(c)) for a, b, c in labels]
    want = brute_audit(rows, labels)
    monkeypatch.setattr(common, "hot_bound", lambda n: 50)
    assert audited(spark, rows, labels) == want
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert audited(spark, rows, labels) == want


def test_unlike_texts_with_equal_hashes_are_told_apart(spark, monkeypatch):
    """All hashes equal: every text of a length reaches the comparison of full texts."""
    monkeypatch.setattr(filter_audit, "block_hashes", lambda: F.array(F.lit(1).cast("bigint")))
    rows, labels = edge_rows()
    assert audited(spark, rows, labels) == brute_audit(rows, labels)


def test_blocks_cover_a_text_and_a_change_anywhere_changes_the_class(spark):
    texts = ["a" * n for n in (0, 1, 63, 64, 65, 319, 320, 321, 1344, 5000)]
    texts += [t[:k] + "b" + t[k + 1 :] for t in texts for k in {0, len(t) // 2, len(t) - 1} if 0 <= k < len(t)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("length", F.length("text"))
    assert df.select(filter_audit.last_class().alias("c")).distinct().count() == len(set(texts))


def test_audit_of_nothing(spark):
    assert audited(spark, [], []) == {}
    assert set(map(tuple, audited(spark, [(1, "x", "s")], []).values())) <= {(0, 1, 0, 1, 0, 0, 120), (0, 0, 1, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0, 0), (1, 0, 0, 0, 0, 0, 0)}


# Whitening


def check_whitening(rows, got, width):
    """rows (vec_id, vector of finite entries, filled up), got as collected."""
    x = np.array([np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000 for _, v in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    off = (n * fit - s) / n
    values, vectors = np.linalg.eigh(off.T @ off / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = max(r.component for r in got)
    assert k == min(16, int((values > 1e-13 * values[0]).sum())) and len(got) == k * len(rows)
    w = np.full((len(rows), k), np.nan)
    order = {i: [] for i, _ in rows}
    for place, (i, _) in enumerate(rows):
        order[i].append(place)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for (i, c), told in by.items():
        assert len(told) == len(order[i])
        for place, r in zip(sorted(order[i], key=lambda p: tuple(x[p])), sorted(told, key=lambda r: (r.deviation, r.whitened)), strict=True):
            w[place, c - 1] = r.whitened
            assert r.n == n and r.explained == pytest.approx(values[c - 1] / (off**2).sum() * n, rel=1e-8) and abs(r.identity_error) < 1e-6
            if len(order[i]) == 1:
                assert r.deviation == sum((int(n) * int(a) - int(b)) ** 2 for a, b in zip(x[place], s))
    want = ((n * x - s) / n) @ vectors[:, :k] / np.sqrt(values[:k])
    turned = np.sign((w * want).sum(0))
    gaps = np.abs(np.diff(values[: k + 1])) / values[0] > 1e-6
    for c in range(k):
        if gaps[max(c - 1, 0)] and (c >= len(gaps) or gaps[c]):
            assert np.abs(w[:, c] - turned[c] * want[:, c]).max() < 1e-6


def test_whitening_equals_the_eigenvectors(spark):
    got = queries.op12_whitening(spark, DATA).collect()
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet'").fetchall()
    check_whitening(rows, got, 64)


def test_whitening_edges(spark):
    rng = np.random.default_rng(1)
    good = [(i, (rng.normal(size=5) * [1, 2, 3, 4, 0]).tolist()) for i in range(40)]
    repeated = [(3, good[3][1]), (100, good[0][1]), (101, good[0][1]), (None, good[5][1])]
    odd = [(200, None), (201, [1.0, None, 2.0, 0.0, 0.0]), (202, [1.0, float("nan"), 0.0, 0.0, 0.0]), (203, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (204, [1e300, 0.0, 0.0, 0.0, 0.0])]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"x": F.lit("clash"), "component": F.lit(1)})
    check_whitening(good + repeated, whitening.whiten(spark, frame(good + repeated + odd)).collect(), 5)
    for none in ([], odd, [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.001, 2.0])]):
        assert whitening.whiten(spark, frame(none)).count() == 0
    short = [(1, [1.0]), (2, [0.0, 3.0]), (3, []), (4, [2.0, -1.0])]
    check_whitening([(i, v + [0.0] * (2 - len(v))) for i, v in short], whitening.whiten(spark, frame(short)).collect(), 2)


def test_deviations_beyond_a_long_are_null_and_the_rest_stays(spark):
    rows = [(i, [float(i) * 1e8, float(i % 3) * 1e7]) for i in range(20)]
    got = whitening.whiten(spark, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r.deviation for r in got if r.vec_id in (0, 19)} == {None} and len(got) == 40
    assert sum(r.explained for r in got if r.vec_id == 0) == pytest.approx(1) and got[0].identity_error < 1e-6


def test_many_dimensions_go_another_way_through_mllib(spark, monkeypatch):
    monkeypatch.setattr(whitening, "WHOLE", 10)
    rng = np.random.default_rng(2)
    scale = np.concatenate([np.linspace(9, 3, 20), np.ones(130)])
    rows = [(i, (rng.normal(size=150) * scale).tolist()) for i in range(400)]
    check_whitening(rows, whitening.whiten(spark, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect(), 150)


# Byte-pair encoding


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    told = Tokenizer.from_file(bpe.default_path())
    told.encode_special_tokens = True
    return told


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary_of(bpe.default_path())


def test_every_text_is_encoded_and_decoded_like_the_library(spark, library):
    got = {r.doc_id: r for r in queries.op13_bpe(spark, DATA).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = got[doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))


def test_random_texts(library, vocabulary):
    rng = random.Random(5)
    letters = list("ab e'stdrlvmABC\n\t    é日本1٣!?.́_") + [chr(rng.randrange(0x250, 0x3000)) for _ in range(40)] + ["😀", "<|endoftext|>", "\x85", "\x1c", "​", "﻿", "\U00010940", "՘", "  ", "the", " of"]
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(4000)]
    encoder = bpe.Encoder(vocabulary)
    got, want = encoder(texts), [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [g.tolist() for g in got] == want
    assert [vocabulary.decode(g) for g in got] == [library.decode(w, skip_special_tokens=False) for w in want]


def test_characters_are_classed_like_the_library(library, vocabulary):
    """Every character of the planes in use, beside letters, figures, signs and blanks."""
    encoder = bpe.Encoder(vocabulary)
    for c in [*range(0x20, 0x3400, 3), *range(0xA000, 0xD800, 5), *range(0xE000, 0x20000, 7), 0x1CEB3, 0x32500, 0x10FFFF]:
        text = f"a{chr(c)}b{chr(c)}{chr(c)}1{chr(c)}.{chr(c)} x {chr(c)}"
        ends = np.cumsum([len(w) for w in encoder.words(text)]).tolist()
        assert ends == [e for _, (_, e) in library.pre_tokenizer.pre_tokenize_str(text)], hex(c)


def test_compatible_pairs_are_those_that_merging_leaves(vocabulary):
    rng = np.random.default_rng(6)
    known = np.flatnonzero(vocabulary.made < bpe.NEVER)
    a, b = rng.choice(known, (2, 20_000))
    # Pairs that do occur on both sides of the question: the halves of tokens, and tokens that begin or end alike.
    whole = rng.choice(np.flatnonzero((vocabulary.made >= 0) & (vocabulary.made < bpe.NEVER)), 5_000)
    a, b = np.concatenate([a, vocabulary.left[whole], whole]), np.concatenate([b, vocabulary.right[whole], whole])
    got = vocabulary.compatible(a, b)
    assert got.any() and not got.all()
    for x, y, ok in zip(a.tolist(), b.tolist(), got.tolist(), strict=True):
        assert ok == (vocabulary.merge(vocabulary.tokens[x] + vocabulary.tokens[y]) == [x, y])


def test_merging_many_words_equals_merging_each(vocabulary):
    rng = random.Random(7)
    words = [bytes(rng.choices(b"abcde the\xc3\xa9", k=rng.randrange(1, 80))) for _ in range(3000)]
    ids, counts = vocabulary.merge_all(words)
    for word, part in zip(words, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert part.tolist() == vocabulary.merge(word)


def test_long_words_texts_and_a_full_memory(library, vocabulary, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 1000)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    monkeypatch.setattr(bpe, "LONG_PART", 500)
    texts = ["a" * 5000, "".join(rng.choices("abcdefgh", k=4000)), " " * 3000 + "x" + "\n" * 2500, "one two  three\n" * 900, "", "é" * 3000, "".join(rng.choices("ab  \n'1", k=6000))]
    got = bpe.Encoder(vocabulary)(texts)
    assert [g.tolist() for g in got] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [vocabulary.decode(g) for g in got] == texts


def test_encoding_edges(spark, library):
    rows = [(1, None), (2, ""), (None, "null id"), (3, "twice"), (3, "twice"), (4, " \n "), (5, "word " * 300_000), (6, "日本" * 10)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"ids": F.lit("clash"), "decoded": F.lit(1), "__text": F.lit(2)})
    got = bpe.encode(frame, decoded=True).collect()
    key = lambda r: (str(r[0]), r[1] or "")
    assert sorted(((r.doc_id, r.decoded) for r in got), key=key) == sorted(((d, t or "") for d, t in rows), key=key)
    assert all(r.ids == library.encode(r.decoded, add_special_tokens=False).ids for r in got)
    back = bpe.decode(bpe.encode(frame).withColumn("decoded", F.lit("clash"))).collect()
    assert sorted((r.decoded for r in back)) == sorted(t or "" for _, t in rows)
    assert bpe.encode(frame.limit(0), decoded=True).count() == 0
    odd = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    assert bpe.encode(odd, decoded=True).first().decoded == "a�b"
    told = bpe.decode(spark.sql("SELECT 1L AS doc_id, array(64, -1, 99999999, null, 65) AS ids UNION ALL SELECT 2L, null")).collect()
    assert sorted(r.decoded for r in told) == ["", "ab"]
