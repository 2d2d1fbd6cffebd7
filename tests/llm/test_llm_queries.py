"""The ten operators against SQL or brute force on the small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from gossamer.llm import embed_dedup, minhash, packing, queries

DATA = "/root/testdata/sf0.001"


def read(name):
    return duckdb.sql(f"SELECT * FROM '{DATA}/{name}.parquet'").fetchall()


def sorted_rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted_rows(got) == sorted_rows(want)


def test_packing_is_exact_gapless_and_tight(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    got = queries.op2_pack(spark, DATA).toPandas()
    ids = {d: tok.encode(t or "", add_special_tokens=False).ids + [0] for d, t, *_ in read("documents")}
    assert len(got.groupby("doc_id")) == len(ids)
    for d, pieces in got.sort_values("piece").groupby("doc_id"):
        at = 0
        for i, p in enumerate(pieces.itertuples()):
            assert (p.piece, p.start) == (i, at)
            assert zlib.crc32(np.array(ids[d][at : at + p.length], "<u4").tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids[d]) and (len(pieces) == 1 or at > 2048)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= math.ceil(got["length"].sum() / 2048) * 1.03 + 1


def test_sum_of_squares_follows_its_rule():
    rng = np.random.default_rng(1)
    lengths, cap = rng.integers(1, 21, 200), 20
    seq, off = packing.sum_of_squares(lengths, cap)
    level: dict[int, int] = {}
    for n, s, o in zip(lengths, seq, off):
        score = lambda lv: sum(v * v for g, v in Counter(cap - x for x in lv.values()).items() if g)
        best = min(score(level | {b: x + n}) for b, x in [*level.items(), (-1, 0)] if x + n <= cap)
        assert o == level.get(s, 0)
        level[s] = level.get(s, 0) + n
        assert score(level) == best


@pytest.mark.parametrize("name,label,modulus,held", [("op4_toxicity", 2, 5, 0), ("op9_quality", 1, 3, 1)])
def test_classifiers_beat_the_majority_on_held_out_rows(spark, name, label, modulus, held):
    data = "/root/testdata/sf0.01"
    got = queries.queries()[name](spark, data).toPandas().set_index("doc_id")
    rows = [r for r in duckdb.sql(f"SELECT * FROM '{data}/labels.parquet'").fetchall() if zlib.crc32(str(r[0]).encode()) % modulus == held]
    y, p = np.array([r[label] for r in rows]), got.loc[[r[0] for r in rows]]
    assert p["held_out"].all() and got["score"].between(0, 1).all()
    assert ((p["score"] >= 0.5).astype(int) == p["predicted"]).all()
    assert (p["predicted"].to_numpy() == y).mean() > max(y.mean(), 1 - y.mean()) + 0.02


def test_mix_comes_near_its_targets(spark):
    got = queries.op5_mix(spark, "/root/testdata/sf0.1").toPandas()
    assert (got["taken"] <= 3 * got["size"]).all()
    by = got.groupby(["source_size", "target"]).agg(size=("size", "sum"), taken=("taken", "sum"), spread=("size", lambda s: float(np.sqrt((s.astype(float) ** 2).sum())) / 2)).reset_index()
    assert (abs(by["taken"] - by["target"]) <= 4 * by["spread"] + 1).all()
    assert by["target"].sum() == pytest.approx(by["size"].sum())


def test_minhash_classes_equal_brute_force(spark):
    got = queries.op7_minhash_dedup(spark, DATA).toPandas().set_index("doc_id")
    docs = sorted((r[0], r[1]) for r in read("documents"))
    made = list(minhash.text_shingles([minhash.normalise(t) for _, t in docs]))
    total = sum(len(h) > 0 for h, _ in made)
    u, n = np.unique(np.concatenate([h for h, _ in made]), return_counts=True)
    often = n >= minhash.IDF_SHARE * total
    weigh = minhash.Weigher(total, u[often], n[often])
    sets = [(h, weigh(h, c)) for h, c in made]
    lists = defaultdict(list)
    for i, (h, _) in enumerate(sets):
        for x in h.tolist():
            lists[x].append(i)
    pairs = {(a, b) for v in lists.values() for a in v for b in v if a < b}
    linked = [(a, b) for a, b in pairs if minhash.weighted_jaccard(sets[a], sets[b]) >= 0.8]
    label = embed_dedup.labels_of(len(docs), np.array([a for a, _ in linked], int), np.array([b for _, b in linked], int))
    assert [got.loc[d, "component_id"] for d, _ in docs] == [docs[k][0] for k in label]


def vectors():
    rows = sorted(read("embeddings"))
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.2, base[:10] * 3])
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    got = embed_dedup.near_duplicates(frame).toPandas().set_index("vec_id").sort_index()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    assert got["n_links"].tolist() == link.sum(1).tolist()
    assert got["component_id"].tolist() == embed_dedup.labels_of(len(x), *np.nonzero(link)).tolist()


def test_nearest_neighbours_reach_their_recall(spark):
    got = queries.op6_ann(spark, DATA).toPandas()
    ids, x = vectors()
    found = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]])
        mine = got[got["query_id"] == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        assert np.allclose(mine["score"], score[np.searchsorted(ids, mine["vec_id"])], rtol=0, atol=1e-12)
        found, total = found + len(best & set(mine["vec_id"])), total + 20
    assert found / total >= 0.9


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    digits = lambda v: re.sub("[^0-9]", "", v)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
    ]
    out = [(m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(rules) for m in re.finditer(p, t) if ok(m.group())]
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out))


def test_pii_base_spans_equal_brute_force(spark):
    got = queries.op8_pii(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    for d, t in duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall():
        want = base_spans(t or "")
        assert got.loc[d, "base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got.loc[d, "spans"].split(","))


def test_lm_base_equals_brute_force_and_model_learns(spark):
    got = queries.op10_lm_score(spark, DATA).toPandas().set_index("doc_id")
    tokens = lambda t: (t or "").encode().lower().split() + [b" "]
    docs = [(r[0], r[1]) for r in read("documents")]
    count = Counter(x for d, t in docs if zlib.crc32(str(d).encode()) % 7 != 2 for x in tokens(t))
    n, v = sum(count.values()), len(count)
    for d, t in docs:
        row = got.loc[d]
        assert row["n_tokens"] == len(tokens(t)) and row["n_known"] == sum(count[x] > 0 for x in tokens(t)) and row["train_tokens"] == n
        assert row["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens(t)), rel=1e-9)
    size = pd.Series({d: len((t or "").encode()) + 1 for d, t in docs})
    held = got.index[got["held_out"]]
    assert -got.loc[held, "score"].sum() / math.log10(2) / size[held].sum() < 3.0


def test_pipeline_keeps_whole_words_of_clean_documents(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.count() > 0.5 * n
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() >= docs.count()
