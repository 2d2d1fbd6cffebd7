"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns: each has its defined result."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gossamer.llm import ann, chat, components, embed_dedup, labelled, lm, minhash, mixing, packing, pii, quality, toxicity
from gossamer.llm.common import Scratch

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word " * 30_000
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "same words in a row here", "en", "a", 1), (3, "same words in a row here", "en", "a", 1),
    (None, "no id at all", "en", "b", 1), (5, LONG, "en", "b", 1), (6, "same words in a row here", None, None, 1), (7, " \n\t ", "en", "a", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing(spark, docs, none):
    got = mixing.plan_mix(docs.withColumn("size", F.lit(-1)).withColumn("extra", F.lit("x")))
    rows = got.collect()
    assert len(rows) == len(ROWS) and {r.size for r in rows if r.doc_id in (1, 2, 7)} == {0} and "extra" in got.columns
    assert mixing.emit_mix(got).columns == [*docs.columns, "extra"]
    assert mixing.plan_mix(none).count() == 0


def test_targets_reshare_what_is_above_the_cap(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 10), (None, 0)], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["b"] == 30 and got["c"] == 30 and got[None] == 0 and got["a"] == pytest.approx(60)


def test_chat(spark):
    rows = [
        (1, 0, "user", None), (1, 0, "user", "</s>[INST] [\\INST] <\\\\s>"), (None, 1, None, "x"), (2, 1, "assistant", "[/INST]</s>\n"), (2, None, "sys\\n\ntem", "é" * 5000), (2, 1, "assistant", "[/INST]</s>\n"), (2, 2, "</s>", "<s"),
    ]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("clash")))
    got = {r.conv_id: r for r in made.collect()}
    assert all(r.round_trip for r in got.values()) and set(got) == {1, 2, None}
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert back[1].n_turns == 2 and back[2].loss_chars == 2 * len("[/INST]</s>\n")
    assert chat.format_chats(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_escape_is_reversible(spark):
    texts = ["<s>", "<\\s>", "[\\\\INST]", "</s></s>", "<<s>>", "[/INST", "a\\b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t


def test_packing(docs, none):
    got = packing.pack(docs.withColumn("piece", F.lit("clash")), tokenizer_path=None).toPandas()
    assert len(got[got.doc_id == 1]) == 1 and got[got.doc_id == 1]["length"].item() == 1 and len(got[got.doc_id == 3]) == 2
    assert got["doc_id"].isna().sum() == 1 and (got[got.doc_id == 5].sort_values("piece")["length"].tolist()[1:] == [2048] * (len(got[got.doc_id == 5]) - 1))
    assert packing.pack(none).count() == 0


def test_encoders_agree():
    import public_tokenizers

    texts = ["a  b", "don't  'x", "\n\n a\t", "", "ünï côdé 数字 123", "<|endoftext|> x", "a" * 5000, "   x", "emoji 😀😀 !!"]
    a, b = packing.Encoder(), packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert [a(t) for t in texts] == [b(t) for t in texts]


def test_minhash(docs, none):
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(docs.withColumn("component_id", F.lit("clash"))).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, True), 5: (5, True), 6: (3, False), 7: (7, True)}
    kept = minhash.keep_one(docs)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 5, 7] and kept.columns == docs.columns
    assert minhash.near_duplicates(none).count() == 0


def test_consistent_samples_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    agree, want = [], []
    for keep in (200, 320, 380):
        other = np.concatenate([base[:keep], rng.integers(0, 2**63, 400 - keep).astype(np.uint64)])
        w = rng.uniform(0.5, 3, 400)
        hits = [minhash.weighted_samples(np.sort(base + np.uint64(k)), w[np.argsort(base)]) == minhash.weighted_samples(np.sort(other + np.uint64(k)), w[np.argsort(other)]) for k in range(20)]
        agree.append(np.mean(hits))
        want.append(minhash.weighted_jaccard((np.sort(base), w[np.argsort(base)]), (np.sort(other), w[np.argsort(other)])))
    assert np.allclose(agree, want, atol=0.06)


def test_mixed_buckets_are_compared_in_full(spark):
    """Members of a bucket that its smallest member is not like, but that are like one another."""
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(400)]
    left, right = list(rng.permutation(words)), list(rng.permutation(words))
    rows = [(0, " ".join(left))] + [(10 + k, " ".join([*right[:395], f"x{k}"])) for k in range(6)]
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id bigint, text string, key string")
    sig = minhash.signatures(df.select("doc_id", "text"), minhash.Weigher(7, np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    mixed = df.select(F.lit(1).cast("bigint").alias("key"), "doc_id", F.col("doc_id").alias("component"), F.lit(False).alias("main"), F.lit(0).cast("bigint").alias("n_main"), F.lit(7).cast("bigint").alias("n_rest"))
    links = minhash._cross_links(mixed, sig, 0.8)
    got = components.connected_components(links, Scratch(spark)).collect()
    assert {r.id for r in got} == {10 + k for k in range(6)} and {r.component for r in got} == {10}


@pytest.mark.parametrize("local", [0, 100, 16_384])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    rng = np.random.default_rng(4)
    chain = [(i, i + 1) for i in range(0, 300)] + [(500, 900), (900, 500), (7, 7)]
    rng.shuffle(chain)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in chain], "a bigint, b bigint").repartition(4)
    got = {r.id: r.component for r in components.connected_components(edges, Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(301)} | {500: 500, 900: 500}
    assert components.connected_components(edges.limit(0), Scratch(spark)).count() == 0


VECTORS = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 0.0]), (8, [0.0, 1.0]), (8, [0.0, 1.0]), (9, [1.0]), (10, [])]


def test_embedding_edges(spark):
    frame = spark.createDataFrame(VECTORS, "vec_id bigint, embedding array<float>").withColumn("n_links", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(frame).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[9] == (2, 1, False) and got[8] == (0, 8, True)
    assert all(got[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 10)) and len(got) == 10
    assert embed_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_search_edges(spark):
    frame = spark.createDataFrame(VECTORS, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(frame, F.col("vec_id").isin(1, 3, 8), 2).collect()]
    assert sorted(got) == [(1, 1, 2, 2.0), (1, 2, 9, 1.0), (8, 1, 1, 0.0), (8, 2, 2, 0.0)]
    assert ann.search(frame.limit(0), F.col("vec_id") > 0).count() == 0


def test_toxicity_edges(spark, docs, none):
    labels = spark.createDataFrame([(3, 0, 1), (6, 1, 0), (None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit_from_tables(docs, labels)
    got = toxicity.score_documents(docs.withColumn("toxicity_score", F.lit("clash")), model)
    assert got.count() == len(ROWS) and got.where("toxicity_score BETWEEN 0 AND 1").count() == len(ROWS)
    empty = toxicity.fit_from_tables(none, labels.limit(0))
    assert toxicity.score_documents(none, empty).count() == 0


def test_automaton_accepts_what_is_near():
    def edits(a, b):
        d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    terms = ["idiot", "pathetic", "scum", "worthless"]
    auto = toxicity.LexiconAutomaton(terms)
    rng = np.random.default_rng(0)
    for _ in range(3000):
        term = terms[rng.integers(4)]
        word = list(term)
        for _ in range(rng.integers(0, 4)):
            k = rng.integers(len(word) + 1)
            if rng.random() < 0.5 and k < len(word):
                word[k] = "abcdeiost"[rng.integers(9)]
            elif rng.random() < 0.5:
                word.insert(k, "aeiot"[rng.integers(5)])
            elif k < len(word) > 1:
                del word[k]
        word = "".join(word) + str(rng.choice(["", "", "s", "ity", "zq", "ness"]))
        begins = [word, *(word[:k] for k in range(5, len(word)) if word[k:] in toxicity.ENDINGS)]
        near = any(word.startswith(t) or any(len(w) >= 5 and edits(w, t) <= toxicity.edits_allowed(t) for w in begins) for t in terms)
        assert (auto.match(word) is not None) == near, word


def test_quotation_weighs_less_than_abuse():
    score = toxicity.ToxicityModel({"idiot": 3.0}).scorer()
    assert score.features("you are an idiot")[0] > score.features('he said "what an idiot" to them')[0] > 0
    assert score.features("an 1d10t and an idoit")[0] > 0 and score.features("nothing here")[0] == 0


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 0), (5, 1, 1), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit_from_tables(docs, labels)
    got = quality.score_documents(docs, model)
    assert got.count() == len(ROWS) and got.where("quality_score BETWEEN 0 AND 1").count() == len(ROWS)
    empty = quality.fit_from_tables(none, labels.limit(0))
    assert quality.score_documents(docs, empty).where("quality_score = 0.5").count() == len(ROWS)


def test_pii_edges(spark, docs, none):
    got = pii.find_pii(docs.withColumn("spans", F.lit("clash")))
    assert got.count() == len(ROWS) and got.where("size(spans) > 0").count() == 0
    assert pii.redact(got).columns == docs.columns
    assert pii.find_pii(none).count() == 0
    text = "9" * 20_000 + " mail joe (at) example (dot) com or +1 (555) 123-4567, " + "a." * 5000 + "é a@b.co"
    row = pii.redact(pii.find_pii(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))).first()
    assert "[EMAIL]" in row.text and "[PHONE]" in row.text and row.text.endswith("é [EMAIL]") and "a@b" not in row.text


def test_em_finds_the_unreliable_labeler():
    rows = [("11---", 500), ("00---", 500), ("10---", 20), ("01---", 20), ("111--", 250), ("000--", 250), ("110--", 250), ("001--", 250)]
    _, rel, post = pii._expectation_maximisation(rows)
    assert rel[0][0] - rel[0][1] > 0.7 and abs(rel[2][0] - rel[2][1]) < 0.2 and post["11---"] > 0.9 > 0.1 > post["00---"]


def test_lm_edges(docs, none):
    got = lm.score_corpus(docs.withColumn("score", F.lit("clash"))).toPandas()
    assert len(got) == len(ROWS) and got["n_tokens"].min() == 1 and got["score"].max() < 0
    assert lm.score_corpus(none).count() == 0


def test_context_tree_equals_sequential_weighting():
    """Root and one byte of context, by the definition: KT block probabilities, weights, predictive mixture."""
    texts = [b"abab", b"aab", b"bb"]
    joined, places, _ = lm.byte_stream(texts, 1)
    levels = []
    for d in range(2):
        ctx = joined[places - 1].astype(np.int64) if d else np.zeros(len(places), np.int64)
        keys = np.unique(ctx)
        counts = np.zeros((len(keys), 256), np.int64)
        np.add.at(counts, (np.searchsorted(keys, ctx), joined[places]), 1)
        levels.append((keys, counts))
    tree = lm.build_tree(levels)
    assert np.allclose((10.0**tree.logp).sum(1), 1, atol=1e-5)

    def bits(counts, prefix):
        some = [[c for b, c in enumerate(counts) if format(b, "08b").startswith(prefix + bit)] for bit in "01"]
        return sum(some[0]), sum(some[1])

    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - 2 * math.lgamma(0.5)
    want, before = 0.0, 0xFF
    for byte in [*b"ab", 0xFF]:
        code = format(byte, "08b")
        for k in range(8):
            root = bits(levels[0][1][0], code[:k])
            kids = [bits(row, code[:k]) for row in levels[1][1]]
            own = bits(levels[1][1][np.searchsorted(levels[1][0], before)], code[:k])
            stay = math.exp(kt(*root) - np.logaddexp(kt(*root), sum(kt(*x) for x in kids)))
            p = stay * (root[1] + 0.5) / (sum(root) + 1) + (1 - stay) * (own[1] + 0.5) / (sum(own) + 1)
            want += math.log10(p if code[k] == "1" else 1 - p)
        before = byte
    assert tree.score([b"ab"])[0] == pytest.approx(want, abs=1e-4)


def test_lm_tree_holds_every_context_of_the_corpus(spark):
    """Distributed scores equal those of a tree of all contexts in one piece, of strings outside the training too."""
    rng = np.random.default_rng(6)
    texts = [bytes(rng.choice(list(b"abc  de"), rng.integers(0, 60))) for _ in range(40)] + [b"", b"x", "é".encode()]
    # Rare beside the rest of the corpus: a least share of 1e-5 of all bytes would leave its contexts out.
    texts += [b"once upon a time", b"a" * 400_000]
    out = np.arange(len(texts)) % 5 == 2
    depth = lm.DEPTH
    codes, n = lm.count_strings(texts, out, depth)
    levels = []
    for d in range(depth + 1):
        ctx, at = np.unique((codes[n > 0] >> 8) & ((1 << 8 * d) - 1), return_inverse=True)
        counts = np.zeros((len(ctx), 256), np.int64)
        np.add.at(counts, (at, codes[n > 0] & 255), n[n > 0])
        levels.append((ctx, counts))
    table = spark.createDataFrame(list(zip(codes.tolist(), n.tolist())), "code bigint, n bigint")
    got = {r.code: r.logp for r in lm.string_scores(table).collect()}
    assert len(got) == len(codes)
    want = lm.build_tree(levels).score(texts)
    for text, score in zip(texts, want):
        code, _ = lm.string_codes([text], depth)
        assert sum(got[c] for c in code.tolist()) == pytest.approx(score, abs=1e-3 + 1e-7 * len(text))  # build_tree has single precision
    frame = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id bigint, text string")
    scored = {r.doc_id: r.score for r in lm.score_corpus(frame, modulus=1, held=1).collect()}
    # Seen once, never sampled away: cheap by the second half of its bytes, whatever else the corpus holds.
    assert scored[len(texts) - 2] > -16 * 1.5


def test_a_hot_third_of_near_copies_is_linked(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 64))
    centre = rng.normal(size=64)
    x[:1000] = centre / np.linalg.norm(centre) + rng.normal(size=(1000, 64)) * 0.03 / 8
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    got = embed_dedup.near_duplicates(frame).toPandas().set_index("vec_id").sort_index()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    assert (got["n_links"] <= want).all() and got["n_links"].sum() >= 0.9995 * want.sum()
    assert (got["component_id"][:1000] == 0).all()


def test_encoders_agree_on_very_long_white_space():
    import public_tokenizers

    ranks, file = packing.Encoder(), packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for run in (" " * 1_000_000, "\n" * 1_000_000, "\u3000 \t" * 333_334, "\x1c" * 1_000_000):
        for text in (run, f"one{run}two", f"'s {run}", f"{run}x  y{run} \n"):
            assert ranks(text) == file(text)


def brute_classes(texts):
    """The class of each text by comparing all with all."""
    made = list(minhash.text_shingles([minhash.normalise(t) for t in texts]))
    total = sum(len(h) > 0 for h, _ in made)
    u, n = np.unique(np.concatenate([h for h, _ in made]), return_counts=True)
    weigh = minhash.Weigher(total, u[n >= minhash.IDF_SHARE * total], n[n >= minhash.IDF_SHARE * total])
    sets = minhash.Sets([(h, weigh(h, c)) for h, c in made])
    label = np.arange(len(texts))
    for i in range(len(texts) - 1):
        for j in (i + 1 + np.flatnonzero(sets.similarity(i, i + 1, len(texts)) >= minhash.SIMILARITY)).tolist():
            if label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label[label == hi] = lo
    return label.tolist()


def test_a_hot_bucket_of_near_copies_and_strangers(spark):
    """5,000 copies of one text, each with a run of up to twelve words changed, many of them unlike the smallest, and 500 texts with the text's first half."""
    rng = np.random.default_rng(8)
    base = np.array([f"w{k}" for k in rng.integers(0, 3000, 120)])

    def edited(n, tag):
        out = base.copy()
        at = rng.integers(0, 121 - n)
        out[at : at + n] = [f"{tag}{k}" for k in range(n)]
        return " ".join(out)

    texts = [edited(rng.integers(0, 13), f"e{i}x") for i in range(5000)]
    texts += [" ".join([*base[:60], *(f"s{i}x{k}" for k in range(60))]) for i in range(500)]
    order = rng.permutation(len(texts))
    texts = [texts[k] for k in order]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = minhash.near_duplicates(frame).toPandas().sort_values("doc_id")["component_id"].tolist()
    want = brute_classes(texts)
    assert len(set(want)) > 500 and max(np.bincount(want)) > 2000
    # Twelve bands find a pair of similarity 0.8 with probability 0.998, so a text with a single link at the edge may go unseen.
    assert sum(a != b for a, b in zip(got, want, strict=True)) <= 3


def test_blocks_of_mixed_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = np.random.default_rng(3)
    texts = []
    for family in range(6):
        words = [f"f{family}w{k}" for k in range(60)]
        texts += [" ".join([*words[:58], f"x{family}y{k}"]) for k in range(int(rng.integers(2, 12)))]
    rows = [(i, t, i if i % 3 else 0) for i, t in enumerate(texts)]
    sig = minhash.signatures(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), minhash.Weigher(1, np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    n_main = sum(c == 0 for _, _, c in rows)
    mixed = spark.createDataFrame([(7, i, c, c == 0, n_main, len(rows) - n_main) for i, _, c in rows], "key bigint, doc_id bigint, component bigint, main boolean, n_main bigint, n_rest bigint")
    links = [(r.a, r.b) for r in minhash._cross_links(mixed, sig, 0.8).collect()]
    links += [(i, 0) for i, _, c in rows if c == 0]
    family = brute_classes(texts)
    # main ties the families of its members together, so all reachable ones must be in one class
    got = embed_dedup.labels_of(len(rows), np.array([a for a, _ in links]), np.array([b for _, b in links]))
    want = embed_dedup.labels_of(len(rows), *np.array([(i, f) for i, f in enumerate(family)] + [(i, 0) for i, _, c in rows if c == 0]).T)
    assert got.tolist() == want.tolist()


def test_an_id_of_two_texts_ties_their_copies(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(5, a), (5, b), (3, b), (2, a), (9, b), (11, a), (4, "other words that are alone here")]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {5: 2, 3: 2, 2: 2, 9: 2, 11: 2, 4: 4}


BIG = 2**53 + 1


@pytest.fixture(scope="module")
def big_ids(spark):
    """Ids that doubles cannot hold, beside a null one."""
    rows = [(BIG, "one two three"), (None, "four"), (BIG + 2, "five six"), (None, "four")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)


def test_large_ids_beside_nulls_stay_exact(spark, big_ids):
    want = [BIG, BIG + 2]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect() if r.doc_id is not None)
    labels = spark.createDataFrame([(BIG, 1, 1), (BIG + 2, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert ids(packing.pack(big_ids)) == want and packing.pack(big_ids).count() == 4
    assert ids(toxicity.score_documents(big_ids, toxicity.fit_from_tables(big_ids, labels))) == want
    assert ids(quality.score_documents(big_ids, quality.fit_from_tables(big_ids, labels))) == want
    assert ids(lm.score_corpus(big_ids)) == want
    assert ids(minhash.near_duplicates(big_ids)) == want


def test_scores_leave_other_columns_alone(spark, big_ids):
    frame = big_ids.withColumn("toxicity_hits", F.lit(7)).withColumn("score", F.lit("x")).withColumn("many", F.when(F.col("doc_id").isNotNull(), F.col("doc_id")))
    model = toxicity.ToxicityModel({"idiot": 3.0})
    assert toxicity.score_documents(frame, model).columns == [*frame.columns, "toxicity_score"]
    assert {(r.toxicity_hits, r.many) for r in toxicity.score_documents(frame, model).collect()} == {(7, BIG), (7, BIG + 2), (7, None)}


def test_a_third_of_null_ids_is_dealt_to_many_groups(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("the same few words").alias("text"))
    got = packing.pack(rows, capacity=64, group_pieces=300).toPandas()
    assert len(got) == 3000 and got["doc_id"].isna().sum() == 1000
    assert got[got["doc_id"].isna()]["sequence_id"].mod(10).nunique() == 10


def spans_of(spark, text, **more):
    found = pii.candidates(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), **more)
    return sorted((c.kind, c.start, c.end, c.base) for c in found.first().candidates)


def test_pii_of_long_tables_of_figures(spark):
    """A megabyte of short figures, of long ones, and of cards, within seconds: twice the text takes no four times the time."""
    import time

    rng = np.random.default_rng(1)
    short = "\n".join(f"{k:02d}" for k in rng.integers(0, 100, 330_000)) + "\n4111 1111 1111 1111"
    assert spans_of(spark, short) == [("card", len(short) - 19, len(short), True)]
    long = "\n".join(f"{k:014d}" for k in rng.integers(0, 10**14, 70_000))
    took = []
    for text in (long[: len(long) // 2], long):
        began = time.time()
        spans = spans_of(spark, text)
        took.append(time.time() - began)
    assert len(spans) == 70_000 and took[1] < 60 and took[1] < 3.5 * took[0] + 2
    frame = spark.createDataFrame([(1, long)], "doc_id bigint, text string")
    began = time.time()
    row = pii.redact(pii.find_pii(frame)).first()
    assert time.time() - began < 120
    assert row.text.count("[CARD]") == sum(1 for _ in row.text.split("\n") if _ == "[CARD]") > 5_000


def test_pii_candidates_that_touch_base_spans_go(spark):
    text = "x" * 5000 + " 4111-1111-1111-1111 and 555-123-4567, +1 555-123-4567 and joe (at) a.co"
    got = spans_of(spark, text)
    assert [(k, b) for k, _, _, b in got] == [("card", True), ("email", False), ("phone", False), ("phone", True)]


def test_running_folds(spark):
    for n in (0, 1, 2, 3, 10, 17, 400):
        row = spark.range(1).select(pii.running(F.array(*[F.lit(k).cast("bigint") for k in range(n)]) if n else F.array().cast("array<bigint>"), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("s")).first()
        assert row.s == [sum(range(k)) for k in range(n)]


def test_redaction_equals_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcé😀 \n"), 20_000))
    spans = sorted((int(a), int(a + n), k) for a, n, k in zip(rng.integers(0, 19_900, 300), rng.integers(1, 90, 300), rng.choice(["email", "ip"], 300)))
    frame = spark.createDataFrame([(1, text, [(a, 0, b, k, True) for a, b, k in spans])], "doc_id bigint, text string, spans array<struct<start:bigint,rank:int,end:bigint,kind:string,base:boolean>>")
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    assert pii.redact(frame).first().text == "".join(out) + text[at:]


def test_embedding_links_of_many_vectors(spark, monkeypatch):
    """5,000 vectors, a third of them near copies in several blocks, some equal: links as brute force has them."""
    monkeypatch.setattr(embed_dedup, "BLOCK", 300)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(5000, 32))
    x[:1600] = rng.normal(size=32) + rng.normal(size=(1600, 32)) * 0.05
    x[1600:1700] = x[0]
    x[2000:2300] = x[3000:3300] + rng.normal(size=(300, 32)) * 0.1
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    got = embed_dedup.near_duplicates(frame).toPandas().set_index("vec_id").sort_index()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    want = link.sum(1)
    assert len(got) == 5000 and (got["n_links"].to_numpy() <= want).all() and got["n_links"].sum() >= 0.9995 * want.sum()
    label = embed_dedup.labels_of(5000, *np.nonzero(link))
    assert (got["component_id"].to_numpy() == label).mean() > 0.999


def test_pivots_are_apart():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    places = embed_dedup.spread(x, 200, 0.9)
    cos = x[places] @ x[places].T
    np.fill_diagonal(cos, -1)
    assert places[0] == 0 and cos.max() < 0.9
    k = embed_dedup.nearest_pivots(x, x[places], 3)
    assert (x[:50] @ x[places].T)[np.arange(50), k[:50, 0]].tolist() == (x[:50] @ x[places].T).max(1).tolist()


def brute_toxicity(model, text):
    """The score by its definition: each word against each term, no automaton."""
    def edits(a, b):
        d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    tokens, mass, terms, top = text.lower().split(), 0.0, set(), 0.0
    for i, token in enumerate(tokens):
        word = toxicity.clean_word(token)
        starts = [t for t in model.weight if word.startswith(t)]
        near = sorted((e, t) for t in model.weight if word and len(word) >= 5 and abs(len(word) - len(t)) <= 2 and (e := edits(word, t)) <= toxicity.edits_allowed(t))
        if starts:
            term, fuzzy = max(starts, key=len), False
        elif near and word not in model.benign:
            term, fuzzy = near[0][1], True
        else:
            continue
        w = model.weight[term] * (toxicity.FUZZY_FACTOR if fuzzy else 1.0) * toxicity.Scorer.context(tokens, i)
        mass, top = mass + w, max(top, w)
        terms.add(term)
    x = np.array([[math.log1p(mass), math.log1p(1000 * mass / max(20, len(tokens))), math.log1p(len(terms)), top]])
    return float(toxicity.logistic(x, model.coef)[0])


def test_toxicity_query_equals_brute_force(spark):
    from gossamer.llm import queries

    data = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_from_tables(docs.select("doc_id", "text"), labels)
    got = {r.doc_id: r.score for r in queries.op4_toxicity(spark, data).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == pytest.approx(brute_toxicity(model, r.text or ""), abs=1e-9)


def test_quality_query_equals_brute_force(spark):
    import zstandard

    from gossamer.llm import queries

    data = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_from_tables(docs.select("doc_id", "text"), labels)
    size = lambda d, raw: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False).compress(raw))
    got = {r.doc_id: r.score for r in queries.op9_quality(spark, data).collect()}
    for r in docs.limit(60).collect():
        raw = (r.text or "").encode("utf-8", "replace")
        a, b = size(model.good, raw), size(model.bad, raw)
        per, rel = (a - b) / (len(raw) + 32), (a - b) / max(a, b)
        z = np.dot([10 * per, 10 * rel, 100 * per * abs(per), 1], model.coef)
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_targets_of_many_sources_equal_a_plain_loop(spark):
    rng = np.random.default_rng(9)
    sizes = {f"s{k:04d}é" if k % 7 else f"S{k}": int(n) for k, n in enumerate(rng.pareto(0.7, 700) * 100)}
    frame = spark.createDataFrame([*sizes.items(), (None, 50)], "source string, source_size bigint").repartition(5)
    got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    names = [*sorted(sizes, key=lambda s: s.encode()), None]
    size = sizes | {None: 50}
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    fixed: dict = {}
    while True:  # reshare what is above a cap until nothing is
        left, share = sum(size.values()) - sum(fixed.values()), sum(weight[s] for s in names if s not in fixed)
        above = [s for s in names if s not in fixed and 3 * size[s] <= left * weight[s] / share]
        if not above:
            break
        fixed |= {s: 3 * size[s] for s in above}
    assert got == {s: pytest.approx(fixed.get(s, left * weight[s] / share if share else 0)) for s in names}
    assert mixing.source_targets(frame.limit(0)).count() == 0


def test_pipeline_equals_brute_force(spark):
    """All five stages over the smallest table against plain loops; the spans that the method adds are taken from the operator."""
    import hashlib
    import zlib

    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    data = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    got = corpus_pipeline.run(spark, data).toPandas()
    model = toxicity.fit_from_tables(docs, labels)
    rows = sorted((r for r in docs.collect() if brute_toxicity(model, r.text or "") < 0.5), key=lambda r: r.doc_id)
    classes = brute_classes([r.text or "" for r in rows])
    rows = [r for i, r in enumerate(rows) if classes[i] == i]
    kept = spark.createDataFrame(rows, docs.schema)
    spans = {r.doc_id: r.spans for r in pii.find_pii(kept).collect()}
    texts = {}
    for r in rows:
        out, at = [], 0
        for s in spans[r.doc_id]:
            if s.start >= at:
                out += [r.text[at : s.start], f"[{s.kind.upper()}]"]
            at = max(at, s.end)
        texts[r.doc_id] = "".join(out) + r.text[at:] if r.text is not None else ""
    words = {d: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)]) for d, t in texts.items()}
    source = {r.doc_id: r.source for r in rows}
    size: dict = {}
    for d, n in words.items():
        size[source[d]] = size.get(source[d], 0) + n
    target = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(size.items()), "source string, source_size bigint")).collect()}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want = []
    for d, t in texts.items():
        rate = target[source[d]] / size[source[d]] if size[source[d]] else 0.0
        coin = int(hashlib.md5(f"mix-1:{d}".encode()).hexdigest()[:13], 16) / 16**13
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        cut = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        pieces = [(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
        want += pieces * (int(rate) + (coin < rate - int(rate)))
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == sorted(want)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 2048


def test_search_over_many_shares_and_groups(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARE_ROWS", 64)
    monkeypatch.setattr(ann, "GROUP_ROWS", 500)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, 1500)[:, None]
    x[200:260] = x[5]  # one very common vector
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    got = ann.search(frame, F.col("vec_id") % 20 == 0, 10).toPandas()
    found = 0
    for q in range(0, 1500, 20):
        mine = got[got["query_id"] == q].sort_values("rank")
        score = x @ x[q]
        score[q] = -np.inf
        order = np.lexsort((np.arange(1500), -score))[:10]
        assert mine["rank"].tolist() == list(range(1, 11)) and np.allclose(mine["score"], score[mine["vec_id"]], rtol=0, atol=1e-12)
        keys = list(zip(-mine["score"], mine["vec_id"]))
        assert keys == sorted(keys)
        found += len(set(order) & set(mine["vec_id"]))
    assert found >= 0.9 * 75 * 10


def test_where_hashing_misses_the_recall_all_rows_are_compared(spark, monkeypatch):
    monkeypatch.setattr(ann, "WIDTH", 0.05)
    monkeypatch.setattr(ann, "GROUP_ROWS", 100)
    x = np.random.default_rng(3).normal(size=(300, 32))
    hasher = ann.Hasher.draw(32, float(np.sqrt((x * x).sum(1)).max()))
    assert ann.fit_probes(hasher, x, 5) == 82
    got = ann.search(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0, 5).toPandas()
    for q in range(0, 300, 20):
        score = x @ x[q]
        score[q] = -np.inf
        assert got[got["query_id"] == q].sort_values("rank")["vec_id"].tolist() == np.lexsort((np.arange(300), -score))[:5].tolist()


def test_the_sample_of_labels_keeps_to_its_share(spark, docs):
    rows = spark.range(30_000).selectExpr("id AS doc_id", "'x' AS text")
    labels = rows.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic")
    drawn = labelled.training_sample(rows, labels, "toxic", 5, 0, 300)
    assert 220 < len(drawn) < 380 and len(labelled.training_sample(rows, labels, "toxic", 5, 0, 10**9)) > 20_000


def test_a_fallback_dictionary_holds_whole_texts(monkeypatch):
    assert quality.train_dictionary(["abc", "de"]) == b"deabc" and quality.train_dictionary([]) == b""
    monkeypatch.setattr(quality, "DICT_BYTES", 4)
    assert quality.train_dictionary(["abc", "de", "x"]) == b"xde" and quality.train_dictionary(["abcdef"]) == b"abcdef"


def test_of_rows_that_repeat_an_id_the_smallest_text_stays(spark):
    rows = [(1, "b b b b b b", {"k": 1}), (1, "a a a a a a", {"k": 2}), (2, None, None), (2, "z", None), (3, "c", None)]
    got = minhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, extra map<string,int>")).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == [(1, "a a a a a a"), (2, ""), (3, "c")]


def test_quality_of_one_label_alone(spark, docs):
    labels = spark.createDataFrame([(3, 1, 0), (6, 1, 0), (5, None, None), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {round(r.quality_score, 6) for r in quality.score_documents(docs, quality.fit_from_tables(docs, labels, modulus=1, held=1)).collect()}
    assert len(got) == 1 and 0.5 < got.pop() < 1


def test_full_pieces_are_in_no_group(spark, monkeypatch):
    """Long documents give many full pieces and few others; groups hold the others alone."""
    rows = [(i, "one two " * 5_000) for i in range(40)]
    plan = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), capacity=20, group_pieces=16)
    got = plan.toPandas()
    full, others = got[got["length"] == 20], got[got["length"] < 20]
    assert len(full) > 20_000 - 100 and len(others) <= 40 and (full["sequence_id"] < 0).all() and (others["sequence_id"] >= 0).all()
    assert full["sequence_id"].is_unique and (full["offset"] == 0).all()
    groups = max(1, round(len(others) / 16))
    assert others.groupby(others["sequence_id"] % groups).size().max() <= 32
    for _, pieces in got.sort_values("piece").groupby("doc_id"):
        assert pieces["start"].tolist() == [0, *pieces["length"].cumsum().tolist()[:-1]]


def test_inflections_of_misspelled_terms_are_found():
    match = toxicity.LexiconAutomaton(["idiot", "stupid", "scum", "worthless"]).match
    assert [match(w) for w in ("stuupidity", "idoits", "wrothlesly", "idiotic")] == [("stupid", 1), ("idiot", 1), ("worthless", 2), ("idiot", 0)]
    assert [match(w) for w in ("idoitzq", "scam", "scams", "study", "stupor")] == [None] * 5


def test_chunks_are_closed_within_a_batch_of_long_texts(spark, monkeypatch):
    rows = [(i, f"w{i} " * (40 + 400 * (i % 3 == 0))) for i in range(30)] + [(100, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    score = lambda: {r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 3)) for r in lm.score_corpus(docs).collect()}
    want, sizes, add = score(), [], lm._Chunk.add
    monkeypatch.setattr(lm, "CHUNK_BYTES", 1_000)
    assert score() == want
    made = [lm._Chunk(0, 5)]
    for text in (b"a b c", b"d e"):
        add(made[0], [text], np.array([False]))
        sizes.append(made[0].bytes)
    assert sizes == [5, 8]
