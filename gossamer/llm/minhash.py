"""MinHash near-duplicates: improved consistent weighted sampling over TF-IDF word shingles.

A shingle is five consecutive words (all words of a shorter text). It weighs its count in the text times an idf
of (1 + ln(1/f) / ln(1/IDF_SHARE)) / 2 for a document frequency f, at most 1: shingles in less than
``IDF_SHARE`` of the documents all weigh 1, one in every document weighs a half. The shingles above the share are few whatever the
corpus, so their exact frequencies can be sent everywhere; and a group of copies, however large,
does not push its own members apart, as an unbounded idf does. Equal bands of weighted samples propose pairs;
the weighted Jaccard similarity of the whole texts decides them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_bound, join_groups, small_side
from .components import connected_components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 4
IDF_SHARE = 0.01
#: Documents of a bucket that are compared with as many others in one task.
BLOCK = 256
#: A bucket with more members outside its main component is first compared with so many pivots, round by round.
CROWD, PIVOTS = 256, 8
#: Shingles of one count of frequent ones; sets and pairs of sets that a task writes or compares.
COUNTED, SETS = 4_000_000, 20_000

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _RNG.integers(1, 2**63, WORDS, dtype=np.uint64) | U64(1)
_SEEDS = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many words each text has. The hash is a polynomial of the word's bytes."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gap = _SPACE[joined]
    inside = np.concatenate([[False], ~gap])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    prefix = np.concatenate([[U64(0)], np.cumsum(_BYTE[joined] * _powers(_BASE, len(joined)), dtype=np.uint64)])
    hashes = mix64((prefix[end] - prefix[start]) * _powers(_BASE_INVERSE, len(joined))[start])
    text_end = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    before = np.searchsorted(start, text_end)
    return hashes, np.diff(before, prepend=0)


def text_shingles(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingle hashes, sorted, and their counts."""
    hashes, n_words = word_hashes(texts)
    if len(hashes) >= WORDS:
        runs = np.zeros(len(hashes) - WORDS + 1, np.uint64)
        for k in range(WORDS):
            runs += hashes[k : len(hashes) - WORDS + 1 + k] * _PLACE[k]
        runs = mix64(runs)
    at = 0
    for n in n_words.tolist():
        if n >= WORDS:
            yield np.unique(runs[at : at + n - WORDS + 1], return_counts=True)
        elif n:
            yield mix64(np.array([(hashes[at : at + n] * _PLACE[:n]).sum(dtype=np.uint64) + U64(n)])), np.ones(1, np.int64)
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at += n


def normalise(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def _slices(texts: list[bytes], limit: int = 1_000_000) -> Iterator[tuple[int, list[bytes]]]:
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= limit or i == len(texts) - 1:
            yield lo, texts[lo : i + 1]
            lo, held = i + 1, 0


# --- idf ------------------------------------------------------------------------------------


def frequent_shingles(docs: DataFrame, share: float = IDF_SHARE) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of documents with words, and the shingles in at least ``share`` of them with their exact document frequencies.

    First each run of some ``COUNTED`` shingles tells those that half the share of its own documents hold. A shingle
    above the share over all documents is told often enough that the sum reaches half the share, and no
    more than twice the mean number of shingles over the share can do so. Then those are counted exactly.
    """

    def often(held: list[np.ndarray]) -> pd.DataFrame:
        u, c = np.unique(np.concatenate(held), return_counts=True)
        told = c >= math.ceil(share / 2 * len(held))
        return pd.DataFrame({"shingle": np.append(u[told].view(np.int64), 0), "n": np.append(c[told], 0), "docs": np.append(np.zeros(told.sum(), np.int64), len(held))})

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for _, some in _slices([normalise(t) for t in batch["text"]]):
                for hashes, _ in text_shingles(some):
                    if len(hashes):
                        held.append(hashes)
                        size += len(hashes)
                        if size >= COUNTED:
                            yield often(held)
                            held, size = [], 0
        if held:
            yield often(held)

    parts = docs.select("text").mapInPandas(told, "shingle bigint, n bigint, docs bigint")
    scratch = Scratch(docs.sparkSession)
    sums = scratch.write(parts.groupBy("shingle").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "told")
    total = sums.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    likely = sums.where(F.col("n") >= share / 2 * total).where(F.col("n") > 0).select("shingle").toPandas()["shingle"].to_numpy(np.int64)
    scratch.drop()
    likely = np.sort(likely.view(np.uint64))
    if not len(likely):
        return total, likely, np.zeros(0, np.int64)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(likely), np.int64)
        for batch in batches:
            for _, some in _slices([normalise(t) for t in batch["text"]]):
                for hashes, _ in text_shingles(some):
                    at = np.searchsorted(likely, hashes)
                    at[at == len(likely)] = 0
                    n[at[likely[at] == hashes]] += 1
        yield pd.DataFrame({"shingle": likely.view(np.int64), "n": n})

    exact = docs.select("text").mapInPandas(counted, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).toPandas()
    exact = exact[exact["n"] >= share * total]
    order = np.argsort(exact["shingle"].to_numpy(np.int64).view(np.uint64))
    return total, exact["shingle"].to_numpy(np.int64).view(np.uint64)[order], exact["n"].to_numpy(np.int64)[order]


class Weigher:
    """Weights of a text's shingles: count times idf, which is 1 for the rare ones."""

    def __init__(self, total: int, shingles: np.ndarray, frequency: np.ndarray, share: float = IDF_SHARE):
        self.shingles = shingles
        self.idf = (1 + np.log(max(total, 1) / np.maximum(frequency, 1)) / math.log(1 / share)) / 2

    def __call__(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weight = counts.astype(np.float64)
        if len(self.shingles) and len(hashes):
            at = np.searchsorted(self.shingles, hashes)
            at[at == len(self.shingles)] = 0
            hit = self.shingles[at] == hashes
            weight[hit] *= self.idf[at[hit]]
        return weight


# --- signatures -----------------------------------------------------------------------------


def _gamma2_quantiles(n: int = 65536) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of n equal parts, by bisection."""
    p = (np.arange(n) + 0.5) / n
    lo, hi = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


_GAMMA = _gamma2_quantiles().astype(np.float32)
_LOG_GAMMA = np.log(_gamma2_quantiles()).astype(np.float32)


def weighted_samples(hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One consistent weighted sample (shingle and level, hashed) for each of the BANDS x ROWS hash functions.

    Ioffe's scheme: r, c ~ Gamma(2, 1), b ~ U(0, 1) by shingle and function; t = floor(ln S / r + b),
    ln a = ln c - r (t - b + 1); the least a wins with its t.
    """
    best = np.full(len(_SEEDS), np.inf, np.float32)
    out = np.zeros(len(_SEEDS), np.uint64)
    log_weight = np.log(weight).astype(np.float32)
    cols = np.arange(len(_SEEDS))
    for lo in range(0, len(hashes), 512):
        h = hashes[lo : lo + 512]
        x = h[:, None] * (_SEEDS | U64(1))
        x ^= x >> U64(32)
        x *= _M1
        x ^= x >> U64(29)
        low = x.view(np.uint16).reshape(len(h), len(_SEEDS), 4)
        r = _GAMMA[low[:, :, 0]]
        b = low[:, :, 2].astype(np.float32)
        b *= np.float32(1 / 65536)
        t = np.floor(log_weight[lo : lo + 512, None] / r + b)
        a = _LOG_GAMMA[low[:, :, 3]] - r * (t - b + 1)
        k = a.argmin(0)
        least = a[k, cols]
        win = least < best
        best[win] = least[win]
        out[win] = mix64(h[k] ^ (t[k, cols].astype(np.int64).view(np.uint64) * _M2))[win]
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS)
    key = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        key = mix64(key ^ rows[:, k]) + _M1
    return mix64(key ^ np.arange(BANDS, dtype=np.uint64))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller weights over sum of the larger, of two sorted (hash, weight) pairs."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    at = np.searchsorted(hb, ha)
    at[at == len(hb)] = 0
    same = hb[at] == ha
    least = np.minimum(wa[same], wb[at[same]]).sum()
    return float(least / (wa.sum() + wb.sum() - least))


def pack_set(hashes: np.ndarray, weight: np.ndarray) -> tuple[bytes, bytes]:
    """Shingles as 32-bit hashes in order, and the places and weights of those that do not weigh 1."""
    short = (hashes >> U64(32)).astype("<u4")
    odd = np.flatnonzero(weight != 1.0)
    return short.tobytes(), odd.astype("<u4").tobytes() + weight[odd].astype("<f8").tobytes()


def unpack_set(blob: bytes, odd: bytes) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.frombuffer(blob, "<u4")
    weight = np.ones(len(hashes))
    n = len(odd) // 12
    weight[np.frombuffer(odd[: 4 * n], "<u4")] = np.frombuffer(odd[4 * n :], "<f8")
    return hashes, weight


def signatures(docs: DataFrame, weigher: Weigher) -> DataFrame:
    """(doc_id, keys array<bigint>, same, blob, odd) of the documents that have words and an id; ``same`` is a digest of the weighted set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for lo, some in _slices([normalise(t) for t in batch["text"]]):
                rows = []
                for i, (hashes, counts) in enumerate(text_shingles(some)):
                    if len(hashes):
                        weight = weigher(hashes, counts)
                        blob, odd = pack_set(hashes, weight)
                        same = xxhash.xxh3_128_digest(len(odd).to_bytes(8) + odd + blob)
                        rows.append((int(ids[lo + i]), band_keys(weighted_samples(hashes, weight)).view(np.int64), same, blob, odd))
                yield pd.DataFrame(rows, columns=["doc_id", "keys", "same", "blob", "odd"])

    return docs.mapInPandas(run, "doc_id bigint, keys array<bigint>, same binary, blob binary, odd binary")


# --- pairs ----------------------------------------------------------------------------------


class Sets:
    """Weighted sets of one task over common places, to be held against one another a row at a time."""

    def __init__(self, packed: list[tuple[np.ndarray, np.ndarray]]):
        size = np.fromiter((len(h) for h, _ in packed), np.int64, len(packed))
        self.start = np.concatenate([[0], np.cumsum(size)])
        shingles, self.place = np.unique(np.concatenate([h for h, _ in packed]), return_inverse=True)
        self.weight = np.concatenate([w for _, w in packed])
        self.whole = np.add.reduceat(self.weight, self.start[:-1])
        self.dense = np.zeros(len(shingles))

    def similarity(self, i: int, lo: int, hi: int) -> np.ndarray:
        """Weighted Jaccard similarity of set i with the sets lo..hi."""
        own, at = slice(self.start[i], self.start[i + 1]), slice(self.start[lo], self.start[hi])
        self.dense[self.place[own]] = self.weight[own]
        least = np.add.reduceat(np.minimum(self.dense[self.place[at]], self.weight[at]), self.start[lo:hi] - self.start[lo])
        self.dense[self.place[own]] = 0
        return least / (self.whole[i] + self.whole[lo:hi] - least)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the similarity. The set of an ``a`` of very many pairs is dealt to several tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [
                weighted_jaccard(unpack_set(x.blob_a, x.odd_a), unpack_set(x.blob_b, x.odd_b)) >= similarity
                for x in batch[["blob_a", "odd_a", "blob_b", "odd_b"]].itertuples(index=False)
            ]
            yield batch.loc[keep, ["a", "b"]]

    bound = hot_bound(pairs.count())
    hot = F.broadcast(pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(bound)).alias("parts")).where("parts > 1"))
    side = lambda k: sets.select(F.col("doc_id").alias(k), F.col("blob").alias(f"blob_{k}"), F.col("odd").alias(f"odd_{k}"))
    parts = F.coalesce("parts", F.lit(1))
    asked = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).alias("part"))
    dealt = side("a").join(hot, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("parts")
    # Merge joins at every size: a side that is small enough to broadcast here says nothing of its size elsewhere.
    return asked.hint("merge").join(side("b"), "b").hint("merge").join(dealt, ["a", "part"]).mapInPandas(run, "a bigint, b bigint")


def _mixed(members: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of buckets that hold several components: key, doc_id, component, main, n_main, n_rest.

    ``main`` marks the bucket's largest component if it has more than one member.
    """
    placed = members.where("n > 2").join(classes.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    n = members.count()
    placed = scratch.write(placed, "placed", rows=n)
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    mains = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    mains = mains.select("key", "n", F.col("m.component").alias("most"), F.when(F.col("m.n") > 1, F.col("m.n")).otherwise(F.lit(0)).alias("n_main"))
    mixed = join_groups(placed, scratch.write(mains, "mains", rows=n), "key")
    return mixed.select("key", "doc_id", "component", ((F.col("component") == F.col("most")) & (F.col("n_main") > 0)).alias("main"), "n_main", (F.col("n") - F.col("n_main")).alias("n_rest"))


def _pivot_pairs(crowded: DataFrame, turn: int, scratch: Scratch) -> DataFrame:
    """Pairs of each member with the bucket's ``PIVOTS`` drawn members of other components."""
    drawn = [F.min_by(F.struct("doc_id", "component"), F.xxhash64(F.lit(turn), F.lit(k), "doc_id")) for k in range(PIVOTS)]
    pivots = crowded.groupBy("key").agg(F.count("*").alias("n"), F.array_distinct(F.array(*drawn)).alias("pivots"))
    pairs = join_groups(crowded.select("key", "doc_id", "component"), scratch.write(pivots, "pivots", rows=crowded.count()), "key").withColumn("p", F.explode(F.filter("pivots", lambda p: p["component"] != F.col("component"))))
    return pairs.select(F.least("doc_id", "p.doc_id").alias("a"), F.greatest("doc_id", "p.doc_id").alias("b")).distinct()


def _cross_links(mixed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between members of one bucket that are in different components yet.

    Members outside the main component are taken in blocks against each other and against the blocks of
    main, so no task holds more than two blocks.
    """
    block = lambda n: F.pmod(F.xxhash64(F.lit("block"), "doc_id"), n)
    sized = mixed.withColumn("blocks_main", F.ceil(F.col("n_main") / BLOCK)).withColumn("blocks_rest", F.greatest(F.ceil(F.col("n_rest") / BLOCK), F.lit(1)))
    own = F.when(F.col("main"), block(F.greatest("blocks_main", F.lit(1)))).otherwise(block(F.col("blocks_rest")))
    sized = sized.withColumn("own", own)
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    # A main block meets each block of the others; their own pairs ride along with the first main block they meet.
    cell = lambda i, j, m: F.struct(i.alias("i"), j.alias("j"), m.alias("m"))
    to_main = F.transform(upto(F.col("blocks_rest")), lambda i: cell(i, F.col("own"), F.lit(True)))
    with_main = F.transform(F.when(F.col("blocks_main") > 0, upto(F.greatest("blocks_main", F.lit(1)))).otherwise(F.array().cast("array<bigint>")), lambda j: cell(F.col("own"), j, F.lit(True)))
    rest_rest = F.transform(upto(F.col("blocks_rest")), lambda i: cell(F.least(i, F.col("own")), F.greatest(i, F.col("own")), F.lit(False)))
    cells = sized.select("key", "doc_id", "component", "main", "own", F.explode(F.when(F.col("main"), to_main).otherwise(F.concat(with_main, rest_rest))).alias("cell"))
    with_sets = cells.hint("merge").join(sets.select("doc_id", "blob", "odd"), "doc_id")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        cell = group["cell"].iloc[0]
        # The left block first, so that the right one is a range.
        right = group["main"].to_numpy() if cell["m"] else group["own"].to_numpy() == cell["j"]
        group = group.iloc[np.argsort(right, kind="stable")]
        ids, comp = group["doc_id"].to_numpy(), np.unique(group["component"].to_numpy(), return_inverse=True)[1]
        n, n_left = len(ids), int((~right).sum())
        whole = not cell["m"] and cell["i"] == cell["j"]
        out: list[tuple[int, int]] = []
        if whole and n > 1 or not whole and 0 < n_left < n:
            sets_ = Sets([unpack_set(x, y) for x, y in zip(group["blob"], group["odd"], strict=True)])
            for i in range(n - 1 if whole else n_left):
                lo = i + 1 if whole else n_left
                if (comp[lo:] == comp[i]).all():
                    continue
                near = lo + np.flatnonzero((sets_.similarity(i, lo, n) >= similarity) & (comp[lo:] != comp[i]))
                for j in near.tolist():
                    if comp[j] != comp[i]:
                        comp[comp == comp[j]] = comp[i]
                        out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return with_sets.groupBy("key", "cell").applyInPandas(compare, "a bigint, b bigint")


def _stars(classes: DataFrame) -> DataFrame:
    return classes.where("id != component").select(F.col("id").alias("a"), F.col("component").alias("b"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, idf_share: float = IDF_SHARE) -> DataFrame:
    """Documents (doc_id, text, ...) -> a row per document id: doc_id, component_id, kept.

    component_id is the smallest id of the class; kept marks that document. Classes are the connected
    components of pairs with weighted Jaccard similarity of at least ``similarity``.

    Documents of equal sets are one from the start, the one with the smallest id. Every member of a bucket is compared with its
    smallest member. Buckets that then still hold many members of other components than their largest are compared with
    drawn pivots, as often as that halves them; what is left is compared in full with the rest of its bucket, block by block,
    but for pairs already in one component. So the work grows with the square of a bucket only where its members are unlike.

    Nulls: texts that are null, empty or white space have no shingles and form classes of their own;
    rows with a null id are left out (they cannot be named). Rows of one id are one document that has all
    their texts. Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    total, *frequent = frequent_shingles(src, idf_share)
    weigher = Weigher(total, *frequent, idf_share)
    made = scratch.write(signatures(src, weigher), "signatures")
    named = made.select("doc_id", "same")
    copies = scratch.write(named.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "copies", rows=total)
    copied = scratch.write(join_groups(named, copies, "same").select("doc_id", "first"), "copied", rows=total)
    again = copied.where("doc_id != first").select("doc_id").distinct()
    # An id of several rows may stand for one text and copy another: such ids stay and are linked with what they copy.
    several = scratch.write(named.groupBy("doc_id").count().where("count > 1").select("doc_id"), "several", rows=total)
    gone = scratch.write(again.join(several, "doc_id", "left_anti"), "gone", rows=total)
    bands = scratch.write(made.select("doc_id", "keys").join(gone, "doc_id", "left_anti").select("doc_id", F.explode(F.array_distinct("keys")).alias("key")).distinct(), "bands", rows=total * BANDS)
    buckets = scratch.write(bands.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1"), "buckets", rows=total * BANDS)
    members = scratch.write(join_groups(bands, buckets, "key"), "members", rows=total * BANDS)
    n = members.count()
    pairs = scratch.write(members.where("a != doc_id").select("a", F.col("doc_id").alias("b")).distinct(), "pairs", rows=n)
    needed = members.select("doc_id").distinct()
    sets = scratch.write(made.select("doc_id", "blob", "odd").join(needed.hint("merge"), "doc_id", "left_semi"), "sets", rows=min(n, total), per_file=SETS)
    links = _verified(pairs, sets, similarity).unionByName(copied.join(several, "doc_id").where("doc_id != first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")))
    classes = scratch.write(connected_components(scratch.write(links, "links", rows=pairs.count(), per_file=SETS), scratch), "classes", rows=n)
    crowd, turn = math.inf, 0
    while True:
        mixed = scratch.write(_mixed(members, classes, scratch), "mixed", rows=n)
        left = mixed.where((F.col("n_rest") > CROWD) & ~F.col("main")).count()
        if left == 0 or left > crowd / 2:
            break
        crowd, turn = left, turn + 1
        pairs = scratch.write(_pivot_pairs(mixed.where(F.col("n_rest") > CROWD), turn, scratch), "pairs", rows=left * PIVOTS)
        found = scratch.write(_verified(pairs, sets, similarity), "found", rows=pairs.count(), per_file=SETS)
        classes = scratch.write(connected_components(_stars(classes).unionByName(found), scratch), "classes", rows=n)
    more = scratch.write(_cross_links(mixed, sets, similarity), "more", rows=mixed.count(), per_file=SETS)
    if not more.isEmpty():
        classes = scratch.write(connected_components(_stars(classes).unionByName(more), scratch), "classes", rows=n)
    known = classes.select(F.col("id").alias("first"), "component")
    by_text = scratch.write(copies.join(known, "first", "left").select("same", "n", F.coalesce("component", "first").alias("component")), "by_text", rows=total)
    of_copies = join_groups(named, by_text, "same").join(several, "doc_id", "left_anti").select("doc_id", "component")
    rest = classes.select(F.col("id").alias("doc_id"), "component").join(copied.join(several, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_anti")
    labels = scratch.write(of_copies.unionByName(rest), "labels", rows=total)
    scratch.drop(keep=1)
    ids = src.select("doc_id").distinct()
    out = ids.join(labels, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without all but one document of each class; rows with a null id stay, of rows that repeat an id the one with the smallest text does."""
    classes = near_duplicates(docs, similarity)
    gone = Scratch(docs.sparkSession).write(classes.where(~F.col("kept")).select("doc_id"), "gone")
    left = docs.join(small_side(gone), "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.groupBy("doc_id").count().where((F.col("count") > 1) & F.col("doc_id").isNotNull()).select("doc_id")
    if repeated.isEmpty():
        return left
    rest = [c for c in docs.columns if c != "doc_id"]
    smallest = F.min_by(F.struct(*rest), F.struct("text", F.to_json(F.struct(*rest))))
    once = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(smallest.alias("r")).select("doc_id", "r.*")
    return left.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
