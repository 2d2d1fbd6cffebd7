"""Language-model scoring: context-tree weighting over bytes, beside a word-unigram base.

Text is lower-cased in A-Z and read as UTF-8 bytes, closed by byte 0xFF, which UTF-8 never holds;
the same byte fills the contexts before a text's start. A byte is eight binary decisions, each with a context
tree of its own over the preceding bytes. Nodes hold Krichevsky-Trofimov estimates, and the
weighting mixes all depths. KT block probabilities depend on counts alone, so one distributed count of
byte strings gives the exact weights. Every context of the training bytes is a node: the tree is a distributed
table that grows with the corpus, cut into subtrees of contexts that share their nearest bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, crc_mod

DEPTH = 5
END = 0xFF
#: Contexts that share so many nearest bytes are weighted in one task; the driver has the shorter ones, of two
#: bytes at most, of which UTF-8 allows some 41,000.
SPLIT = 3
#: Byte strings that a task weights at once, about; tasks at least.
BUCKET_STRINGS, LEAST_BUCKETS = 100_000, 256
#: Bytes of the documents whose vocabulary and byte strings are kept together.
CHUNK_BYTES = 32_000_000


def normalise(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()


# --- counting -------------------------------------------------------------------------------


def _coded_bytes(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array with ``depth`` ends before each; which bytes are coded, the first end after a text too; first place of each text in those."""
    gap = bytes([END]) * depth
    joined = np.frombuffer(gap + b"".join(t + gap for t in texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = depth + np.concatenate([[0], np.cumsum(lengths + depth)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    coded = np.ones(len(joined), bool)
    coded[:depth] = False
    coded[((starts + lengths + 1)[:, None] + np.arange(depth - 1)).ravel()] = False
    first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    return joined, coded, first


def byte_stream(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As above, with the places of the coded bytes."""
    joined, coded, first = _coded_bytes(texts, depth)
    return joined, np.flatnonzero(coded), first


def slices(texts: list[bytes], limit: int) -> Iterator[list[bytes]]:
    """Runs of texts of about ``limit`` bytes each, one text at least."""
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= limit:
            yield texts[lo : i + 1]
            lo, held = i + 1, 0
    if lo < len(texts):
        yield texts[lo:]


def string_codes(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ``depth`` before it as one number, the byte itself lowest; first place of each text."""
    joined, coded, first = _coded_bytes(texts, depth)
    code = np.zeros(len(joined) - depth, np.int64)
    for k in range(depth, -1, -1):
        code <<= 8
        code |= joined[depth - k : len(joined) - k]
    return code[coded[depth:]], first


def count_strings(texts: list[bytes], held_out: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct byte strings of all texts, and how often each is in those that are not held out."""
    code, _ = string_codes(texts, depth)
    at, codes = pd.factorize(code)
    del code
    out = np.repeat(held_out, np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return codes, np.bincount(at, minlength=len(codes)) - np.bincount(at[out], minlength=len(codes))


def sum_strings(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct strings of several counts, and the sums of their counts."""
    at, codes = pd.factorize(np.concatenate([c for c, _ in parts]))
    return codes, np.bincount(at, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


# --- the tree -------------------------------------------------------------------------------


@dataclass
class ContextTree:
    """child[node, byte before] -> node or -1; log10 of each next byte's probability at each node."""

    depth: int
    child: np.ndarray
    logp: np.ndarray

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text, its end included."""
        if not texts:
            return np.zeros(0)
        joined, places, first = byte_stream(texts, self.depth)
        out = np.zeros(len(places))
        flat_child, flat_logp = self.child.ravel(), self.logp.ravel()
        for lo in range(0, len(places), 1 << 20):
            at = places[lo : lo + (1 << 20)]
            node = np.zeros(len(at), np.int64)
            alive = np.ones(len(at), bool)
            for k in range(1, self.depth + 1):
                nxt = flat_child[node * 256 + joined[at - k]]
                alive &= nxt >= 0
                node = np.where(alive, nxt, node)
            out[lo : lo + (1 << 20)] = flat_logp[node * 256 + joined[at]]
        return np.add.reduceat(out, first)


def _binary_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of zeros and ones at the 255 inner nodes of the byte's binary tree, heap order."""
    zeros, ones = np.zeros((len(counts), 255)), np.zeros((len(counts), 255))
    level = counts.astype(float)
    for d in range(7, -1, -1):
        pairs = level.reshape(len(counts), -1, 2)
        zeros[:, (1 << d) - 1 : (2 << d) - 1], ones[:, (1 << d) - 1 : (2 << d) - 1] = pairs[:, :, 0], pairs[:, :, 1]
        level = pairs.sum(2)
    return zeros, ones


_SMALL_HALF = np.array([math.lgamma(k + 0.5) - math.lgamma(0.5) for k in range(64)])
_SMALL_WHOLE = np.array([math.lgamma(k + 1.0) for k in range(64)])


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the KT probability of a block with so many zeros and ones; small counts exactly, others by Stirling's series."""

    def half(k: np.ndarray) -> np.ndarray:
        return np.where(k < 64, _SMALL_HALF[np.minimum(k, 63).astype(int)], _stirling(np.maximum(k, 64) + 0.5) - math.lgamma(0.5))

    n = zeros + ones
    return half(zeros) + half(ones) - np.where(n < 64, _SMALL_WHOLE[np.minimum(n, 63).astype(int)], _stirling(np.maximum(n, 64) + 1.0))


Level = tuple[np.ndarray, np.ndarray]
_STEP = 1024


def build_tree(levels: list[Level]) -> ContextTree:
    """The weighted tree in one piece, for corpora that fit in memory; ``string_scores`` gives the same distributed.

    Made of context counts: levels[d] holds the sorted contexts of d bytes (nearest byte lowest) and their 256 counts each.

    log Pw(s) = log(Pe(s)/2 + prod Pw(children)/2), for each of the 255 decisions; what a node's
    kept children do not hold counts as one more child that is a leaf. A byte's probability at a node follows
    the path from the root: each inner node keeps its own estimate with the weight Pe/2Pw.
    """
    depth = len(levels) - 1
    first = np.concatenate([[0], np.cumsum([len(c) for c, _ in levels])])
    parents: list[np.ndarray] = [np.zeros(len(levels[0][0]), np.int64)]
    child = np.full((first[-1], 256), -1, np.int32)
    for d in range(1, depth + 1):
        ctx, shift = levels[d][0], 8 * (d - 1)
        up = np.searchsorted(levels[d - 1][0], ctx & ((1 << shift) - 1))
        parents.append(up)
        child[first[d - 1] + up, ctx >> shift] = first[d] + np.arange(len(ctx))
    stop: list[np.ndarray] = [np.zeros(0)] * (depth + 1)
    estimate: list[np.ndarray] = [np.zeros(0)] * (depth + 1)
    kids_w = kids_n = None
    for d in range(depth, -1, -1):
        counts = levels[d][1]
        n = len(counts)
        stop[d], estimate[d] = np.ones((n, 255), np.float32), np.empty((n, 255), np.float32)
        up_n = len(levels[d - 1][0]) if d else 0
        up_w, up_c = np.zeros((up_n, 255)), np.zeros((up_n, 256), np.int64)
        for lo in range(0, n, _STEP):
            at = slice(lo, lo + _STEP)
            zeros, ones = _binary_counts(counts[at])
            weighted = block = kt_block(zeros, ones)
            estimate[d][at] = (ones + 0.5) / (zeros + ones + 1)
            if d < depth:
                below = kids_w[at] + kt_block(*_binary_counts(np.maximum(counts[at] - kids_n[at], 0)))
                weighted = np.logaddexp(block, below) - math.log(2)
                stop[d][at] = np.exp(block - math.log(2) - weighted)
            if d:
                np.add.at(up_w, parents[d][at], weighted)
                np.add.at(up_c, parents[d][at], counts[at])
        kids_w, kids_n = up_w, up_c
    # From the root down: the mixture above a node that its own estimate or its child's completes.
    logp = np.empty((first[-1], 256), np.float32)
    mixed, carry = np.zeros((1, 255), np.float32), np.ones((1, 255), np.float32)
    for d in range(depth + 1):
        base, weight = mixed[parents[d]], carry[parents[d]]
        for lo in range(0, len(base), _STEP):
            ones = base[lo : lo + _STEP].astype(float) + weight[lo : lo + _STEP].astype(float) * estimate[d][lo : lo + _STEP]  # the node as the last of its path
            p = np.ones((len(ones), 1))
            for k in range(8):
                one = ones[:, (1 << k) - 1 : (2 << k) - 1]
                p = np.stack([p * (1 - one), p * one], 2).reshape(len(ones), -1)
            logp[first[d] + lo : first[d] + lo + len(ones)] = np.log10(np.maximum(p, 1e-300))
        mixed, carry = base + weight * stop[d] * estimate[d], weight * (1 - stop[d])
    return ContextTree(depth, child, logp)


@dataclass
class Nodes:
    """Inner nodes of one depth that training bytes have passed: context and node as one sorted key, estimate, share that stops."""

    key: np.ndarray
    estimate: np.ndarray
    stop: np.ndarray


def _decisions(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and inner node of the eight decisions of each string's last byte as one key, and whether a decision is a one."""
    k, byte = np.arange(8), (code & 255)[:, None]
    return (code & ~255)[:, None] | ((1 << k) - 1 + (byte >> (8 - k))), (byte >> (7 - k)) & 1 == 1


def _suffix(key: np.ndarray, depth: int) -> np.ndarray:
    return key & ((1 << 8 * (depth + 1)) - 1)


def _sum_by(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    keys, at = np.unique(key, return_inverse=True)
    return keys, *(np.bincount(at, v, len(keys)) for v in values)


def weigh_levels(deepest: int, top: int, key: np.ndarray, *sums: np.ndarray) -> tuple[dict[int, Nodes], tuple[np.ndarray, ...]]:
    """Nodes of the depths from ``deepest`` up to ``top``, and (key, zeros, ones, log weighted) of the last.

    ``sums`` are zeros and ones of keys and, unless ``deepest`` is that of the leaves, the sums of their children's weighted
    logarithms. Nodes that no training byte passed weigh log 1 and are left out.
    """
    levels: dict[int, Nodes] = {}
    for d in range(deepest, top - 1, -1):
        key, zeros, ones, *below = _sum_by(_suffix(key, d), *sums)
        weighted = block = kt_block(zeros, ones)
        stop = np.ones(len(key))
        if below:
            weighted = np.logaddexp(block, below[0]) - math.log(2)
            stop = np.exp(block - math.log(2) - weighted)
        levels[d] = Nodes(key, (ones + 0.5) / (zeros + ones + 1), stop)
        sums = (zeros, ones, weighted)
    return levels, (key, *sums)


def weigh_strings(code: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[dict[int, Nodes], tuple[np.ndarray, ...]]:
    """As above, for the subtrees that hold the byte strings ``code``, seen ``n`` times in training."""
    key, one = _decisions(code[n > 0])
    times = n[n > 0][:, None].astype(float)
    return weigh_levels(depth, top, key.ravel(), (times * ~one).ravel(), (times * one).ravel())


def log_probability(code: np.ndarray, levels: dict[int, Nodes]) -> np.ndarray:
    """log10 probability of each string's last byte after the others, along the path of its contexts that are in the tree."""
    out = np.zeros(len(code))
    for lo in range(0, len(code), 1 << 16):
        key, one = _decisions(code[lo : lo + (1 << 16)])
        base, weight, p = np.zeros(key.shape), np.ones(key.shape), np.full(key.shape, 0.5)
        for d in range(len(levels)):
            nodes, want = levels[d], _suffix(key, d)
            if not len(nodes.key):
                break
            at = np.minimum(np.searchsorted(nodes.key, want), len(nodes.key) - 1)
            seen = nodes.key[at] == want
            # What no training byte passed is even at this and all deeper contexts.
            estimate, stop = np.where(seen, nodes.estimate[at], 0.5), np.where(seen, nodes.stop[at], 1.0)
            p = np.where(seen[:, :1], base + weight * estimate, p)  # a context is in the tree if its first decision is
            base, weight = base + weight * stop * estimate, weight * (1 - stop)
        out[lo : lo + (1 << 16)] = np.log10(np.maximum(np.where(one, p, 1 - p), 1e-300)).sum(1)
    return out


def string_scores(counted: DataFrame, depth: int = DEPTH, scratch: Scratch | None = None) -> DataFrame:
    """Byte strings (code bigint, n bigint), a row each, n 0 if not in training -> code, logp: each string's last byte in the tree of all.

    Strings are dealt by their nearest context bytes, so that a task has whole subtrees. It hands up their sums at two bytes of
    context; the driver weights the rest, and a second pass reads the probabilities off.
    """
    scratch = scratch or Scratch(counted.sparkSession)
    split = min(SPLIT, depth)
    buckets = max(LEAST_BUCKETS, math.ceil(counted.count() / BUCKET_STRINGS))
    near = F.shiftright("code", 8).bitwiseAND(F.lit((1 << (8 * split)) - 1))
    dealt = counted.select("code", "n", F.pmod(F.xxhash64(near), F.lit(buckets)).alias("bucket")).groupBy("bucket")

    def climb(group: pd.DataFrame) -> pd.DataFrame:
        _, (key, *sums) = weigh_strings(group["code"].to_numpy(), group["n"].to_numpy(), depth, split)
        return pd.DataFrame(dict(zip(("key", "zeros", "ones", "below"), _sum_by(_suffix(key, split - 1), *sums), strict=True)))

    top: dict[int, Nodes] = {}
    if split:
        sums = dealt.applyInPandas(climb, "key bigint, zeros double, ones double, below double").groupBy("key").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).toArrow()
        top, _ = weigh_levels(split - 1, 0, *(c.to_numpy() for c in sums.columns))
    shared = counted.sparkSession.sparkContext.broadcast(top)

    def read_off(group: pd.DataFrame) -> pd.DataFrame:
        code = group["code"].to_numpy()
        levels, _ = weigh_strings(code, group["n"].to_numpy(), depth, split)
        return pd.DataFrame({"code": code, "logp": log_probability(code, shared.value | levels).astype(np.float32)})

    return scratch.write(dealt.applyInPandas(read_off, "code bigint, logp float"), "logp")


# --- scoring --------------------------------------------------------------------------------

PART_SCHEMA = "chunk bigint, place int, doc_id bigint, nameless boolean, held_out boolean, text binary, token bigint, code bigint, train_count bigint"
PART_COLUMNS = [c.split()[0] for c in PART_SCHEMA.split(", ")]
#: Rows of an Arrow batch of vocabulary or strings.
PART_ROWS = 100_000
#: Bytes of text whose words and byte strings are taken at once, and so many counts that are kept until they are summed.
SLICE_BYTES, KEPT_COUNTS = 1_000_000, 8


def _hash(token: bytes) -> int:
    return xxhash.xxh64_intdigest(token) - (1 << 63)


class _Vocabulary(dict):
    def __missing__(self, token: bytes) -> int:
        self[token] = n = len(self)
        return n


def token_places(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct tokens of the texts as numbers, and where each text's are among those, its end last."""
    vocabulary = _Vocabulary()
    end = vocabulary[b" "]  # no word has a space: the end token
    seen = [np.append(np.fromiter(map(vocabulary.__getitem__, t.split()), np.int32), np.int32(end)) for t in texts]
    return np.fromiter(map(_hash, vocabulary), np.int64, len(vocabulary)), seen


def count_tokens(texts: list[bytes], held_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens of all texts, and how often each is in those that are not held out."""
    tokens, seen = token_places(texts)
    trained = [w for w, out in zip(seen, held_out, strict=True) if not out]
    return tokens, np.bincount(np.concatenate(trained), minlength=len(tokens)) if trained else np.zeros(len(tokens), np.int64)


class _Chunk:
    """Tokens, byte strings and training counts of documents that are kept together; of words only their numbers are held."""

    def __init__(self, number: int, depth: int):
        self.number, self.depth, self.documents, self.bytes = number, depth, 0, 0
        self.tokens: list[tuple[np.ndarray, np.ndarray]] = []
        self.strings: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, texts: list[bytes], held_out: np.ndarray) -> None:
        lo = 0
        for some in slices(texts, SLICE_BYTES):
            out = held_out[lo : lo + len(some)]
            lo += len(some)
            for counts, new in ((self.tokens, count_tokens(some, out)), (self.strings, count_strings(some, out, self.depth))):
                counts.append(new)
                if len(counts) == KEPT_COUNTS:
                    counts[:] = [sum_strings(counts)]
        self.documents, self.bytes = self.documents + len(texts), self.bytes + sum(map(len, texts))

    def rows(self) -> Iterator[pd.DataFrame]:
        for name, counts in (("token", self.tokens), ("code", self.strings)):
            numbers, n = sum_strings(counts)
            counts.clear()
            order = np.argsort(numbers)  # sorted numbers take less room, written and sent
            rows = pd.DataFrame({"chunk": self.number, name: numbers[order], "train_count": n[order]})
            for i in range(0, len(rows), PART_ROWS):
                yield rows.iloc[i : i + PART_ROWS].reindex(columns=PART_COLUMNS)


def score_corpus(docs: DataFrame, modulus: int = 7, held: int = 2, depth: int = DEPTH) -> DataFrame:
    """Documents (doc_id, text, ...) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(doc_id as text) mod ``modulus`` is not ``held``. Counts cover all
    training rows: a chunk of documents lists its words and byte strings once, their counts are summed over chunks
    and what the models say of them is handed back to each chunk; no table of all is ever in one place.

    Nulls: a null text is empty and has the end token alone; a null id counts as the empty text in
    crc32. Repeated rows are scored each. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", crc_mod(F.col("doc_id"), modulus) == held)
    # No id is null on the way: pandas would round those beside it.
    src = src.withColumn("nameless", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk(number, depth)
        for batch in batches:
            if batch.empty:
                continue
            every, out = [normalise(t) for t in batch["text"]], batch["held_out"].to_numpy(bool)
            ends, lo = np.cumsum([len(t) for t in every]), 0
            while lo < len(every):  # a chunk ends with the text that fills it, within a batch too: batches of long texts are large
                room = CHUNK_BYTES - chunk.bytes + (ends[lo - 1] if lo else 0)
                hi = min(len(every), max(lo, int(np.searchsorted(ends, room))) + 1)
                texts, held_out, some = every[lo:hi], out[lo:hi], batch.iloc[lo:hi]
                place = np.arange(chunk.documents, chunk.documents + len(texts), dtype=np.int32)
                chunk.add(texts, held_out)
                yield pd.DataFrame({"chunk": chunk.number, "place": place, "doc_id": some["doc_id"].to_numpy(), "nameless": some["nameless"].to_numpy(bool), "held_out": held_out, "text": texts}).reindex(columns=PART_COLUMNS)
                if chunk.bytes >= CHUNK_BYTES:
                    yield from chunk.rows()
                    number += 1
                    chunk = _Chunk(number, depth)
                lo = hi
        if chunk.documents:
            yield from chunk.rows()

    parts = scratch.write(src.mapInPandas(run, PART_SCHEMA), "parts", "zstd")  # texts, words and strings: most of the disk
    strings = parts.where(F.col("code").isNotNull()).select("chunk", "code", "train_count")
    logp = string_scores(scratch.write(strings.groupBy("code").agg(F.sum("train_count").alias("n")), "strings"), depth, scratch)
    words = parts.where(F.col("token").isNotNull()).select("chunk", "token", "train_count")
    same = Window.partitionBy("token").orderBy("chunk")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = words.select("chunk", "token", "train_count", F.sum("train_count").over(whole).alias("c"), (F.row_number().over(same) == 1).alias("first"))
    counted = scratch.write(counted.where(F.col("c") > 0), "counted")
    # N counts all training tokens, V the distinct ones.
    n_train, n_distinct = counted.agg(F.coalesce(F.sum("train_count"), F.lit(0)), F.count_if("first")).first()
    floor = math.log10(n_train + n_distinct + 1)

    def merge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("place", kind="stable")
        texts = left["text"].tolist()
        c, key = right["c"].to_numpy(), right["key"].to_numpy()
        is_word = c > 0
        tokens, times = pd.Index(key[is_word]), np.append(c[is_word], 0)  # place -1, of tokens never seen in training, has 0
        strings, value = pd.Index(key[~is_word]), right["logp"].to_numpy()[~is_word].astype(float)
        n_tokens, n_known, base, scores = [], [], [], []
        for some in slices(texts, SLICE_BYTES):
            numbers, seen = token_places(some)
            n = times[tokens.get_indexer(numbers)]
            gain = np.log10(n + 1.0) - floor
            n_tokens += [len(w) for w in seen]
            n_known += [int((n[w] > 0).sum()) for w in seen]
            base += [float(gain[w].sum()) for w in seen]
            code, first = string_codes(some, depth)
            scores.append(np.add.reduceat(value[strings.get_indexer(code)], first))
        return pd.DataFrame({
            "doc_id": left["doc_id"].astype("int64"), "nameless": left["nameless"].astype(bool), "held_out": left["held_out"].astype(bool), "n_tokens": n_tokens, "n_known": n_known,
            "train_tokens": n_train, "base_score": base, "score": np.concatenate(scores),
        })

    documents = parts.where(F.col("text").isNotNull()).select(F.col("chunk").alias("part"), "place", "doc_id", "nameless", "held_out", "text")
    # A token's count is above 0, a string's is given as 0.
    back = strings.join(logp.hint("shuffle_hash"), "code").select("chunk", F.col("code").alias("key"), F.lit(0).cast("bigint").alias("c"), "logp")
    back = back.unionAll(counted.select("chunk", F.col("token").alias("key"), "c", F.lit(0).cast("float").alias("logp")))
    scored = documents.groupBy("part").cogroup(back.groupBy("chunk")).applyInPandas(
        merge, "doc_id bigint, nameless boolean, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
    return scored.withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id"))).drop("nameless")
