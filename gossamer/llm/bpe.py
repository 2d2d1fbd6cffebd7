"""Byte-level BPE, encoding and decoding whole texts: greedy proposals, verified pair by pair, exact merging where one fails.

A row of tokens is what merging gives if every two neighbours are, by themselves, what merging gives of their bytes: no merge
across three tokens can come about before one across two. So words are first cut greedily into the longest tokens, all
neighbours are tested at once in arrays, and only words with a failing pair are merged step by step.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text whose words are encoded together, and of a long text's sections.
CHUNK_CHARS = 1 << 20
#: Words and their characters that a task remembers; beyond either it starts anew.
CACHE_WORDS, CACHE_CHARS = 200_000, 8_000_000
#: Bytes from which a word is matched at all places at once, rather than along with other words.
LONG_WORD = 128
#: Bytes of a long word that are matched at a time.
LONG_PART = 1 << 18
NEVER = np.int64(1 << 40)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary's file: itself where it is printable, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and the arrays for matching and verifying; from a ``tokenizers`` file of byte-level BPE."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        byte_of, vocab = byte_characters(), told["model"]["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in told.get("added_tokens", []))])
        self.tokens = [b""] * size
        for t in told.get("added_tokens", []):
            self.tokens[t["id"]] = t["content"].encode()
        for text, number in vocab.items():
            self.tokens[number] = bytes(byte_of[c] for c in text)
        self.byte_ids = np.array([vocab[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])], np.int64)

        # What each token was merged from, and at which rank; a byte is there from the start, at -1.
        pairs = [(m.split(" ") if isinstance(m, str) else m) for m in told["model"]["merges"]]
        first, second = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made_of = np.array([vocab[a + b] for a, b in pairs], np.int64)
        ranks = np.arange(len(pairs), dtype=np.int64)
        self.size, self.left, self.right, self.made = size, np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, NEVER)
        self.made[self.byte_ids] = -1
        self.left[made_of], self.right[made_of], self.made[made_of] = first, second, ranks
        if len(np.unique(made_of)) < len(pairs) or (self.made[first] >= ranks).any() or (self.made[second] >= ranks).any():
            raise ValueError("a vocabulary in which each token has one merge, of tokens merged before it, is needed")
        order = np.argsort(first * size + second)
        self.pair_keys, self.pair_ranks, self.pair_made = (first * size + second)[order], ranks[order], made_of[order]
        self.merges = {(a, b): (r, c) for a, b, r, c in zip(first.tolist(), second.tolist(), ranks.tolist(), made_of.tolist(), strict=True)}
        # A token that merging its own bytes does not give is never proposed.
        sound = np.zeros(size, bool)
        sound[self.byte_ids] = True
        sound[made_of] = self.compatible(first, second, ranks)
        for token in made_of[np.argsort(ranks)].tolist():
            sound[token] &= sound[self.left[token]] and sound[self.right[token]]
        self._grow_trie([t for t in range(size) if sound[t]])

    def _grow_trie(self, proposed: list[int]) -> None:
        """step[node, byte]: the next node or 0; ends[node]: the token that ends there or -1. Node 0 is no node, 1 the root."""
        edges: dict[tuple[int, int], int] = {}
        ends = {}
        for t in proposed:
            node = 1
            for b in self.tokens[t]:
                node = edges.setdefault((node, b), len(edges) + 2)
            ends[node] = t
        # Nodes that lead on come first, so that the table has rows for them alone.
        inner = sorted({a for a, _ in edges})
        number = {node: k + 1 for k, node in enumerate(inner)}
        for node in edges.values():
            number.setdefault(node, len(number) + 1)
        self.inner = len(inner)
        self.step = np.zeros((self.inner + 1, 256), np.int32)
        for (node, b), after in edges.items():
            self.step[number[node], b] = number[after]
        self.step, self.ends = self.step.ravel(), np.full(len(number) + 1, -1, np.int64)
        for node, t in ends.items():
            self.ends[number[node]] = t

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Does merging the bytes of a and b leave the two as they are, up to the rank ``before`` where one is given?

        Merging is run backwards: u and v are what stands at the boundary, each until the rank at which it was merged
        away from it. The later made of the two is undone in turn. A merge of u and v comes first if its rank is below the end of
        both; of equal ranks the leftmost does, so at that of v's end it still comes before, at that of u's end not.
        """
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        u, v = a.copy(), b.copy()
        until_u = np.full(len(a), NEVER) if before is None else before.copy()
        until_v = until_u - (before is not None)
        while len(at):
            rank, _ = self.ranks_of(u, v)
            crosses = (rank < until_u) & (rank <= until_v)
            ok[at[crosses]] = False
            made_u, made_v = self.made[u], self.made[v]
            go = ~crosses & ((made_u >= 0) | (made_v >= 0))
            undo_u = made_u > made_v
            until_u, until_v = np.where(undo_u, made_u, until_u), np.where(undo_u, until_v, made_v)
            u, v = np.where(undo_u, self.right[u], u), np.where(undo_u, v, self.left[v])
            at, u, v, until_u, until_v = at[go], u[go], v[go], until_u[go], until_v[go]
        return ok

    def longest(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token from each place on, not beyond its end, and its length."""
        token, length = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        alive, node, depth = np.arange(len(at)), np.ones(len(at), np.int64), 0
        while len(alive):
            node = self.step[node * 256 + data[at[alive] + depth]].astype(np.int64)
            depth += 1
            kept = node > 0
            alive, node = alive[kept], node[kept]
            hit = self.ends[node]
            there = hit >= 0
            token[alive[there]], length[alive[there]] = hit[there], depth
            on = (node <= self.inner) & (at[alive] + depth < end[alive])
            alive, node = alive[on], node[on]
        return token, length

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy tokens of all words, and the number of each word's."""
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        word, place = np.flatnonzero(sizes < LONG_WORD), (ends - sizes)[sizes < LONG_WORD]
        cut: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            token, length = self.longest(data, place, ends[word])
            cut.append((word, place, token))
            place = place + length
            on = place < ends[word]
            word, place = word[on], place[on]
        for w in np.flatnonzero(sizes >= LONG_WORD).tolist():
            at, end = int(ends[w] - sizes[w]), int(ends[w])
            while at < end:
                places = np.arange(at, min(end, at + LONG_PART))
                token, length = self.longest(data, places, np.full(len(places), end))
                token, length, here, kept = token.tolist(), length.tolist(), 0, []
                while here < len(token):
                    kept.append(here)
                    here += length[here]
                cut.append((np.full(len(kept), w), at + np.array(kept), np.array([token[k] for k in kept])))
                at += here
        word, place, token = (np.concatenate([c[k] for c in cut]) if cut else np.zeros(0, np.int64) for k in range(3))
        return token[np.argsort(place, kind="stable")], np.bincount(word, minlength=len(words))

    def merge(self, word: bytes) -> list[int]:
        """The word's tokens by merging the pair of the lowest rank, of equal ones the leftmost, until none is left."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        heap = [(*self.merges[p], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges]
        heap = [(r, k, c) for r, c, k in heap]
        heapq.heapify(heap)
        while heap:
            rank, k, made = heapq.heappop(heap)
            follower = after[k]
            # Stale where either side has been merged meanwhile.
            if ids[k] < 0 or follower < 0 or self.merges.get((ids[k], ids[follower])) != (rank, made):
                continue
            ids[k], ids[follower], after[k] = made, -1, after[follower]
            if after[k] >= 0:
                before[after[k]] = k
                if found := self.merges.get((made, ids[after[k]])):
                    heapq.heappush(heap, (found[0], k, found[1]))
            if before[k] >= 0 and (found := self.merges.get((ids[before[k]], made))):
                heapq.heappush(heap, (found[0], before[k], found[1]))
        return [t for t in ids if t >= 0]

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of the merge of a and b, NEVER where there is none, and what it makes."""
        keys = a * self.size + b
        found = np.searchsorted(self.pair_keys, keys)
        found[found == len(self.pair_keys)] = 0
        there = self.pair_keys[found] == keys
        return np.where(there, self.pair_ranks[found], NEVER), np.where(there, self.pair_made[found], -1)

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many short words at once: a merge of each word in every round."""
        counts = np.array([len(w) for w in words], np.int64)
        ids, done = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)], np.cumsum(counts)
        word = np.repeat(np.arange(len(words)), counts)
        ranks, made = np.full(len(ids), NEVER), np.full(len(ids), -1, np.int64)
        at = np.ones(len(ids), bool)
        at[done - 1] = False
        at = np.flatnonzero(at)
        ranks[at], made[at] = self.ranks_of(ids[at], ids[at + 1])
        out_words, out_ids = [], []
        while len(ids):
            start = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(ranks, start)
            sizes = np.diff(start, append=len(ids))
            on = np.repeat(least < NEVER, sizes)
            if not on.all():  # words without a merge left are done
                out_words.append(word[~on])
                out_ids.append(ids[~on])
                ids, word, ranks, made = ids[on], word[on], ranks[on], made[on]
                sizes, least = sizes[least < NEVER], least[least < NEVER]
                if not len(ids):
                    break
            hit = np.flatnonzero(ranks == np.repeat(least, sizes))
            hit = hit[np.diff(word[hit], prepend=-1) > 0]  # the leftmost of each word
            ids[hit] = made[hit]
            kept = np.ones(len(ids), bool)
            kept[hit + 1] = False
            hit = hit - np.arange(len(hit))  # one place is gone for each hit before
            ids, word, ranks, made = ids[kept], word[kept], ranks[kept], made[kept]
            for at in (hit, hit[hit > 0] - 1):
                beside = np.minimum(at + 1, len(ids) - 1)
                ranks[at], made[at] = self.ranks_of(ids[at], ids[beside])
                apart = at[(word[at] != word[beside]) | (at == beside)]
                ranks[apart], made[apart] = NEVER, -1
        word, ids = np.concatenate(out_words), np.concatenate(out_ids)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(words))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, and the number of each word's: proposed, verified, and merged where the proposal fails."""
        ids, counts = self.propose(words)
        ends = np.cumsum(counts)
        inside = np.ones(max(len(ids) - 1, 0), bool)
        inside[ends[:-1] - 1] = False  # the last token of a word and the first of the next are no neighbours
        at = np.flatnonzero(inside)
        keys, where = np.unique(ids[at] * self.size + ids[at + 1], return_inverse=True)
        bad = at[~self.compatible(keys // self.size, keys % self.size)[where]]
        failing = np.unique(np.searchsorted(ends, bad, side="right")).tolist()
        if not failing:
            return ids, counts
        short, long = [w for w in failing if len(words[w]) < LONG_WORD], [w for w in failing if len(words[w]) >= LONG_WORD]
        merged, sizes = self.merge_all([words[w] for w in short]) if short else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        each = [np.array(self.merge(words[w]), np.int64) for w in long]
        # Words keep their order: those that passed, then the merged ones, dealt back by word.
        passed = np.ones(len(words), bool)
        passed[failing] = False
        new = np.concatenate([counts[passed], sizes, [len(x) for x in each]]).astype(np.int64)
        of = np.concatenate([np.flatnonzero(passed), short, long]).astype(np.int64)
        flat = np.concatenate([ids[np.repeat(passed, counts)], merged, *each])
        order = np.argsort(np.repeat(of, new), kind="stable")
        counts[of] = new
        return flat[order], counts

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 are read as U+FFFD. Unknown ids are left out."""
        parts = []
        for k in range(0, len(ids), CHUNK_CHARS):
            parts.append(b"".join([self.tokens[t] if 0 <= t < self.size else b"" for t in ids[k : k + CHUNK_CHARS].tolist()]))
        return b"".join(parts).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def splitters(path: str) -> tuple:
    """The pattern that splits texts into words, the one for texts with characters that are too new for the ``tokenizers`` library, and whether each is.

    The two libraries follow different editions of Unicode: the letters and numbers of later ones are, to ``tokenizers``, neither.
    """
    import public_tokenizers
    import regex
    from tokenizers import Tokenizer

    plain = public_tokenizers.PATTERN
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    late = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    split, known = Tokenizer.from_file(path).pre_tokenizer, set()
    for beside in "a1":  # a character that is known stays in one word with a letter or a figure on both sides
        known |= {a // 4 for _, (a, b) in split.pre_tokenize_str("".join(f" {beside}{c}{beside}" for c in late)) if b - a == 4 and a % 4 == 0}
    ranges: list[list[int]] = []
    for c in (ord(c) for k, c in enumerate(late) if k not in known):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    if not ranges:
        return regex.compile(plain), None, None
    new = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in ranges)
    letter, number = (f"[\\p{{{k}}}--[{new}]]" for k in "LN")
    strict = plain.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{letter}{number}]").replace(r"?\p{L}", "?" + letter).replace(r"?\p{N}", "?" + number)
    late = np.zeros(0x110000, bool)
    for a, b in ranges:
        late[a : b + 1] = True
    return regex.compile(plain), regex.compile(strict, regex.V1), late


class Encoder:
    """Token ids of texts; remembers the words that it has met."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary = vocabulary
        self.plain, self.strict, self.late = splitters(vocabulary.path)
        # No word goes over from a character to white space after it, so a text can be cut there.
        self.cut = regex.compile(r"(?<=\S)\s")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars, self.ids, self.ends = 0, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def words(self, text: str) -> list[str]:
        strict = self.late is not None and not text.isascii() and self.late[np.frombuffer(text.encode("utf-32-le"), "<u4")].any()
        return (self.strict if strict else self.plain).findall(text)

    def sections(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > CHUNK_CHARS and (found := self.cut.search(text, at + CHUNK_CHARS)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def learn(self, words: Iterable[list[str]]) -> None:
        fresh = list(set().union(*words).difference(self.known))
        if not fresh:
            return
        ids, counts = self.vocabulary.encode_words([w.encode("utf-8", "replace") for w in fresh])
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        self.chars += sum(map(len, fresh))
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Texts are cut into sections, and the new words of a section or of many short texts are encoded together."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            self.learn(words for _, words in held)
            for k, words in held:
                index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
                starts = self.ends[index]
                counts = self.ends[index + 1] - starts
                ends = np.cumsum(counts)
                out[k].append(self.ids[np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)])
            held.clear()
            if len(self.known) > CACHE_WORDS or self.chars > CACHE_CHARS:
                self.forget()

        for k, text in enumerate(texts):
            for section in self.sections(text):
                held.append((k, self.words(section)))
                size += len(section)
                if size >= CHUNK_CHARS:
                    settle()
                    size = 0
        settle()
        return [np.concatenate(parts) if parts else np.zeros(0, np.int32) for parts in out]


@lru_cache(maxsize=1)
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, decoded: bool = False, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs (doc_id, text, ...) -> the columns ``keep``, ids array<int> and, if asked for, ``decoded``: the text that the ids give back.

    One scan without a shuffle; a task holds a chunk of about a million characters, one text at least, and the words it remembers.
    ``path`` names a ``tokenizers`` file of byte-level BPE, byte_bpe_50k.json by default. Strings of special tokens in a text are ordinary text.

    A null text is empty and has no ids. Ids of rows may be null or repeat: each row is encoded by itself. Bytes that are no UTF-8 are read
    as U+FFFD. An empty table gives no rows; columns that are not kept are ignored, so their names do not clash.
    """
    kept = docs.select(*keep)
    schema = kept.schema.add("ids", T.ArrayType(T.IntegerType()))
    if decoded:
        schema = schema.add("decoded", "string")
    where = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(where)
        encoder = Encoder(vocabulary)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes = [0 if not t.is_valid else t.as_buffer().size for t in texts]
            start, held = 0, 0
            for k, size in enumerate(sizes):
                held += size
                if held >= CHUNK_CHARS or k == len(sizes) - 1:
                    rows = [(t.as_py() or b"").decode("utf-8", "replace") for t in texts.slice(start, k + 1 - start)]
                    ids = encoder(rows)
                    lengths = np.cumsum([0, *map(len, ids)])
                    columns = [*batch.slice(start, k + 1 - start).columns[:-1], pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))]
                    if decoded:
                        columns.append(pa.array([vocabulary.decode(x) for x in ids], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                    start, held = k + 1, 0

    return docs.select(*keep, F.col("text").cast("string").cast("binary").alias("__text")).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(ids array<int>, ...) -> the columns ``keep`` and ``decoded``. Null ids decode to an empty text; numbers that are no ids are left out."""
    schema = rows.select(*keep).schema.add("decoded", "string")
    where = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(where)
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            texts = [vocabulary.decode(np.array([] if not x.is_valid else x.values.drop_null(), np.int64)) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return rows.select(*keep, F.col("ids").cast("array<int>").alias("__ids")).mapInArrow(run, schema)
