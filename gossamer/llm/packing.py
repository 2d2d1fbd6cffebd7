"""Sum-of-squares packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

CAPACITY = 2048
#: Pieces packed together; more groups only as the input grows, so a task's memory is bounded.
GROUP_PIECES = 16_384

#: White space as the pattern of the rank files has it; a longer run overflows the stack of tiktoken's matcher.
WHITE_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
LONGEST_RUN = 100_000

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PIECE_COLUMNS = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


class Encoder:
    """Token ids of a text as little-endian 32-bit bytes.

    ``path`` names byte-pair ranks (.tiktoken) or a ``tokenizers`` file (.json). The default are the
    ranks of byte_bpe_50k, which are the vocabulary of byte_bpe_50k.json and give the same ids in
    a fifth of the time; a test holds the two against each other. Strings of special tokens in a text are
    ordinary text, as public_tokenizers/README.md has it.
    """

    def __init__(self, path: str | None = None):
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.tiktoken")
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self.ids = lambda text: np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        else:
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.ids = lambda text: np.asarray(self._ordinary(encoding, text), "<u4")

    @staticmethod
    def _ordinary(encoding, text: str) -> list[int]:
        """encode_ordinary, but very long runs of white space are merged as the one piece that the pattern makes of them.

        That is a run without its last character, which the pattern leaves to what follows; at the end of a text, all of it.
        """
        ids, at = [], 0
        if len(text) > LONGEST_RUN:
            for run in WHITE_RUN.finditer(text):
                if run.end() - run.start() > LONGEST_RUN:
                    end = run.end() - (run.end() < len(text))
                    ids += encoding.encode_ordinary(text[at : run.start()]) + encoding._encode_single_piece(text[run.start() : end])
                    at = end
        return ids + encoding.encode_ordinary(text[at:])

    def __call__(self, text: str) -> bytes:
        return self.ids(text).tobytes()


def tokenise_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32.

    A document is its ids and a closing id 0. Only a longer one than ``capacity`` is cut; its
    first piece takes the remainder, so that all others fill a sequence each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer_path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + b"\0\0\0\0"
                total = len(ids) // 4
                cut = [0, *range(total % capacity or capacity, total + 1, capacity)] if total > capacity else [0, total]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False))]
            yield pa.RecordBatch.from_arrays([pa.array(c, PIECE_TYPES[k]) for k, c in enumerate(zip(*rows, strict=True) if rows else [()] * 5)], PIECE_COLUMNS)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE_SCHEMA)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, in the order given.

    ``open_bins[g]`` counts the open sequences with gap g. Each length goes where the sum of the squared
    counts becomes smallest: out of gap g into gap g - s changes it by 2 (N[g-s] - N[g] + 1), into a
    new sequence by 2 N[B-s] + 1, filling one up by 1 - 2 N[g]. Ties take the smallest gap.
    """
    count = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened = 0
    for i, s in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(count[s:]) + s
        fresh = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        best, change = -1, fresh
        if len(gaps):
            delta = 2 * (count[gaps - s] - count[gaps] + 1)
            if gaps[0] == s:
                delta[0] = 1 - 2 * count[s]
            k = int(delta.argmin())
            if delta[k] <= fresh:
                best, change = int(gaps[k]), int(delta[k])
        if best < 0:
            at, best = opened, capacity
            opened += 1
        else:
            at = stacks[best].pop()
            count[best] -= 1
        sequence[i], offset[i] = at, capacity - best
        if best > s:
            stacks[best - s].append(at)
            count[best - s] += 1
    return sequence, offset


def pack(docs: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, tokenizer_path: str | None = None) -> DataFrame:
    """Documents (doc_id, text, ...) -> a row per piece with its place in a sequence.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A piece that fills a sequence is one by itself and is
    only projected. The others are dealt by row into groups of about ``group_pieces``; a group packs its pieces by sum of squares, longest first.

    Nulls: a null text is empty, so its document is the closing id alone; a null doc_id stays null.
    Repeated rows are packed each. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = Scratch(spark).write(tokenise_pieces(docs, capacity, tokenizer_path).withColumn("row", F.monotonically_increasing_id()), "pieces")
    full, others = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    groups = max(1, round(others.count() / group_pieces))

    def place(group: pa.Table) -> pa.Table:
        number = group.column("grp")[0].as_py()
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        sequence, offset = sum_of_squares(group.column("length").to_numpy(), capacity)
        return group.select(PIECE_COLUMNS).append_column("sequence_id", pa.array(sequence * groups + number, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    # The written row number deals them evenly, whatever ids repeat or are null.
    dealt = others.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
    packed = dealt.groupBy("grp").applyInArrow(place, PIECE_SCHEMA + ", sequence_id bigint, offset bigint")
    # Sequences of one full piece are numbered below zero, by the piece's row.
    return packed.unionByName(full.select(*PIECE_COLUMNS, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")))
