"""Quality by compression: which of two zstandard dictionaries, of good and of bad text, fits better."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fit_logistic, logistic, training_sample

DICT_BYTES, CHUNK, LEVEL = 1 << 16, 2_000, 3
#: Fitting: at most about so many labelled documents, and of each label so many for its dictionary.
MAX_FIT_DOCS, MAX_DICT_DOCS = 6_000, 1_500


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    coef: np.ndarray

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_checksum=False, write_content_size=False)
        return [make(self.good), make(self.bad)]


def features(text: str, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> list[float]:
    """The compressed-size difference, normalised by the text's size and by the larger compressed size."""
    raw = text.encode("utf-8", "replace")
    a, b = len(good.compress(raw)), len(bad.compress(raw))
    per_byte, relative = (a - b) / (len(raw) + 32), (a - b) / max(a, b)
    return [10 * per_byte, 10 * relative, 100 * per_byte * abs(per_byte)]


def train_dictionary(texts: list[str]) -> bytes:
    chunks = []
    for text in texts:
        raw = text.encode("utf-8", "replace")
        chunks += [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
    if not chunks:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, chunks).as_bytes()
    except zstandard.ZstdError:  # too little to train on: whole texts, the shortest, as many as fit
        held, size = [], 0
        for raw in sorted((t.encode("utf-8", "replace") for t in texts), key=len):
            if held and size + len(raw) > DICT_BYTES:
                break
            held.append(raw)
            size += len(raw)
        return b"".join(held)


def fit(sample: pd.DataFrame) -> QualityModel:
    """Dictionaries of two thirds of the labelled texts, drawn by a hash of their ids, the calibration of the others.

    A dictionary is trained on whole texts, of more than ``MAX_DICT_DOCS`` on those with the smallest hashes.

    Without both labels there is nothing to compare: every score is then the share of good labels, a
    half if there are none.
    """
    y = sample["label"].to_numpy(float)
    drawn = np.array([zlib.crc32(b"half:" + str(i).encode()) for i in sample["doc_id"]], np.int64)
    first = drawn % 3 != 0
    texts = sample["text"].tolist()
    part = lambda label: [texts[i] for i in np.argsort(drawn, kind="stable") if first[i] and y[i] == label][:MAX_DICT_DOCS]
    model = QualityModel(train_dictionary(part(1)), train_dictionary(part(0)), np.zeros(4))
    fair = y[~first]
    if not model.good or not model.bad or fair.min(initial=1) == fair.max(initial=0):
        p = (y.sum() + 1) / (len(y) + 2)
        model.coef[-1] = np.log(p / (1 - p))
        return model
    made = model.compressors()
    x = np.array([features(t, *made) for t, f in zip(texts, first, strict=True) if not f])
    model.coef = fit_logistic(x, fair, ridge=0.1)
    return model


def score_documents(docs: DataFrame, model: QualityModel, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all by default) plus quality_score, 0 to 1.

    Nulls: a null text is empty; an empty text scores by the calibration's intercept. All rows stay,
    repeated ones too; an input column named quality_score is replaced, all others pass through untouched.
    """
    keep = [c for c in (keep or docs.columns) if c != "quality_score"]
    src = docs.select(*keep, F.col("text").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = model.compressors()
        for batch in batches:
            x = np.array([features(t or "", *made) for t in batch.column(len(keep)).to_pylist()]).reshape(batch.num_rows, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(logistic(x, model.coef), pa.float64())], [*keep, "quality_score"])

    return src.mapInArrow(run, docs.select(*keep).schema.add("quality_score", "double"))


def fit_from_tables(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, max_docs: int = MAX_FIT_DOCS) -> QualityModel:
    return fit(training_sample(docs, labels, "quality", modulus, held, max_docs))
