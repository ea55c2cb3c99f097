"""Quality by compression: zstandard dictionaries of good and of bad text.

Each class's dictionary is trained on a bounded sample of labelled texts (SAMPLE_TEXTS distinct texts a class, of up to
SAMPLE_CHARS characters).  A text is compressed whole, in blocks of BLOCK bytes that start afresh, so that the dictionary
and not the text's own past decides; x = (bad - good) / (bad + good), from the summed compressed sizes.  The score is a
logistic function of x, and of u = log(good / size) and its square (text that repeats itself is small under any
dictionary), fitted on other texts of the sample than those that the dictionaries come from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import crc_fold, tidy
from .sampling import labelled_sample

SAMPLE_TEXTS = 1200
SAMPLE_CHARS = 20_000
DICT_BYTES = 112_640
BLOCK = 512
LEVEL = 3
FOLDS, HELD_OUT = 3, 1


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def blocks(text: str | None, size: int = BLOCK) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + size] for i in range(0, len(raw), size)]


class Sizer:
    """Compressed sizes of texts under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.both = []
        for d in (good, bad):
            known = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO)
            known.precompute_compress(level=LEVEL)
            self.both.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """[text, (x, u, u squared)]; x is above zero if the good dictionary compresses better; empty: zeros."""
        out = np.zeros((len(texts), 3))
        for i, text in enumerate(texts):
            if parts := blocks(text):
                good, bad = (sum(map(len, map(compress, parts))) for compress in self.both)
                u = math.log(good / sum(map(len, parts)))
                out[i] = (bad - good) / (bad + good), u, u * u
        return out


def _dictionary(texts: list[str]) -> bytes:
    samples = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their bytes themselves are the dictionary
        return b"".join(samples)[-DICT_BYTES:] or b" " * 8


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100, ridge: float = 0.3) -> np.ndarray:
    """Weights (last: constant) of a ridge-regularised logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Model | None:
    """From the rows of labels for which ``learn`` (a condition on doc_id) holds; None without any of both classes."""
    known = labels.where(learn & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("_label"))
    sample = labelled_sample(docs, known, "_label", SAMPLE_TEXTS, SAMPLE_CHARS)
    texts = {c: [t for label, t in sample if label == c] for c in ("0", "1")}
    if not texts["0"] or not texts["1"]:
        return None
    train = {c: t[: max(1, len(t) * 2 // 3)] for c, t in texts.items()}
    rest = {c: t[len(train[c]) :] or t for c, t in texts.items()}
    good, bad = _dictionary(train["1"]), _dictionary(train["0"])
    x = Sizer(good, bad).features(rest["0"] + rest["1"])
    y = np.array([0.0] * len(rest["0"]) + [1.0] * len(rest["1"]))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    return Model(good, bad, mean, scale, logistic((x - mean) / scale, y))


def with_score(docs: DataFrame, model: Model | None, column: str = "score") -> DataFrame:
    """docs, all columns kept, and the score (0 to 1) of each row's whole text; empty and null texts get the score of features
    that are zero, and without a model every row gets 0.5.  A column of that name is replaced."""
    docs = docs.drop(column)
    if model is None:
        return docs.withColumn(column, F.lit(0.5))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(model.good, model.bad)
        for b in batches:
            score = model.scores(sizer.features(b.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, column])

    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])
    return docs.mapInArrow(tidy(run), schema)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; a null doc_id is not held out, and never learnt from."""
    model = fit(docs, labels, crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    rows = with_score(docs.select("doc_id", "text"), model)
    held = F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
