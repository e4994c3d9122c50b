"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's tokens are its words and its runs of other printable characters; the features are hashed tokens, pairs of
neighbours, pairs of their shapes (letter case, digits, marks) and repetitions, as counts scaled to length one, plus a
constant. A score is the sigmoid of a sparse dot product.

Defined cases: a null or empty text has the constant feature only; labels other than 0 and 1, and documents whose
labels differ from row to row, are not learnt from; without any label every score is 0.5; rows that repeat are scored
as often as they come; an empty table gives no rows; other columns pass through `score` unread.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import free_name

BITS = 18
#: Labelled documents that are learnt from, by hash of their id; the fit of this bounded sample is one task's work.
SAMPLE = 8000
EPOCHS = 3
THRESHOLD = 0.3
#: Step size, its smoothing, and the penalties of the sum of weights and of their squares.
ALPHA, BETA, L1, L2 = 0.8, 1.0, 0.02, 0.02

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MASK = np.uint64((1 << BITS) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Codes(dict):
    """Hash and shape hash of a token, kept while the worker's vocabulary is small."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) > 300_000:
            self.clear()
        if token[0].isalpha():
            shape = "A" if token.isupper() and len(token) > 1 else "Aa" if token[0].isupper() else "a"
        else:
            shape = "0" if token[0].isalnum() else token[0] + ("+" if len(token) > 1 else "")
        self[token] = found = (xxhash.xxh64_intdigest(token.lower()), xxhash.xxh64_intdigest(shape, 1))
        return found


_CODES = _Codes()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of a text's features; position 0 is the constant."""
    codes = [_CODES[t] for t in _TOKEN.findall(text or "")]
    if not codes:
        return np.zeros(1, np.int64), np.ones(1)
    both = np.array(codes, np.uint64)
    words, shapes = both[:, 0], both[:, 1]
    pairs = words[:-1] * _MIX + words[1:]
    forms = (shapes[:-1] * _MIX + shapes[1:]) ^ _MIX
    again = np.full(int((words[:-1] == words[1:]).sum()), 12345, np.uint64)
    every = np.concatenate([words, pairs, shapes, forms, again])
    at, count = np.unique(1 + ((every ^ (every >> np.uint64(29))) * _MIX >> np.uint64(64 - BITS)).astype(np.int64) % (1 << BITS), return_counts=True)
    value = count / math.sqrt(float((count * count).sum()))
    return np.concatenate([[0], at]), np.concatenate([[1.0], value])


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after `epochs` passes over the rows (positions, values, label) in their order."""
    z, n, w = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(epochs):
        for at, value, label in rows:
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (_sigmoid(float(wi @ value)) - label) * value
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] = zi + g - step * wi
            n[at] = ni + g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def fold(doc_id: Column) -> Column:
    """The fifth of the documents a row belongs to; 0 is held out."""
    return F.crc32(doc_id.cast("string")).cast("long") % 5


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights learnt from at most `sample` labelled documents that are not held out.

    Where rows share a labelled id, the one whose text has the least hash is learnt from.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2"))
    chosen = known.where((F.col("y") == F.col("y2")) & (fold(F.col("doc_id")) != 0)).select("doc_id", "y", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample)
    # At most `sample` rows of three numbers.
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("t")).join(F.broadcast(chosen), "doc_id")

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [features(t) for t in f["text"]]
            yield pd.DataFrame({"h": f["h"], "t": f["t"], "y": f["y"].astype("float64"), "at": [a for a, _ in found], "value": [v.astype(np.float32) for _, v in found]})

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(h, len(at), np.asarray(at, np.int64), np.asarray(value, np.float64), y) for f in frames for h, y, at, value in zip(f["h"], f["y"], f["at"], f["value"], strict=True)]
        held.sort(key=lambda r: (r[0], r[1], r[4]))
        w = train([r[2:] for r in held])
        where = np.flatnonzero(w)
        yield pd.DataFrame({"at": where, "w": w[where]})

    each = rows.mapInPandas(extract, "h long, t long, y double, at array<long>, value array<float>")
    # One row for each id, however often it repeats, so that the one task of the fit holds `sample` rows.
    one = each.groupBy("h", "y").agg(F.min(F.struct("t", "at", "value")).alias("r")).select("h", "y", "r.at", "r.value")
    found = one.repartition(1).mapInPandas(learn, "at long, w double")
    weights = np.zeros((1 << BITS) + 1)
    # One number for each of the 2^BITS positions at most.
    for at, w in found.toLocalIterator():
        weights[at] = w
    return weights


def score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """All columns and the probability of quality in the column `name`."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def dot(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for texts in batches:
            yield pd.Series([_sigmoid(float(w[at] @ value)) for at, value in map(features, texts)], dtype="float64")

    return docs.withColumn(name, dot(F.col("text")))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, with all their columns."""
    name = free_name(docs.columns, "score")
    return score(docs, fit(docs, labels), name).where(F.col(name) >= threshold).select(*docs.columns)
