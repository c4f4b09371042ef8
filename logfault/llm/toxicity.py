"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words, their pairs, pairs with one word between and the beginnings of words
(3, 4 and 5 letters; inflected forms share them) are hashed to coordinates.
Training runs three times through a bounded sample of labelled rows: each
coordinate has its own learning rate, and the L1 term keeps weights at zero
until evidence adds up, so the model is a short list of coordinates. Its size
is at most ``2 ** BITS``, whatever the corpus; it is sent to the tasks, which
score every text on its own without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Coordinates are hashes of this many bits.
BITS = 20
#: Labelled rows that training reads at most, those with the smallest hash of their id.
SAMPLE = 20_000
_WORD = re.compile(r"\w+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PREFIXES = (3, 4, 5)
#: Words of a text that are hashed at once.
_CHUNK = 1 << 16


class _Words(dict):
    """Word to a row of ``code`` and ``slots`` (the word and its beginnings)."""

    limit = 200_000

    def __init__(self) -> None:
        super().__init__()
        self.code = np.zeros(self.limit + _CHUNK + 2, np.uint64)
        self.slots = np.zeros((self.limit + _CHUNK + 2, 1 + len(_PREFIXES)), np.int64)

    def _add(self, words: list[str]) -> None:
        first = len(self)
        self.update(zip(words, range(first, first + len(words))))
        crc = zlib.crc32
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        codes = np.array([[crc(w) for w in raw], *([crc(("^" + w[:n]).encode("utf-8", "surrogatepass")) if len(w) >= n else 0
                                                   for w in words] for n in _PREFIXES)], np.uint64)
        codes = np.where(codes == 0, codes[0], codes)
        self.code[first:first + len(words)] = codes[0]
        self.slots[first:first + len(words)] = _slots(codes).T

    def rows(self, words: list[str]) -> np.ndarray:
        """At most ``_CHUNK + 2`` words at once; starts afresh when full."""
        if len(self) > self.limit:
            self.clear()
        rows = [self.get(w, -1) for w in words]
        if new := list(dict.fromkeys(w for w, r in zip(words, rows) if r < 0)):
            self._add(new)
            rows = [self[w] for w in words]
        return np.array(rows, np.int64)


def _slots(codes: np.ndarray) -> np.ndarray:
    codes = codes * _A
    codes ^= codes >> np.uint64(31)
    codes *= _B
    return (codes >> np.uint64(64 - BITS)).astype(np.int64)


_words = _Words()


def _touched(text: str) -> Iterator[np.ndarray]:
    words = _WORD.findall(text.lower())
    yield np.zeros(1, np.int64)  # the intercept, also of empty texts
    for at in range(0, len(words), _CHUNK):
        rows = _words.rows(words[max(0, at - 2):at + _CHUNK])
        one = _words.code[rows]
        mixed = one * _A
        yield _words.slots[rows].ravel()
        yield _slots(mixed[:-1] + one[1:] * _B + np.uint64(1))
        yield _slots(mixed[:-2] + one[2:] * _B + np.uint64(2))


def features(text: str) -> np.ndarray:
    """The coordinates that a text touches, each once, in ascending order."""
    return np.unique(np.concatenate([np.unique(part) for part in _touched(text)]))


def score_of(text: str, dense: np.ndarray) -> float:
    """The probability under weights ``dense``; coordinates without a weight are dropped before the sort."""
    used = np.concatenate([part[dense[part] != 0] for part in _touched(text)])
    return probability(dense[np.unique(used)].sum())


@dataclass
class Ftrl:
    """FTRL-proximal with per-coordinate rates."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1

    def __post_init__(self) -> None:
        self.z = np.zeros(1 << BITS)
        self.n = np.zeros(1 << BITS)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = probability(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g

    def model(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(np.abs(self.z) > self.l1)
        return at, self.weights(at)


def probability(score: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(score, -35, 35))))


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; 0 marks held-out rows. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)), F.lit(0))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample: int = SAMPLE, passes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights learned from rows that are not held out.

    At most ``sample`` labelled rows are read, those with the smallest hash of
    their id (ties by id and text), so the model does not depend on the order
    of rows. One task streams through them and keeps only two arrays of
    ``2 ** BITS`` numbers. Rows with a null label teach nothing; without any
    label the model is empty and scores are 0.5.
    """
    marked = (labels.select(F.col(id_col).alias("_label_id"), F.col(label_col).cast("int").alias("_label"))
              .filter(F.col("_label").isNotNull() & (remainder("_label_id") != 0)))
    order = [F.xxhash64("_label_id"), F.col("_label_id"), F.col("_label")]
    chosen = marked.distinct().orderBy(*order).limit(sample)
    rows = (df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
            .join(F.broadcast(chosen), F.col("_id") == F.col("_label_id"))  # at most ``sample`` rows
            .select(F.xxhash64("_label_id", F.lit(7)).alias("_order"), "_text", "_label"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ftrl, seen = Ftrl(), []
        for batch in batches:
            for text, label in zip(batch["_text"].to_pylist(), batch["_label"].to_pylist()):
                at = features(text).astype(np.int32)
                ftrl.learn(at, label)
                if passes > 1:
                    seen.append((at, label))
        for _ in range(passes - 1):
            for at, label in seen:
                ftrl.learn(at, label)
        at, w = ftrl.model()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], names=["at", "w"])

    one = rows.repartition(1).sortWithinPartitions("_order", "_text", "_label").drop("_order")
    model = one.mapInArrow(fit, "at long, w double").toPandas()
    return model["at"].to_numpy(), model["w"].to_numpy()


def toxicity(df: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text") -> Column:
    """The probability that each text is toxic; null counts as the empty text."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        at, w = sent.value
        dense = np.zeros(1 << BITS)
        dense[at] = w
        return pd.Series([score_of(t, dense) for t in texts], dtype="float64")
    return score(text_of(text_col))


def scored(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``df``.

    Repeated rows get equal scores, null and empty texts the score of the
    intercept. Columns other than id and text are not read.
    """
    model = train(df, labels, id_col, text_col)
    rows = df.select(F.col(id_col).alias("doc_id"), (remainder(id_col) == 0).alias("held_out"),
                     toxicity(df, model, text_col).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows that score 0.5 or more; all columns stay."""
    return df.filter(toxicity(df, train(df, labels, id_col, text_col), text_col) < 0.5)
