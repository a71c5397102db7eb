"""Toxicity scores from FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.llm.common import FOLD, SpanHash, Texts, add_columns, byte_values, mix64, table_of

#: 2**BITS weights: their broadcast has a fixed size.
BITS = 20
MOST_ROWS, EPOCHS = 20_000, 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.0
THRESHOLD = 0.7

#: Words: runs of digits, letters and non-ASCII characters.
WORD = table_of([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
VALUES = byte_values(2)[FOLD]
SCORE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and feature number of every word, pair of neighbours and pair with one word between."""
    texts = Texts(column)
    start, end, first = texts.words(WORD)
    row = np.repeat(np.arange(texts.rows), np.diff(first))
    word = SpanHash(texts.data, VALUES).of(start, end)
    rows, found = [row], [word]
    for skip in (1, 2):
        same = row[skip:] == row[:-skip]
        rows.append(row[skip:][same])
        found.append(mix64(word[:-skip] * np.uint64(2 * skip + 1) + (word[skip:] ^ np.uint64(skip)))[same])
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), texts.rows


class Ftrl:
    """Per-coordinate rates and L1 sparsity; features are present or absent."""

    def __init__(self):
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def learn(self, at: np.ndarray, label: float) -> None:
        at = np.append(at, 1 << BITS)  # the bias
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def train(rows: list[tuple[float, np.ndarray]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights (float32, most of them 0) and bias from (label, feature numbers) in the given order."""
    model = Ftrl()
    for _ in range(epochs):
        for label, at in rows:
            model.learn(at, label)
    w = model.weights(slice(None))
    return w[:-1].astype(np.float32), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", most_rows: int = MOST_ROWS) -> tuple[np.ndarray, float]:
    """Learn from at most about ``most_rows`` labelled rows, chosen by a hash of the key.

    A key with several labels counts as toxic if one of them is; null keys, labels and texts teach nothing. The
    chosen keys are few, so they are broadcast and the texts are hashed where they lie; only feature numbers
    reach the driver.
    """
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label).cast("double")).alias("_label"))
    n = marked.count()
    chosen = marked.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < F.lit(min(1 << 30, int((1 << 30) * most_rows / max(1, n)) + 1)))
    rows = docs.where(F.col(text).isNotNull()).join(F.broadcast(chosen), F.col(key) == F.col("_key")).select("_key", "_label", F.col(text).cast("string").alias("_text"))

    def make():
        def work(column):
            row, found, n = features(column)
            pairs = np.unique(row * np.int64(1 << BITS) + found)
            ends = np.searchsorted(pairs, np.arange(n + 1, dtype=np.int64) << BITS)
            return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((pairs & ((1 << BITS) - 1)).astype(np.int32)))]

        return work

    kind = T.StructType([T.StructField("_found", T.ArrayType(T.IntegerType()))])
    got = add_columns(rows, "_text", ["_key", "_label"], kind, make).withColumn("_h", F.xxhash64("_key")).toArrow()
    order = np.argsort(got.column("_h").to_numpy(), kind="stable")
    lists = got.column("_found").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    marks = got.column("_label").to_numpy()
    return train([(marks[k], values[ends[k] : ends[k + 1]]) for k in order])


def score(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns of ``docs`` with score (0 to 1) and predicted (1 if score >= ``threshold``), from whole texts.

    Null, empty and wordless texts get the score of the bias alone; equal texts get equal scores; an empty table
    gives an empty one. No shuffle; the broadcast is the non-zero weights, at most 2**BITS of them.
    """
    weights, bias = model
    used = np.flatnonzero(weights).astype(np.int32)
    shared = spark.sparkContext.broadcast((used, weights[used], bias))

    def make():
        at, w, base = shared.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = w

        def work(column):
            row, found, n = features(column)
            hit = dense[found] != 0
            pairs = np.unique(row[hit] * np.int64(1 << BITS) + found[hit])
            total = base + np.bincount(pairs >> BITS, dense[pairs & ((1 << BITS) - 1)].astype(np.float64), n)
            p = 1.0 / (1.0 + np.exp(-np.clip(total, -500, 500)))
            return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

        return work

    return add_columns(docs, text, keep, SCORE, make)
