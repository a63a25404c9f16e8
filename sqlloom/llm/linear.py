"""Hashed sparse linear models: feature extraction in Arrow batches, FTRL-proximal training, scoring.

A document's features come from its whole text. Models are trained on the driver from a sample of feature
vectors, bounded in documents (SAMPLE) and bytes of text (SAMPLE_BYTES); a model is a vector of 2 ** BITS
weights, so its size never grows. A doc_id that repeats is one document of the sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import blob, bounded_batches, materialize

BITS = 22
#: Labelled rows that a model is trained on at most; those of least hash are taken.
SAMPLE = 6_000
#: Bytes of text that a model is trained on at most.
SAMPLE_BYTES = 64 << 20

#: Text to (feature numbers, values); numbers below 2 ** BITS, which may repeat and then add up.
Featurizer = Callable[[bytes], tuple[np.ndarray, np.ndarray]]


def slot(token: bytes) -> int:
    return xxh3_64_intdigest(token) & ((1 << BITS) - 1)


def fold(column: Column, parts: int) -> Column:
    """crc32 of the number as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts


def summed(at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One value for each number."""
    at, inverse = np.unique(at, return_inverse=True)
    return at.astype(np.int32), np.bincount(inverse, value, len(at)).astype(np.float32)


def vectors(docs: DataFrame, featurizer: Callable[[], Featurizer], *keep: str) -> DataFrame:
    """keep columns, `at` array<int> and `value` array<float> for each row of docs(text, keep...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = featurizer()
        for batch in batches:
            made = [summed(*make(t)) for t in blob(batch["text"])]
            columns = [pa.array([x[0] for x in made], pa.list_(pa.int32())), pa.array([x[1] for x in made], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keep), *columns], [*keep, "at", "value"])

    bounded_batches(docs.sparkSession)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return docs.select("text", *keep).mapInArrow(run, ", ".join([*fields, "at array<int>", "value array<float>"]))


def training_texts(docs: DataFrame, chosen: DataFrame, sample: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """id, text and y of the documents chosen(id, y), at most `sample` of them: one text for each id, that of
    least hash, until `most_bytes` are full. Rows of an id that repeats, however often, combine in their tasks."""
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = texts.join(F.broadcast(chosen), "id")  # `sample` rows of two numbers
    one = materialize(own.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("id", "y", "t.text"))
    # At most `sample` rows: one window over them is no task that grows.
    sizes = one.select("id", F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)).alias("bytes"))
    return one.join(F.broadcast(sizes.filter(F.col("bytes") <= most_bytes).select("id")), "id").select("id", "text", "y")


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, sample: int = SAMPLE) -> DataFrame:
    """id, text and y of at most `sample` documents whose label is known and whose doc_id satisfies keep.

    Labels are few and narrow beside texts. Repeated label rows count once (the larger label); null
    labels and null ids are left out."""
    known = labels.filter(keep & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    return training_texts(docs, known, sample)


class Ftrl:
    """Logistic regression by follow-the-regularised-leader (proximal) updates.

    z gathers gradients less the pull of the current weights, n their squares; a weight is zero until
    |z| passes l1, so features that tell nothing stay out of the model."""

    def __init__(self, size: int = 1 << BITS, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.full(len(z), self.l1)
        l1[-1] = 0  # the bias comes last and is free
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def update(self, at: np.ndarray, value: np.ndarray, y: float, weight: float = 1.0) -> float:
        at, value = np.append(at, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - y) * weight * value
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        return p

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 3, seed: int = 7) -> np.ndarray:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                self.update(*rows[i])
        used = np.append(np.flatnonzero(self.n[:-1]), len(self.n) - 1)
        out = np.zeros(len(self.n), np.float32)
        out[used] = self.weights(used)
        return out


def collected(frame: DataFrame) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """A bounded sample's vectors on the driver, in an order that depends on content only."""
    table = materialize(frame).toArrow().sort_by("id")
    return [(a.values.to_numpy(), v.values.to_numpy(), float(y.as_py())) for a, v, y in zip(table["at"], table["value"], table["y"], strict=True)]


def scored(docs: DataFrame, featurizer: Callable[[], Featurizer], weights: np.ndarray) -> DataFrame:
    """doc_id and score (a sparse dot product through the logistic function) of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2 ** BITS + 1 floats
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, w = featurizer(), shared.value
        for batch in batches:
            out = []
            for text in blob(batch["text"]):
                at, value = make(text)
                out.append(1 / (1 + np.exp(-np.clip(w[at] @ value + w[-1], -35, 35))))
            yield pa.record_batch([batch["doc_id"], pa.array(out, pa.float64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
