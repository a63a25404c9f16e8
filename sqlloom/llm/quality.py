"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL updates.

n-grams are taken over the words as they stand and over their shapes (runs of lower-case letters,
capitals and digits each become one sign, so `THE!!` is `A!!`), one and two words long. A word that
equals the one before it is written `=` in a bigram, and a bigram that the text had before gives one
more token; so repetition is visible whatever the words are. Values are shares of the text's n-grams.

Empty and null texts have no n-grams and get the score of the bias less a fixed token for "no words".
Repeated rows and ids get a row each, and count once in training; an empty table gives no rows; without
training rows every score is one half; other columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import BITS, SAMPLE, Featurizer, Ftrl, collected, fold, labelled, scored, slot, vectors

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Shares are small numbers; this scales them to what the learning rate expects.
SCALE = 20.0
_KEPT_WORDS = 200_000
_MASK = np.uint64((1 << BITS) - 1)
_SEEN, _EMPTY, _SAME = slot(b"<seen>"), slot(b"<empty>"), slot(b"<same>")


class _Words(dict):
    """Hash of a word (low 32 bits) and of its shape (high 32 bits)."""

    runs = re.compile(rb"[a-z\x80-\xff]+|[A-Z]+|[0-9]+|([^A-Za-z0-9\x80-\xff])\1{2,}")

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        sign = lambda m: m[1] * 3 if m[1] else b"A" if m[0][:1].isupper() else b"0" if m[0][:1].isdigit() else b"a"
        shape = self.runs.sub(sign, word)
        out = self[word] = slot(b"w" + word) * 0x10001 & 0xFFFFFFFF | (slot(b"s" + shape) * 0x10001 & 0xFFFFFFFF) << 32
        return out


def featurizer() -> Featurizer:
    known = _Words()

    def pairs(h: np.ndarray, kind: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:] + np.uint64(kind)) * np.uint64(0xBF58476D1CE4E5B9)
        return mixed >> np.uint64(64 - BITS)

    def make(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        n = len(words)
        if not n:
            return np.array([_EMPTY], np.int32), np.ones(1, np.float32)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
        word, shape = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
        parts = [word & _MASK, shape & _MASK]
        if n > 1:
            two = pairs(word, 1)
            again = n - 1 - len(np.unique(two))
            two[word[1:] == word[:-1]] = _SAME
            parts += [two, pairs(shape, 2), np.full(again, _SEEN, np.uint64)]
        at = np.concatenate(parts).astype(np.int32)
        return at, np.full(len(at), SCALE / n, np.float32)

    return make


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights, learnt from rows outside the held-out fold only; at most `sample` of them."""
    chosen = labelled(docs, labels, "quality", fold(F.col("doc_id"), FOLDS) != HELD_OUT, sample)
    return Ftrl(alpha=0.3, l1=0.3).fit(collected(vectors(chosen, featurizer, "id", "y")))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = scored(docs, featurizer, train(docs, labels, sample))
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
