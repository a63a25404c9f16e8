"""Toxicity by weak supervision.

Voters say yes or nothing on a text: fixed lexicons of insults, surface patterns, and lexicons of
word beginnings that training rows show to be far more frequent in toxic texts. A generative label
model (class prior; each voter's rates of yes in toxic and in other texts; pairwise correlation given
the class) is fitted by expectation maximisation on the voters' answers on every document outside the
held-out fold: equal answers are counted in Spark, and a round of EM adds up sums over those counts. The
labels of a bounded sample stay fixed, all others are inferred; voters that repeat each other share one
vote. The model's posteriors are the soft labels of a linear classifier on hashed words and word
beginnings, trained by FTRL, which scores every text.

Labels are read only for rows outside the held-out fold; language, source and id are never inputs.
Empty and null texts get the score of the bias; repeated rows and ids get a row each and vote each, but
an id counts once in the sample; an empty table gives no rows; other columns are ignored; without labels
only the fixed voters speak. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blob, bounded_batches, materialize
from .linear import BITS, SAMPLE, Featurizer, Ftrl, fold, labelled, scored, slot, training_texts

FOLDS, HELD_OUT = 5, 0
# Words that insult, by kind.
LEXICONS = {
    "person": "idiot moron loser clown fool jerk bastard imbecile pig rat coward",
    "quality": "stupid pathetic worthless disgusting dumb ugly filthy useless vile",
    "refuse": "scum trash garbage filth vermin",
    "threat": "kill die destroy hurt",
}
PATTERNS = (
    re.compile(rb"\b(?:you|your|you're)\W+(?:\w+\W+){0,2}(?:idiot|moron|loser|stupid|scum|trash)", re.I),
    re.compile(rb"\bshut up\b|\bgo away\b|\bi hate\b", re.I),
    re.compile(rb"[@#$%*!]{4,}"),
)
#: Induced voters; with the others they are 63 at most, the bits of a number.
INDUCED = 56
BEGINNINGS = (4, 5, 6)
#: Vote patterns of a partition in the rounds of EM.
PATTERN_ROWS = 200_000
_STRIP = b".,;:!?\"'()[]{}<>*#$%&|-_"
_KEPT_WORDS = 200_000


class _Words(dict):
    """Feature numbers of a lower-case word, packed: itself and its beginnings."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        own = word.strip(_STRIP)
        tokens = {b"w" + own} | {b"p" + own[:k] for k in BEGINNINGS if len(own) > k} if own else set()
        out = self[word] = np.array([slot(t) for t in sorted(tokens)], "<i4").tobytes()
        return out


def featurizer() -> Featurizer:
    known = _Words()

    def make(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        at = np.unique(np.frombuffer(b"".join(map(known.__getitem__, set(text.lower().split()))), "<i4"))
        return at, np.ones(len(at), np.float32)

    return make


def terms(text: bytes) -> set[bytes]:
    words = {w.strip(_STRIP) for w in set(text.lower().split())}
    return {w + b"$" for w in words if w} | {w[:k] for w in words for k in BEGINNINGS if len(w) > k}


def induce(texts: list[bytes], y: np.ndarray, most: int = INDUCED) -> list[bytes]:
    """Terms whose frequency in toxic texts stands out, each with texts that those before it lack.

    The score is the lower end of the log odds (half counts, two standard errors); a term must add a
    third of its own toxic texts, so endings of one stem do not fill the list."""
    toxic = [i for i in range(len(texts)) if y[i] > 0.5]
    counts = (Counter(), Counter())
    for i in toxic:
        counts[1].update(terms(texts[i]))
    often = {t for t, c in counts[1].items() if c > 1}
    for i in range(len(texts)):
        if y[i] <= 0.5:
            counts[0].update(terms(texts[i]) & often)
    n1, n0 = int((y > 0.5).sum()), int((y <= 0.5).sum())
    score = {}
    for term in often:
        c = counts[1][term]
        a, b = c + 0.5, counts[0][term] + 0.5
        low = np.log(a / (n1 + 1)) - np.log(b / (n0 + 1)) - 2 * np.sqrt(1 / a + 1 / b)
        if a / (n1 + 1) > 8 * b / (n0 + 1):
            score[term] = low
    where: dict[bytes, list[int]] = {t: [] for t in score}
    for i in toxic:
        for term in terms(texts[i]) & score.keys():
            where[term].append(i)
    seen, out = np.zeros(len(texts), bool), []
    for term in sorted(score, key=lambda t: (-counts[1][t] * min(1, max(0.1, score[t])), -score[t], len(t), t)):
        if len(out) < most and 3 * (~seen[where[term]]).sum() >= counts[1][term]:
            seen[where[term]] = True
            out.append(term)
    return out


def lexicons(induced: list[bytes]) -> list[set[bytes]]:
    """Terms of each voter that looks for words."""
    return [{w.encode() + b"$" for w in words.split()} for words in LEXICONS.values()] + [{t} for t in induced]


def votes(texts: list[bytes], patterns: list[list[bool]], induced: list[bytes]) -> np.ndarray:
    """A row for each text (its words will do), a column for each voter: 1 for yes, 0 for nothing.
    patterns: the answers of PATTERNS on the whole text."""
    looking = lexicons(induced)
    out = np.zeros((len(texts), len(looking) + len(PATTERNS)), np.int8)
    for i, text in enumerate(texts):
        own = terms(text)
        out[i, : len(looking)] = [not own.isdisjoint(x) for x in looking]
        out[i, len(looking) :] = patterns[i]
    return out


class LabelModel:
    """Rates of yes by class and correlations of unipolar voters, fitted by EM.

    A voter that says nothing abstains: insults of one language say nothing about another's. Texts
    without any vote have a prior of their own. Rows whose label is known keep it while rates are
    estimated; their posteriors still come from the votes alone. All that a round needs of the rows is
    sums, so rows may lie anywhere: `others` gives the sums of rows that are not here."""

    def fit(self, v: np.ndarray, known: np.ndarray, rounds: int = 30, others: Callable[[LabelModel, bool], np.ndarray] | None = None) -> LabelModel:
        """known: labels, NaN where there is none. others(model, squares): sums() of further rows."""
        k = v.shape[1]
        self.weight, self.prior, self.size = np.ones(k), None, k
        for i in range(rounds):
            total = self.sums(v, known) + (others(self, False) if others else 0)
            n, n1, silent, silent1 = total[:4]
            # A yes is rarer in other texts: the pseudo-counts say so and keep the classes from swapping.
            yes1, yes0 = (total[4 : 4 + k] + 0.1) / (n1 + 2), (total[4 + k :] + 0.3) / (n - n1 + 2)
            prior = np.clip(n1 / max(n, 1), 1e-3, 1 - 1e-3)
            change = 1 if self.prior is None else max(np.abs(yes1 - self.yes1).max(initial=0), np.abs(yes0 - self.yes0).max(initial=0), abs(prior - self.prior))
            if i in (1, 5):
                # Squares are taken around what the rows' present classes lead to expect.
                squares = self.sums(v, known, (yes1, yes0)) + (others(self, (yes1, yes0)) if others else 0)
                self.weight = self.shared(squares.reshape(k, k) / max(n, 1))
            self.yes1, self.yes0, self.prior = yes1, yes0, prior
            self.silent = np.clip((silent1 + 0.1) / (silent + 2), 1e-4, 0.5)
            if change < 1e-4 and i > 5:
                break
        return self

    def sums(self, v: np.ndarray, known: np.ndarray | None = None, rates: tuple | None = None, n: np.ndarray | None = None) -> np.ndarray:
        """Of rows with votes v, n of each: their number, that of toxic ones, the same of silent rows, and
        yes votes by class; with rates, the products of what each two voters say beyond the expected."""
        n = np.ones(len(v)) if n is None else n
        any_vote = v.any(1)
        q = np.where(any_vote, 0.5, 0.05) if self.prior is None else self.posterior(v)
        if known is not None:
            q = np.where(np.isnan(known), q, known)
        if rates:
            rest = v - np.outer(q, rates[0]) - np.outer(1 - q, rates[1])
            return ((rest * n[:, None]).T @ rest).ravel()
        quiet = n * ~any_vote
        return np.r_[n.sum(), n @ q, quiet.sum(), quiet @ q, (n * q) @ v, (n * (1 - q)) @ v]

    def shared(self, moments: np.ndarray) -> np.ndarray:
        """Weight of each voter: one over the voters it agrees with beyond what the class explains."""
        sd = np.sqrt(np.diag(moments)) + 1e-6
        self.correlation = moments / np.outer(sd, sd)
        return 1 / np.clip(self.correlation, 0, 1).sum(1).clip(1)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        yes = np.log(self.yes1) - np.log(self.yes0)
        base = np.where(v.any(1), self.prior, self.silent)
        logit = np.log(base / (1 - base)) + v @ (yes * self.weight)
        return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


class _Ballots(dict):
    """Votes of a lower-case word, as bits."""

    def __init__(self, lexicons: list[set[bytes]]):
        self.voters = {}
        for i, terms_of in enumerate(lexicons):
            for t in terms_of:
                self.voters[t] = self.voters.get(t, 0) | 1 << i

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        own = word.strip(_STRIP)
        out = self.voters.get(own + b"$", 0) if own else 0
        for k in BEGINNINGS:
            if len(own) > k:
                out |= self.voters.get(own[:k], 0)
        self[word] = out
        return out


def vote_counts(docs: DataFrame, induced: list[bytes], without: set[int]) -> DataFrame:
    """votes (bits, in the order of votes()) and n: how many documents outside the held-out fold vote so, in
    their whole texts; ids in `without` are left out. Tasks add up before they send."""
    shared = docs.sparkSession.sparkContext.broadcast((induced, without))
    schema = pa.schema([("votes", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        induced, without = shared.value
        own = lexicons(induced)
        ballots, total = _Ballots(own), Counter()
        for batch in batches:
            for row, text in zip(batch["id"].to_pylist(), blob(batch["text"]), strict=True):
                if row in without:
                    continue
                said = reduce(or_, map(ballots.__getitem__, set(text.lower().split())), 0)
                for i, p in enumerate(PATTERNS, len(own)):
                    said |= (p.search(text) is not None) << i
                total[said] += 1
            if len(total) > 100_000:
                yield pa.record_batch([pa.array(list(x), pa.int64()) for x in zip(*total.items(), strict=True)], schema=schema)
                total = Counter()
        if total:
            yield pa.record_batch([pa.array(list(x), pa.int64()) for x in zip(*total.items(), strict=True)], schema=schema)

    bounded_batches(docs.sparkSession)
    rows = docs.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    counts = materialize(rows.mapInArrow(run, "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n")))
    return counts.coalesce(1 + counts.count() // PATTERN_ROWS)


def unpacked(bits: np.ndarray, voters: int) -> np.ndarray:
    return (bits[:, None] >> np.arange(voters) & 1).astype(np.int8)


def summed_votes(counts: DataFrame, voters: int) -> Callable[[LabelModel, bool], np.ndarray]:
    """The `others` of LabelModel.fit(): sums over counts(votes, n), made where the rows lie. The driver
    gets one vector of a size fixed by the voters from each partition, of PATTERN_ROWS vote patterns or so."""

    def total(model: LabelModel, rates: tuple | bool) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(voters * voters if rates else 4 + 2 * voters)
            for batch in batches:
                out += model.sums(unpacked(batch["votes"].to_numpy(), voters), None, rates or None, batch["n"].to_numpy().astype(float))
            yield pa.record_batch([pa.array([out], pa.list_(pa.float64()))], names=["sums"])

        return sum((np.array(r["sums"]) for r in counts.mapInArrow(run, "sums array<double>").collect()), np.zeros(voters * voters if rates else 4 + 2 * voters))

    return total


def telling(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Which features are worth a weight: more frequent in toxic rows by two standard errors, and in
    enough of them that a few copies of one text don't qualify."""
    counts = [np.zeros(size), np.zeros(size)]
    for at, label in zip(rows, y, strict=True):
        counts[int(label > 0.5)][at] += 1
    n1, n0 = (y > 0.5).sum(), (y <= 0.5).sum()
    a, b = counts[1] + 0.5, counts[0] + 0.5
    low = np.log(a / (n1 + 1)) - np.log(b / (n0 + 1)) - 2 * np.sqrt(1 / a + 1 / b)
    return (low > 1.3) & (counts[1] >= max(3, n1 / 100))


def voted(rows: DataFrame) -> DataFrame:
    """id, y, the distinct lower-case words and the answers of PATTERNS of rows(id, text, y), from whole texts."""
    schema = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("words", pa.binary()), ("patterns", pa.list_(pa.bool_()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = blob(batch["text"])
            words = [b" ".join(sorted(set(t.lower().split()))) for t in texts]
            yield pa.record_batch([batch["id"], batch["y"], pa.array(words, pa.binary()), pa.array([[p.search(t) is not None for p in PATTERNS] for t in texts], pa.list_(pa.bool_()))], schema=schema)

    bounded_batches(rows.sparkSession)
    return rows.select(F.col("id").cast("long"), "text", F.col("y").cast("int")).mapInArrow(run, "id long, y int, words binary, patterns array<boolean>")


def unlabelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """id, text and a null y of at most `sample` documents outside the held-out fold that have no label."""
    train = fold(F.col("doc_id"), FOLDS) != HELD_OUT
    known = labels.filter(F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("id")).distinct()
    ids = docs.filter(train & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id")).distinct().join(known, "id", "left_anti")
    return training_texts(docs, ids.withColumn("y", F.lit(None).cast("int")), sample)


def training(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[list[bytes], np.ndarray, np.ndarray, list[bytes], set[int]]:
    """Words, labels (NaN where there is none), votes, induced voters and labelled ids of the training rows."""
    known = labelled(docs, labels, "toxic", fold(F.col("doc_id"), FOLDS) != HELD_OUT, sample)
    chosen = voted(known.unionByName(unlabelled(docs, labels, sample // 3)))
    rows = chosen.toPandas().sort_values(["id", "words"], kind="stable")
    texts, y = [bytes(w) for w in rows["words"]], rows["y"].to_numpy(float)
    told = np.flatnonzero(~np.isnan(y))
    induced = induce([texts[i] for i in told], y[told]) if len(told) else []
    return texts, y, votes(texts, rows["patterns"].tolist(), induced), induced, set(rows["id"].iloc[told].tolist())


def label_model(docs: DataFrame, y: np.ndarray, v: np.ndarray, induced: list[bytes], told: set[int]) -> LabelModel:
    """EM over the labelled training rows and the votes of all other documents outside the held-out fold."""
    seeds = ~np.isnan(y)
    counts = vote_counts(docs, induced, told)
    return LabelModel().fit(v[seeds], y[seeds], others=summed_votes(counts, v.shape[1]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights of the classifier. Every document outside the held-out fold votes; the classifier then learns
    the posteriors of at most `sample` labelled rows of that part and a third as many without a label."""
    texts, y, v, induced, told = training(docs, labels, sample)
    if not len(texts):
        weights = np.zeros((1 << BITS) + 1, np.float32)
        weights[-1] = np.log(0.05 / 0.95)  # nothing is known: not toxic
        return weights
    soft = label_model(docs, y, v, induced, told).posterior(v)
    make = featurizer()
    rows = [make(text)[0].astype(np.int64) for text in texts]
    keep = telling(rows, soft, 1 << BITS)
    rows = [at[keep[at]] for at in rows]
    return Ftrl(alpha=0.5, l1=0.3, l2=0.05).fit([(at, np.ones(len(at)), q) for at, q in zip(rows, soft, strict=True)], epochs=6)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = scored(docs, featurizer, train(docs, labels, sample))
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
