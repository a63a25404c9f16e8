"""Quality rules: counting rules, and n-gram perplexity bands by language.

The language model is a modified Kneser-Ney model over symbols: Latin letters, digits and signs are
folded into SYMBOLS classes, and every other character is a symbol of its own. Every text is counted;
tasks add up what they read and Spark sums their counts by n-gram. The model is held, and searched by
workers, as sorted arrays of n-gram numbers (without collisions) with the discounted share of each, and of
contexts with what they leave to shorter ones. N-grams of classes alone are at most SYMBOLS ** ORDER. A
corpus with more than HELD n-grams, which takes other characters, gets the same model by joins: workers
hold the n-grams of classes, and the others of each text meet their shares in a shuffled join.

A document is rejected if it has fewer than MIN_WORDS words, if repeated three-word windows cover
more than half of its words, or if its log perplexity lies outside its language's band: the median,
less and plus some distances between quartiles, over all documents of that language that pass the
counting rules. The band is wider for short texts, whose mean over characters is noisier.

Nulls are empty texts, which fail; null languages share a band; repeated rows and ids get a row each;
an empty table gives no rows; other columns are ignored by judge() and kept by apply(), whatever their
names. A text on the very edge of its band is kept; a language with one text, or with equal ones, has the
least band. Texts of any length are read whole; what is held beside one grows with its characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, keyed, lookup, materialize

ORDER, SYMBOLS = 4, 46
#: N-grams that the driver and each worker may hold of a corpus with characters beyond the classes.
HELD = 2_000_000
MIN_WORDS, MAX_REPEAT = 50, 50
#: Half width of a language's band in quartile distances: WIDTH, and SPREAD more at one word, falling
#: with the root of the words as the noise of a mean does; and the least quartile distance counted (smaller
#: than any language's on the test tables). Set so that labelled clean texts of sf0.1 stay (README).
WIDTH, SPREAD, FLOOR = 2.0, 20.0, 0.025
#: Accuracy of the sketch that narrows the search for quartiles, and the errors of it that are searched.
SKETCH, MARGIN = 10_000, 2
_BLANK = " \t\n\v\f\r"
_SIGNS = "#*$%&|<>"
# Classes beyond a-z of the alphabet, in order from 26 on.
_CLASSES = (
    " \t\v\f\r", "\n", "0123456789", ".", ",", "?!", ":;", "'\"`´’‘“”«»", "()[]{}", "-–—_/\\", "#*&|<>~^=+", "$%@€£¥°§",
    "äàáâãåæ", "öóòôõøœ", "üúùû", "ß", "éèêë", "ç", "ñ", "íìîï",
)
#: The symbols of an n-gram; a symbol is a class, or SYMBOLS and a code point.
GRAM = [f"s{i}" for i in range(ORDER)]
_NONE = np.empty(0, np.int32)
#: N-grams that are added up at once.
_STEP = 500_000


def _alphabet() -> np.ndarray:
    table = np.full(0x3000, SYMBOLS, np.uint8)
    for i, chars in enumerate(_CLASSES):
        for c in chars:
            table[ord(c)] = table[ord(c.upper()) if len(c.upper()) == 1 else ord(c)] = 26 + i
    for i in range(26):
        table[97 + i] = table[65 + i] = i
    return table


_TABLE = _alphabet()


def symbols(text: str) -> np.ndarray:
    """The symbol of each character; a text starts after ORDER - 1 line ends."""
    points = np.frombuffer(("\n" * (ORDER - 1) + text).encode("utf-32-le"), np.uint32)
    s = _TABLE[np.minimum(points, len(_TABLE) - 1)].astype(np.int32)
    far = np.flatnonzero(s == SYMBOLS)
    s[far] = points[far] + SYMBOLS
    return s


def _numbers(columns: list[np.ndarray], base: int) -> np.ndarray:
    """N-grams as numbers, from the numbers of their symbols."""
    code = columns[0].astype(np.int32 if base**ORDER < 1 << 31 else np.int64)
    for c in columns[1:]:
        code = code * base + c
    return code


def split(text: str, others: np.ndarray = _NONE) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the n-grams at each character whose symbols are classes or among `others` (sorted),
    and the symbols of the remaining n-grams, a row for each."""
    s = symbols(text)
    n, new = len(s) - ORDER + 1, s >= SYMBOLS
    if not new.any():
        return _numbers([s[i : n + i] for i in range(ORDER)], SYMBOLS + len(others)), np.empty((0, ORDER), np.int32)
    number = s
    if len(others):
        at = np.minimum(np.searchsorted(others, s), len(others) - 1)
        known = others[at] == s
        number, new = np.where(known, SYMBOLS + at, s), new & ~known
    number = np.where(new, 0, number)
    gone = np.logical_or.reduce([new[i : n + i] for i in range(ORDER)])
    return _numbers([number[i : n + i][~gone] for i in range(ORDER)], SYMBOLS + len(others)), np.stack([s[i : n + i][gone] for i in range(ORDER)], 1)


def grams(text: str, others: np.ndarray = _NONE) -> np.ndarray:
    """The n-gram number at each character, but for n-grams with symbols that are not in `others`."""
    return split(text, others)[0]


def tallied(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of symbols, and how often each is there."""
    if not len(found):
        return found, np.empty(0, np.int64)
    pairs = [found[:, i].astype(np.int64) << 21 | found[:, i + 1] for i in (0, 2)]
    order = np.lexsort(pairs)
    new = np.flatnonzero(np.r_[True, np.logical_or.reduce([np.diff(p[order]) != 0 for p in pairs])])
    return found[order[new]], np.diff(np.r_[new, len(order)])


def count(docs: DataFrame) -> DataFrame:
    """GRAM, n over all texts: a task's counts are added up before they leave it."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**ORDER, np.int32)
        wide, far, held = 0, [], 0
        for batch in batches:
            for text in batch["text"].to_pylist():
                if text:
                    code, other = split(text)
                    for at in range(0, len(code), _STEP):
                        g, n = np.unique(code[at : at + _STEP], return_counts=True)
                        total[g] += n.astype(np.int32)
                    wide += len(code)
                    far.append(other)
                    held += len(other)
                if wide > 1 << 30:
                    yield from _emit(total)
                    total[:], wide = 0, 0
                if held > _STEP:
                    yield from _rows(*tallied(np.concatenate(far)))
                    far, held = [], 0
        yield from _emit(total)
        if held:
            yield from _rows(*tallied(np.concatenate(far)))

    ddl = ", ".join(f"{g} int" for g in GRAM) + ", n long"
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, ddl).groupBy(*GRAM).agg(F.sum("n").alias("n"))


def _emit(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(total)
    yield from _rows(np.stack([at // SYMBOLS**i % SYMBOLS for i in range(ORDER - 1, -1, -1)], 1).astype(np.int32), total[at])


def _rows(found: np.ndarray, n: np.ndarray, **first: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of GRAM and n, after constant columns."""
    for at in range(0, len(n), _STEP):
        part = slice(at, at + _STEP)
        columns = [pa.array(found[part, i]) for i in range(ORDER)] + [pa.array(n[part].astype(np.int64))]
        yield pa.record_batch([pa.array(np.full(len(columns[0]), x, np.int64)) for x in first.values()] + columns, names=[*first, *GRAM, "n"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Of counts 0, 1, 2, and 3 or more, from the numbers of n-grams counted one to four times."""
    if not (n1 and n2 and n3):
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * (n4 or n3) / n3]
    return np.clip(d, [0, 0.05, 0.1, 0.15], [0, 0.95, 1.9, 2.9])


class KneserNey:
    """Interpolated modified Kneser-Ney in sorted arrays. keys[k], counts[k]: n-gram numbers of order k + 1 and
    their counts (continuation counts below the highest order); own[k]: their discounted shares; contexts[k],
    back[k]: numbers of contexts and what the discounts leave to the shorter one; logs: of keys[-1]. others:
    symbols beyond the classes, sorted; the numbers are in base SYMBOLS and as many more."""

    far: DataFrame | None = None

    def __init__(self, gram: np.ndarray, n: np.ndarray, others: np.ndarray = _NONE):
        order = np.argsort(gram)
        self.others, self.base = others, SYMBOLS + len(others)
        self.keys, self.counts = [gram[order]], [n[order].astype(np.float64)]
        for k in range(ORDER - 1, 0, -1):
            # Distinct left neighbours of each shorter n-gram.
            keys, counts = np.unique(self.keys[0] % self.base**k, return_counts=True)
            self.keys.insert(0, keys)
            self.counts.insert(0, counts.astype(np.float64))
        self.own, self.contexts, self.back = [], [], []
        for keys, counts in zip(self.keys, self.counts, strict=True):
            d = discounts(*[int((counts == i).sum()) for i in (1, 2, 3, 4)])[np.minimum(counts, 3).astype(int)]
            contexts, at = np.unique(keys // self.base, return_inverse=True)
            total = np.bincount(at, counts, len(contexts))
            self.own.append((counts - d) / total[at])
            self.contexts.append(contexts)
            self.back.append(np.bincount(at, d, len(contexts)) / total)
        self.logs = np.log(self.share(self.keys[-1]))

    def share(self, code: np.ndarray, k: int = ORDER - 1) -> np.ndarray:
        """Probability of the last symbol of each n-gram of order k + 1, seen or not, given the others."""
        lower = self.share(code % self.base**k, k - 1) if k else 1 / self.base
        return _found(self.keys[k], self.own[k], code, 0.0) + _found(self.contexts[k], self.back[k], code // self.base, 1.0) * lower

    def log_shares(self, code: np.ndarray) -> np.ndarray:
        """Logarithms of share(): one search for an n-gram that was counted, one in each array for others."""
        logs = _found(self.keys[-1], self.logs, code, np.nan)
        new = np.isnan(logs)
        if new.any():
            logs[new] = np.log(self.share(code[new]))
        return logs

    def log_table(self) -> np.ndarray:
        """Log probability of each n-gram's last symbol given the others, base ** ORDER of them."""
        return self.log_shares(np.arange(self.base**ORDER, dtype=self.keys[-1].dtype))


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    """The value of each wanted number in the sorted keys, or the default."""
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


class Joined:
    """A model of any size: workers hold the n-grams of classes, `far` has GRAM and log of the others."""

    others = _NONE

    def __init__(self, keys: np.ndarray, logs: np.ndarray, far: DataFrame | None):
        order = np.argsort(keys)
        self.keys, self.logs, self.far = keys[order], logs[order], far

    def log_shares(self, code: np.ndarray) -> np.ndarray:
        return _found(self.keys, self.logs, code, np.nan)


def shares(table: DataFrame, base: int) -> DataFrame:
    """GRAM and log of each counted n-gram: KneserNey by joins. Sums are of whole numbers, so the order in
    which they are taken does not show."""
    levels = [table]
    for k in range(ORDER - 1, 0, -1):
        levels.insert(0, materialize(levels[0].groupBy(*GRAM[-k:]).agg(F.count("*").alias("n"))))
    lower, n = None, F.col("n")
    for k, level in enumerate(levels, 1):
        d = discounts(*level.agg(*[F.count_if(n == i) for i in (1, 2, 3, 4)]).first()).tolist()
        cut = F.when(n == 1, d[1]).when(n == 2, d[2]).otherwise(d[3])
        context = GRAM[-k:-1]
        kinds = (F.count_if(n == 1), F.count_if(n == 2), F.count_if(n > 2))
        left = sum((c * x for c, x in zip(kinds, d[1:], strict=True)), F.lit(0.0))
        sums = materialize(level.groupBy(*context).agg(F.sum("n").alias("total"), (left / F.sum("n")).alias("back")))
        both = level.join(sums, context) if context else level.crossJoin(F.broadcast(sums))
        both = both.withColumn("lower", F.lit(1 / base)) if lower is None else both.join(lower, GRAM[1 - k :])
        lower = materialize(both.select(*GRAM[-k:], ((n - cut) / F.col("total") + F.col("back") * F.col("lower")).alias("lower")))
    return lower.select(*GRAM, F.log("lower").alias("log"))


def _near() -> Column:
    return F.greatest(*GRAM) < SYMBOLS


def _held(table: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in base SYMBOLS, and values, of the n-grams of classes: at most SYMBOLS ** ORDER."""
    number = reduce(lambda code, g: code * SYMBOLS + F.col(g), GRAM[1:], F.col(GRAM[0]))
    found = table.filter(_near()).select(number.alias("gram"), value).toArrow()
    return found["gram"].to_numpy(), found[value].to_numpy()


def fit(docs: DataFrame, held: int = HELD) -> KneserNey | Joined:
    """The driver receives at most `held` n-grams, or those of classes, and the symbols beyond the classes,
    which Unicode bounds."""
    table = materialize(count(docs))
    # Every character ends an n-gram.
    others = np.sort(table.filter(F.col(GRAM[-1]) >= SYMBOLS).select(GRAM[-1]).distinct().toArrow()[GRAM[-1]].to_numpy())
    base = SYMBOLS + len(others)
    if not len(others):
        return KneserNey(*_held(table, "n"))
    if base**ORDER < 1 << 63 and table.count() <= held:
        found = table.toArrow()
        columns = [found[g].to_numpy() for g in GRAM]
        return KneserNey(_numbers([np.where(c < SYMBOLS, c, SYMBOLS + np.searchsorted(others, c)) for c in columns], base), found["n"].to_numpy(), others)
    logs = shares(table, base)
    return Joined(*_held(logs, "log"), materialize(logs.filter(~_near())))


def counts_of(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = sum(map(len, words)) if text.isascii() else len(text.decode()) - sum(text.count(c.encode()) for c in _BLANK)
    signs = sum(text.count(c.encode()) for c in _SIGNS)
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    repeat = 0
    if len(words) > 3:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        if len(number) < 2_000_000:
            code = (ids[:-2] * len(number) + ids[1:-1]) * len(number) + ids[2:]
        else:  # three words no longer fit one number
            pair = np.unique(ids[:-2] * len(number) + ids[1:-1], return_inverse=True)[1]
            code = pair * len(number) + ids[2:]
        order = np.argsort(code, kind="stable")
        same = np.flatnonzero(code[order][1:] == code[order][:-1])
        if len(same):
            twice = np.zeros(len(code), bool)
            twice[order[same]] = twice[order[same + 1]] = True
            covered = np.zeros(len(words), bool)
            for i in range(3):
                covered[i : len(code) + i] |= twice
            repeat = int(covered.sum())
    return len(words), chars, signs, dup, repeat


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, model: KneserNey | Joined) -> DataFrame:
    """docs(doc_id, text, ...) without text, with the counts and log_perplexity (per character; null for empty
    texts)."""
    far = model.far
    rows = docs if far is None else keyed(docs, *docs.columns)
    held = model if far is None else Joined(model.keys, model.logs, None)
    shared = docs.sparkSession.sparkContext.broadcast(held)
    kept = [f for f in rows.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for text in batch["text"].to_pylist():
                text = text or ""
                for column, value in zip(columns, counts_of(text.encode()), strict=False):
                    column.append(value)
                columns[5].append(len(text))
                columns[6].append(float(model.log_shares(np.sort(grams(text, model.others))).sum()))  # sorted: neighbours are found in cache
            made = [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch[f.name] for f in kept] + made, [*[f.name for f in kept], *_FIELDS, "__chars", "__near"])

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} long" for n in (*_FIELDS, "__chars")] + ["__near double"])
    out, logs = rows.mapInArrow(run, ddl), F.col("__near")
    if far is not None:
        out, logs = out.join(lookup(far_sums(rows, far)), "rid", "left").drop("rid"), logs + F.coalesce("__far", F.lit(0.0))
    return out.withColumn("log_perplexity", F.when(F.col("__chars") > 0, -logs / F.col("__chars"))).drop("__chars", "__near", "__far")


def far_sums(rows: DataFrame, far: DataFrame) -> DataFrame:
    """rid and the sum of logs over the n-grams of rows(rid, text) that are not held. Only these n-grams move;
    sums are of decimals, so the order in which they are taken does not show."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, text in zip(batch["rid"].to_pylist(), batch["text"].to_pylist(), strict=True):
                yield from _rows(*tallied(split(text or "")[1]), rid=rid)

    each = rows.select("rid", "text").mapInArrow(run, "rid long, " + ", ".join(f"{g} int" for g in GRAM) + ", n long")
    log = (F.col("n") * F.col("log")).cast("decimal(28,12)")
    return each.join(far, GRAM).groupBy("rid").agg(F.sum(log).cast("double").alias("__far"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def quartiles(rows: DataFrame) -> DataFrame:
    """__lang and q (an array of the three) over rows(lang, log_perplexity): values of rank ceil(n * i / 4).

    A sketch only narrows the search: what lies below its bounds is counted, and what lies between them is
    counted by value. The bounds are MARGIN sketch errors to either side of a rank."""
    step, x = MARGIN / SKETCH, F.col("log_perplexity")
    ends = [F.lit(i / 4 + d) for i in (1, 2, 3) for d in (-step, step)]
    sketch = rows.groupBy("lang").agg(F.count(x).alias("n"), F.percentile_approx(x, F.array(*ends), F.lit(SKETCH)).alias("e"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.ceil(F.col("n") * i / 4).alias("k"), F.col("e")[2 * i - 2].alias("lo"), F.col("e")[2 * i - 1].alias("hi")) for i in (1, 2, 3)]))
    wanted = lookup(sketch.select(F.col("lang").alias("__lang"), each.alias("w")).select("__lang", "w.*"))
    near = rows.select("lang", x).join(wanted, F.col("lang").eqNullSafe(F.col("__lang")) & (x <= F.col("hi")))
    counted = near.groupBy("__lang", "i", "k", F.when(x >= F.col("lo"), x).alias("x")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("__lang", "i").orderBy(F.col("x").asc_nulls_first()))
    # The first value that reaches the rank; none, or what lies below the bounds, would be a wrong sketch.
    least = F.min(F.when(F.col("upto") >= F.col("k"), F.struct(F.coalesce("x", F.lit(float("-inf"))).alias("x"))))["x"]
    found = counted.withColumn("upto", upto).groupBy("__lang", "i").agg(least.alias("x"))
    sure = F.when(F.col("x") > float("-inf"), F.col("x")).otherwise(F.raise_error(F.lit("a quartile lies outside its bounds")))
    return found.groupBy("__lang").agg(F.array_sort(F.collect_list(F.struct("i", sure.alias("x")))).alias("q")).select("__lang", F.col("q.x").alias("q"))


def bands(rows: DataFrame) -> DataFrame:
    """lang, middle and quartile distance over rows that pass the counting rules."""
    found = quartiles(rows.filter(~base_failed()))
    return found.select("__lang", F.col("q")[1].alias("middle"), F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(FLOOR)).alias("unit"))


def verdicts(rows: DataFrame) -> DataFrame:
    """rows, written, with base_failed and kept."""
    rows = materialize(rows)
    out = rows.join(lookup(bands(rows)), F.col("lang").eqNullSafe(F.col("__lang")), "left")
    inside = F.abs(F.col("log_perplexity") - F.col("middle")) <= F.col("unit") * (WIDTH + SPREAD / F.sqrt("n_words"))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & F.coalesce(inside, F.lit(True))).drop("__lang", "middle", "unit")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and log_perplexity of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    out = verdicts(measured(rows, fit(rows)))
    return out.select("doc_id", *_FIELDS, "base_failed", "kept", F.round("log_perplexity", 6).alias("log_perplexity"))


def apply(docs: DataFrame) -> DataFrame:
    """docs, all columns, without the rejected rows."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.struct(*[F.col(c) for c in docs.columns]).alias("__row"))
    kept = verdicts(measured(own, fit(own))).filter("kept")
    return kept.select("__row.*")
