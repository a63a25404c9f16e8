"""Exact substring dedup by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if a string of SPAN bytes that covers it starts at two places of the corpus or more. A
start x is repeated exactly if, in the sorted order of all suffixes, x shares SPAN bytes with a
neighbour. Sorting every suffix is out of the question, so, as in sorters that first approximate
distinguishing prefixes by hashing, hash counts settle the suffixes they can settle:

* Every start x belongs to an anchor: the place of the least k-gram hash in the WIDTH places from x.
  Equal windows have equal anchors at equal offsets, so starts can be compared anchor by anchor.
* `inner` is the part of an anchor's windows that all its starts share. If no other anchor has the
  same inner part, no start of the anchor is repeated: its suffixes are told apart early.
* `outer` is all that its windows cover. If another anchor has the same, every start is repeated.
* Anchors that neither test settles are cut into runs of starts of WIDTHS[1], then WIDTHS[2], with
  the same two tests; these are places where a copied passage begins or ends.

What is left are single starts near passage ends. Their suffixes are sorted within tasks,
dealt out by sampled splitters as front-coded sorted runs (common prefix with the suffix before, rest),
and merged by loser trees whose nodes keep the prefix that a loser shares with its winner, so known
prefixes are never compared again. Neighbours that share SPAN bytes are repeats.

Exact copies of a text are settled first by a hash of the whole text: with SPAN bytes or more, all
of it goes; one of them stands for all in the tests above.

Nulls are empty texts; repeated rows and repeated or null ids are separate documents; an empty table
gives no rows; other columns are ignored. Texts of any length are hashed in blocks; of a periodic stretch
only the first period's starts go through the tests. Of equal texts the one of least row key stands for the
others in the tests, and all of them go.

SPAN bytes miss repeated passages of many short words, so the same search also runs over words: a start is
then a word, a string is WORDS words whatever blanks part them, and n_passage_words counts the words covered
by those that start anywhere else too, same document included. No byte is removed for it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import blob, joined_ranges, keyed, lookup, materialize

SPAN = 400
GRAM = 24
#: Starts an anchor may have, then the runs that open anchors and runs are cut into.
WIDTHS = (256, 32, 4)
#: Words of a repeated passage, with the gram and the widths of its anchors and runs in words; bytes of a word that stands for itself.
WORDS, WORD_GRAM, WORD_WIDTHS, LONG = 50, 16, (32, 4), 48
_MIX = np.uint64(0x9E3779B97F4A7C15)


#: Least and most bits of the filter of hashes seen twice.
FILTER_BITS = (1 << 20, 1 << 29)
#: Starts that are hashed at once; rows of an Arrow batch; the longest period that is looked for.
BLOCK, ROWS, PERIOD = 1 << 19, 20_000, 64
#: Starts that a part of the sort is planned for, the most parts, and bytes of suffixes sorted at once.
PART, PARTS, SORTED = 20_000, 16_384, 16 << 20
_ROW = "rid long, at int, lo int, hi int, inner long, outer binary"
_KEYS = pa.schema([("rid", pa.int64()), ("at", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("inner", pa.int64()), ("outer", pa.binary())])


class Words:
    """Texts as one sequence of their words: a slice is their bytes, each word ended by one space; `first`
    has the place of each text's first word, and the end.

    So slices of equally many words are equal, or neither begins the other. A word of more than LONG bytes
    is replaced by its 128-bit hash, in a form that no other word has, so a slice stays small."""

    def __init__(self, *texts: bytes):
        parts = [b" ".join([*t.split(), b""]) for t in texts]
        self.first = np.cumsum([0, *(p.count(b" ") for p in parts)])
        self._place(parts)
        long = np.flatnonzero(np.diff(self.places) > LONG + 1)
        for i in np.unique(np.searchsorted(self.first, long, "right") - 1).tolist():
            words = [w if len(w) <= LONG else xxh3_128_digest(w).hex().encode().rjust(LONG + 1, b"\0") for w in parts[i].split()]
            parts[i] = b" ".join([*words, b""])
        if len(long):
            self._place(parts)

    def _place(self, parts: list[bytes]) -> None:
        self.text = b"".join(parts)
        self.places = np.r_[0, np.flatnonzero(np.frombuffer(self.text, np.uint8) == 32) + 1]

    def __len__(self) -> int:
        return len(self.places) - 1

    def __getitem__(self, part: slice) -> bytes:
        return self.text[self.places[part.start] : self.places[min(part.stop, len(self))]]

    def codes(self) -> np.ndarray:
        """A number for each word, of its length and first 8 bytes: equal words have equal ones."""
        n = np.diff(self.places) - 1
        head = np.ndarray(len(self.text), "<u8", self.text + bytes(7), strides=(1,))[self.places[:-1]]
        mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        return (head & mask[np.minimum(n, 8)]) * _MIX + n.astype(np.uint64)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the gram bytes at each place: doubling, as 24 = 8 + 16."""
    with np.errstate(over="ignore"):
        h, have = data.astype(np.uint64) + np.uint64(1), 1
        eight = None
        while have < gram - 8:
            h = h[:-have] * (_MIX + np.uint64(2 * have)) + h[have:]
            h ^= h >> np.uint64(29)
            have *= 2
            if have == 8:
                eight = h
        h = h[:-8] * _MIX + eight[have : have + len(h) - 8]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, span: int = SPAN, width: int = WIDTHS[0], gram: int = GRAM, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) over the starts 0..n - span, in order.

    The least hash wins, the first of equals; equal windows hold the same hashes, so they agree. Starts
    are taken in blocks, so what is held beside the text does not grow with it."""
    starts = len(data) - span + 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low = np.uint64((1 << 34) - 1)
    for base in range(0, starts, block):
        n = min(block, starts - base)
        # Hash and place in one word: the order is by hash, then by place.
        h = gram_hashes(data[base : base + n + width + gram - 2], gram)
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        have = 1
        while have < width:
            step = min(have, width - have)
            m = np.minimum(m[:-step], m[step:])
            have += step
        at = (m[:n] & low).astype(np.int64) + base
        cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        at, lo, hi = at[cut], cut + base, np.r_[cut[1:], n] - 1 + base
        if found and found[-1][0][-1] == at[0]:  # the anchor goes on from the block before
            found[-1][2][-1] = hi[0]
            at, lo, hi = at[1:], lo[1:], hi[1:]
        if len(at):
            found.append((at, lo, hi))
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _joined(ranges: np.ndarray) -> np.ndarray:
    """Sorted, disjoint ranges (first, last) that cover the same numbers."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.flatnonzero(np.r_[True, ranges[1:, 0] > reach[:-1] + 1])
    return np.c_[ranges[new, 0], reach[np.r_[new[1:], len(ranges)] - 1]]


def even_gaps(at: np.ndarray) -> np.ndarray:
    """Whether an anchor and the three after it lie at equal distances of PERIOD at most."""
    gap = np.diff(at)
    return (gap[2:] == gap[1:-1]) & (gap[1:-1] == gap[:-2]) & (gap[:-2] <= PERIOD)


def without_periods(data: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], span: int = SPAN, text: bytes | Words | None = None) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Anchors less those of periodic stretches, and the ranges of starts settled by that.

    In a stretch of period p a start equals the one p places on, so all of them are repeated, and its
    first p starts stand for the others as partners. A text of one letter thus has an anchor or two, not
    one at each place. Periods show as equal gaps between anchors; longer ones have few anchors anyway.
    Where equal numbers in `data` may stand for different words, `text` decides."""
    at, lo, hi = found
    gap = np.diff(at)
    same = even_gaps(at)
    sure, gone = [], []
    for p in np.unique(gap[:-2][same]).tolist():
        ends = np.flatnonzero(np.diff(np.r_[False, data[:-p] == data[p:], False].astype(np.int8))).reshape(-1, 2)
        ends = ends[ends[:, 1] - ends[:, 0] >= span]
        if text is not None:
            ends = ends[[text[a:b] == text[a + p : b + p] for a, b in ends.tolist()]] if len(ends) else ends
        sure.append(np.c_[ends[:, 0], ends[:, 1] - span + p])
        gone.append(np.c_[ends[:, 0] + p, ends[:, 1] - span + p])
    if not sure or not sum(map(len, sure)):
        return found, np.empty((0, 2), np.int64)
    out = _joined(np.concatenate(gone))
    inside = lambda x: (i := np.searchsorted(out[:, 0], x, "right") - 1, (i >= 0) & (x <= out[i, 1]))
    (i, left), (j, right) = inside(lo), inside(hi)
    lo, hi = np.where(left, out[i, 1] + 1, lo), np.where(right, out[j, 0] - 1, hi)
    keep = lo <= hi
    return (at[keep], lo[keep], hi[keep]), _joined(np.concatenate(sure))


def _outer(data: bytes | Words, first: int, last: int, span: int, seed: int) -> bytes | None:
    """Hash of all that the windows of the starts first..last cover; null where the text ends before,
    since only a whole string speaks for every start of the run."""
    whole = first >= 0 and last + span <= len(data)
    return xxh3_128_digest(data[first : last + span], seed) if whole else None


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def word_anchors(texts: list[bytes], span: int) -> tuple[Words, tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """The words of a batch of texts, (text, anchor, first start, last start) and (text, first, last) of the starts
    that periods settle; places count from the batch's first word. One pass takes all texts, since most are short."""
    words = Words(*texts)
    data, first = words.codes(), words.first
    at, lo, hi = anchors(data, span, WORD_WIDTHS[0], WORD_GRAM)
    # A start with all its words in one text has its anchor there too; other starts go.
    own = np.searchsorted(first, at, "right") - 1
    lo, hi = np.maximum(lo, first[own]), np.minimum(hi, first[own + 1] - span)
    own, at, lo, hi = (c[lo <= hi] for c in (own, at, lo, hi))
    kept, sure = np.ones(len(at), bool), [np.empty((0, 3), np.int64)]
    more = [np.empty((0, 4), np.int64)]
    for i in np.unique(own[: max(0, len(own) - 3)][even_gaps(at)]).tolist():
        (a, b), start = np.searchsorted(own, [i, i + 1]), first[i]
        left, settled = without_periods(data[start : first[i + 1]], (at[a:b] - start, lo[a:b] - start, hi[a:b] - start), span, Words(texts[i]))
        if len(settled):
            kept[a:b] = False
            more.append(np.c_[np.full(len(left[0]), i), np.stack(left, 1) + start])
            sure.append(np.c_[np.full(len(settled), i), settled + start])
    rows = np.concatenate([np.c_[own, at, lo, hi][kept], *more])
    return words, tuple(rows.T), tuple(np.concatenate(sure).T)


def anchor_rows(texts: DataFrame, span: int = SPAN, seen_twice: np.ndarray | None = None, words: bool = False) -> DataFrame:
    """Anchors of texts(rid, text). Without `seen_twice` only their inner hashes; with it, rid, at, lo,
    hi, inner and outer of those whose inner hash may have been seen twice, and rows without hashes for
    the starts that periods settle. Batches end after ROWS rows, whatever a text holds."""
    width, gram = (WORD_WIDTHS[0], WORD_GRAM) if words else (WIDTHS[0], GRAM)
    if width + gram > span:
        raise ValueError(f"a span has {width + gram} {'words' if words else 'bytes'} at least")
    shared = seen_twice is not None and texts.sparkSession.sparkContext.broadcast(seen_twice)
    hashes = pa.schema([("inner", pa.int64())])

    def of(row: int, text: bytes, bits: np.ndarray | None) -> Iterator[list]:
        data = np.frombuffer(text, np.uint8)
        (at, lo, hi), sure = without_periods(data, anchors(data, span), span)
        cut = span - width + 1
        if bits is not None and len(sure):
            none = [None] * len(sure)
            yield [np.full(len(sure), row), np.full(len(sure), -1), sure[:, 0], sure[:, 1], none, none]
        for i in range(0, len(at), ROWS):
            a, part = at[i : i + ROWS], slice(i, i + ROWS)
            inner = np.array([xxh3_64_intdigest(text[x : x + cut]) for x in a.tolist()], np.uint64).view(np.int64)
            if bits is None:
                yield [inner]
                continue
            place = inner & (8 * len(bits) - 1)
            keep = np.flatnonzero(bits[place >> 3] >> (place & 7) & 1)
            outer = [_outer(text, x - width + 1, x, span, 0) for x in a[keep].tolist()]
            yield [np.full(len(keep), row), a[keep], lo[part][keep], hi[part][keep], inner[keep], outer]

    def of_words(rids: np.ndarray, texts: list[bytes], bits: np.ndarray | None) -> Iterator[list]:
        batch, (own, at, lo, hi), (alone, a, b) = word_anchors(texts, span)
        text, places, first = batch.text, batch.places, batch.first
        if bits is not None and len(alone):
            none = [None] * len(alone)
            yield [rids[alone], np.full(len(alone), -1), a - first[alone], b - first[alone], none, none]
        for i in range(0, len(at), ROWS):
            mine, x, low, high = (c[i : i + ROWS] for c in (own, at, lo, hi))
            inner = [xxh3_64_intdigest(text[p:q]) for p, q in zip(places[x].tolist(), places[x + span - width + 1].tolist(), strict=True)]
            inner = np.array(inner, np.uint64).view(np.int64)
            if bits is None:
                yield [inner]
                continue
            place = inner & (8 * len(bits) - 1)
            keep = np.flatnonzero(bits[place >> 3] >> (place & 7) & 1)
            mine, x, low, high = (c[keep] for c in (mine, x, low, high))
            whole = (x - width + 1 >= first[mine]) & (x + span <= first[mine + 1])
            outer = [xxh3_128_digest(batch[p : p + span + width - 1]) if w else None for p, w in zip((x - width + 1).tolist(), whole.tolist(), strict=True)]
            yield [rids[mine], *(c - first[mine] for c in (x, low, high)), inner[keep], outer]

    def columns_of(batch: pa.RecordBatch, bits: np.ndarray | None) -> Iterator[list]:
        texts = blob(batch["text"])
        if words:
            yield from of_words(batch["rid"].to_numpy(), texts, bits)
            return
        for row, text in zip(batch["rid"].to_pylist(), texts, strict=True):
            yield from of(row, text, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _KEYS if shared else hashes
        for batch in batches:
            held, n = [], 0
            for columns in columns_of(batch, shared.value if shared else None):
                held.append([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)])
                n += len(columns[0])
                if n >= ROWS:
                    yield pa.record_batch([pa.concat_arrays(c) for c in zip(*held, strict=True)], schema=schema)
                    held, n = [], 0
            if n:
                yield pa.record_batch([pa.concat_arrays(c) for c in zip(*held, strict=True)], schema=schema)

    return texts.mapInArrow(run, _ROW if shared else "inner long")


def repeat_filter(hashes: DataFrame) -> np.ndarray:
    """A bitmap with the places of hashes seen twice or more: 16 places for each of them, within the
    bounds of FILTER_BITS. A corpus that fills the largest lets more through, and the exact join behind
    it decides."""
    twice = materialize(hashes.groupBy("inner").agg(F.count("*").alias("n")).filter("n > 1").select("inner"))
    least, most = FILTER_BITS
    bits = min(most, max(least, 1 << (16 * twice.count()).bit_length()))
    place = F.col("inner").bitwiseAND(F.lit(bits - 1))
    bucket = F.shiftright(place, 15).alias("bucket")
    maps = twice.groupBy(bucket).agg(F.bitmap_construct_agg(place % 32768).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in maps.toLocalIterator():  # at most bits / 32768 rows of 4 KB
        own = np.frombuffer(r["bits"], np.uint8)
        out[r["bucket"] * 4096 : r["bucket"] * 4096 + len(own)] = own
    return out


def settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeated, open) among rows with inner and outer.

    Of rows with the same outer string one goes on with the open ones that share its inner string:
    it stands for all of them as a partner. Counts combine before the shuffle, so a passage that a
    third of all rows hold is one row a task."""
    written = materialize(rows)
    periodic = written.filter("inner is null").select("rid", "lo", "hi")
    rows = written.filter("inner is not null")
    inner = rows.groupBy("inner").agg(F.count("*").alias("n")).filter("n > 1").select("inner")
    outer = rows.filter("outer is not null").groupBy("outer").agg(F.count("*").alias("n")).filter("n > 1").select("outer", F.lit(True).alias("all"))
    judged = materialize(rows.join(materialize(inner), "inner", "left_semi").join(materialize(outer), "outer", "left").withColumn("all", F.coalesce("all", F.lit(False))))
    left = judged.filter("not all")
    wanted = left.select("inner").distinct()
    partners = judged.filter("all").join(materialize(wanted), "inner", "left_semi")
    own = ["rid", "at", "lo", "hi"]
    one = partners.groupBy("outer").agg(F.min(F.struct(*own)).alias("o")).select("o.*")
    return judged.filter("all").select("rid", "lo", "hi").unionByName(periodic), left.select(*own).unionByName(one)


def placed(texts: DataFrame, open_rows: DataFrame) -> DataFrame:
    """Texts that have open places, with them."""
    places = open_rows.groupBy("rid").agg(F.collect_list(F.struct("at", "lo", "hi")).alias("open"))
    return texts.join(places, "rid")


def run_rows(texts: DataFrame, open_rows: DataFrame, width: int, span: int = SPAN, words: bool = False) -> DataFrame:
    """Cut the starts lo..hi into runs that lie at fixed distances before the anchor `at`.

    The distance seeds the hashes: a place that two anchors reach is not taken for its own copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _KEYS]
            for rid, text, places in zip(batch["rid"].to_pylist(), blob(batch["text"]), batch["open"], strict=True):
                text = Words(text) if words else text
                for p in places:
                    at, lo, hi = (p[k].as_py() for k in ("at", "lo", "hi"))
                    for j in range((at - hi) // width, (at - lo) // width + 1):
                        last = at - j * width
                        first = last - width + 1
                        inner = xxh3_64_intdigest(text[last : first + span], 1 + j)
                        row = (rid, at, max(lo, first), min(hi, last), inner - (inner >> 63 << 64), _outer(text, first, last, span, 1 + j))
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                    if len(out[0]) >= ROWS:
                        yield _batch(out, _KEYS)
                        out = [[] for _ in _KEYS]
            yield _batch(out, _KEYS)

    return placed(texts, open_rows).select("rid", "text", "open").mapInArrow(run, _ROW)


# --- the sort -----------------------------------------------------------------------------------


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, given that the first `known` bytes agree."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step = 16
    while a[known : known + step] == b[known : known + step]:
        known += step
        step *= 2
    while step > 1:
        step //= 2
        if a[known : known + step] == b[known : known + step]:
            known += step
    return known


def front_coded(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """For sorted suffixes: the prefix shared with the one before, and the rest."""
    shared, rest, before = [], [], b""
    for s in suffixes:
        n = common(before, s)
        shared.append(n)
        rest.append(s[n:])
        before = s
    return shared, rest


class Run:
    """Reads a front-coded run: `text` is the head and `shared` its prefix in common with the last winner."""

    def __init__(self, items: Iterator[tuple[int, bytes, tuple]]):
        self.items, self.text, self.shared, self.tag = items, b"", 0, None
        self.live = True
        self.pull()

    def pull(self) -> None:
        item = next(self.items, None)
        if item is None:
            self.live, self.text, self.shared = False, None, -1
        else:
            self.shared, self.tag = item[0], item[2]
            self.text = self.text[: self.shared] + item[1]


def merged(runs: list[Run]) -> Iterator[tuple[int, bytes, tuple]]:
    """Loser tree over runs: yields (prefix shared with the item before, text, tag) in order.

    Each head knows the prefix it shares with the last winner that passed its node. Of two heads the
    one that shares more is the smaller; only on a tie are bytes compared, from the shared place on."""
    size = 1
    while size < len(runs):
        size *= 2
    empty = Run(iter(()))
    heads = runs + [empty] * (size - len(runs))

    def beats(a: Run, b: Run) -> tuple[Run, Run]:
        """(winner, loser); the loser's shared prefix is then the one it has with the winner."""
        if not (a.live and b.live):
            return (a, b) if a.live else (b, a)
        if a.shared != b.shared:
            return (a, b) if a.shared > b.shared else (b, a)
        n = common(a.text, b.text, a.shared)
        if a.text[n:] <= b.text[n:]:
            b.shared = n
            return a, b
        a.shared = n
        return b, a

    # At first nothing is known: all heads share 0 bytes with an imaginary empty winner.
    for head in heads:
        if head.live:
            head.shared = 0
    level, losers = list(heads), [empty] * size
    nodes = list(range(size, 2 * size))
    while len(level) > 1:
        up = []
        for i in range(0, len(level), 2):
            winner, loser = beats(level[i], level[i + 1])
            losers[nodes[i] // 2] = loser
            up.append(winner)
        level, nodes = up, [n // 2 for n in nodes[::2]]
    where = {id(h): size + i for i, h in enumerate(heads) if h is not empty}
    winner = level[0]
    while winner.live:
        yield winner.shared, winner.text, winner.tag
        node = where[id(winner)] // 2
        winner.pull()
        while node:
            winner, losers[node] = beats(winner, losers[node])
            node //= 2


_RUN = pa.schema([("part", pa.int32()), ("shared", pa.list_(pa.int32())), ("rest", pa.list_(pa.binary())), ("rid", pa.list_(pa.int64())), ("x", pa.list_(pa.int32())), ("sure", pa.bool_())])


def suffixes(texts: DataFrame, open_rows: DataFrame, span: int = SPAN, words: bool = False) -> DataFrame:
    """rid, x, suffix (its first span bytes or words) of every open start, in batches of bounded size."""
    schema = pa.schema([("rid", pa.int64()), ("x", pa.int32()), ("suffix", pa.binary())])
    size = span * (LONG + 2) if words else span

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, (4 << 20) // size)
        for batch in batches:
            for rid, text, places in zip(batch["rid"].to_pylist(), blob(batch["text"]), batch["open"], strict=True):
                text, own = Words(text) if words else text, places.values
                lo, hi = own.field("lo").to_numpy(), own.field("hi").to_numpy()
                for first, last in _joined(np.c_[lo, hi].astype(np.int64)).tolist():
                    for a in range(first, last + 1, most):
                        x = range(a, min(last + 1, a + most))
                        yield pa.record_batch([pa.array([rid] * len(x), pa.int64()), pa.array(x, pa.int32()), pa.array([text[i : i + span] for i in x], pa.binary())], schema=schema)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += len(batch)
            if n * size >= 4 << 20:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return placed(texts, open_rows).select("rid", "text", "open").mapInArrow(gathered, "rid long, x int, suffix binary")


def splitters_of(starts: DataFrame, parts: int) -> list[bytes]:
    """parts - 1 keys that deal the suffixes out evenly, from a sample of 8 for each part, those of least
    hash. A key is cut after the byte that tells it from the sample before it."""
    picked = starts.select("suffix", F.xxhash64("rid", "x").alias("h")).orderBy("h").limit(8 * parts).select("suffix")
    sample = sorted({bytes(r[0]) for r in picked.toLocalIterator()})
    at = sorted({i * len(sample) // parts for i in range(1, parts)} - {0})
    return [sample[i][: common(sample[i - 1], sample[i]) + 1] for i in at]


def sorted_neighbours(starts: DataFrame, span: int | None = SPAN, parts: int | None = None) -> DataFrame:
    """starts(rid, x, suffix) -> (rid, x) of those whose suffix shares span bytes with a neighbour; without
    span, all of it.

    Map side: each task sorts SORTED bytes of suffixes at a time and emits a front-coded run for each
    part. Reduce side: a part merges its runs, read bit by bit out of Arrow buffers. Equal suffixes always
    fall in one part's key range, so neighbours that matter never straddle parts. Parts follow the
    number of starts, so that one of them stays small."""
    spark = starts.sparkSession
    starts = materialize(starts)
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(PARTS, -(-starts.count() // PART)))
    splitters = splitters_of(starts, parts)

    def coded(rows: list[tuple[bytes, int, int]]) -> Iterator[pa.RecordBatch]:
        rows.sort()
        cuts = [bisect_left(rows, (s,)) for s in splitters]
        out: list[list] = [[] for _ in _RUN]
        held = 0
        for part, (start, end) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
            if start == end:
                continue
            shared, rest = front_coded([r[0] for r in rows[start:end]])
            # Equal suffixes of one run are repeats already; the first of them goes on for all.
            same = [i for i in range(1, len(shared)) if shared[i] >= (span or len(rows[start + i][0]))]
            known = sorted({*same, *(i - 1 for i in same)})
            go = sorted(set(range(len(shared))) - set(same))
            tags = [[[rows[start + i][k] for i in at] for at in (go, known)] for k in (1, 2)]
            made = [(part, [shared[i] for i in go], [rest[i] for i in go], tags[0][0], tags[1][0], False)]
            made += [(rows[start][2] % parts, [], [], tags[0][1], tags[1][1], True)] if known else []
            for row in made:
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            held += sum(map(len, rest))
            if held > 2 << 20:
                yield _batch(out, _RUN)
                out, held = [[] for _ in _RUN], 0
        if out[0]:
            yield _batch(out, _RUN)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bytes, int, int]] = []
        held = 0
        for batch in batches:
            rows += zip(*(batch[k].to_pylist() for k in ("suffix", "rid", "x")), strict=True)
            held += batch["suffix"].nbytes
            if held >= SORTED:
                yield from coded(rows)
                rows, held = [], 0
        if rows:
            yield from coded(rows)

    exchanged = starts.select("rid", "x", "suffix").mapInArrow(runs, "part int, shared array<int>, rest array<binary>, rid array<long>, x array<int>, sure boolean")
    out = pa.schema([("rid", pa.int64()), ("x", pa.int32())])

    def items(batch: pa.RecordBatch, i: int) -> Iterator[tuple[int, bytes, tuple]]:
        columns = [batch[k][i].values for k in ("shared", "rest", "rid", "x")]
        for at in range(0, len(columns[0]), 64):
            for shared, rest, rid, x in zip(*(c.slice(at, 64).to_pylist() for c in columns), strict=True):
                yield shared, rest, (rid, x)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[Iterator]] = {}
        for batch in batches:
            for i, (part, sure) in enumerate(zip(batch["part"].to_pylist(), batch["sure"].to_pylist(), strict=True)):
                if sure:
                    yield pa.record_batch([batch["rid"][i].values, batch["x"][i].values], schema=out)
                else:
                    by_part.setdefault(part, []).append(items(batch, i))
        for found in by_part.values():
            rid, x, before, said = [], [], None, True
            for shared, text, tag in merged([Run(r) for r in found]):
                if before is not None and shared >= (span or len(text)):
                    for t in ([] if said else [before]) + [tag]:
                        rid.append(t[0])
                        x.append(t[1])
                    said = True
                else:
                    said = False
                before = tag
                if len(rid) >= ROWS:
                    yield _batch([rid, x], out)
                    rid, x = [], []
            yield _batch([rid, x], out)

    return exchanged.repartition(parts, "part").mapInArrow(merge, "rid long, x int")


# --- the operator -------------------------------------------------------------------------------


def repeated_starts(texts: DataFrame, span: int = SPAN, words: bool = False) -> DataFrame:
    """(rid, lo, hi): ranges of starts whose span bytes, or words, start elsewhere too, for texts(rid, text)."""
    sure, rows = settle(anchor_rows(texts, span, repeat_filter(anchor_rows(texts, span, None, words)), words))
    # Only texts with open places are read again; they are written once, without the others.
    rows = materialize(rows)
    texts = materialize(texts.join(lookup(rows.select("rid").distinct()), "rid", "left_semi"))
    for width in (WORD_WIDTHS if words else WIDTHS)[1:]:
        more, rows = settle(run_rows(texts, rows, width, span, words))
        sure = sure.unionByName(more)
    last = sorted_neighbours(suffixes(texts, rows, span, words), None if words else span)
    return sure.unionByName(last.select("rid", F.col("x").alias("lo"), F.col("x").alias("hi")))


def cutter(span: int, with_text: bool):
    """Arrow function: text, repeated start ranges and words in passages -> n_bytes, n_removed, n_spans,
    kept_sha256, n_passage_words (and kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passage_words", pa.int64())] + [("kept", pa.binary())] * with_text)
        for batch in batches:
            rows = []
            for doc, text, whole, ranges, n in zip(batch["doc_id"].to_pylist(), blob(batch["text"]), *(batch[k].to_pylist() for k in ("whole", "ranges", "passages")), strict=True):
                spans = [[0, len(text)]] if whole and len(text) >= span else []
                if whole:
                    n = len(text.split())
                    n = n if n >= WORDS else 0
                for r in sorted((r["lo"], r["hi"] + span) for r in ranges or ()):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append([*r])
                at, kept = 0, []
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                left = b"".join([*kept, text[at:]])
                rows.append((doc, len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), n, left)[: len(schema)])
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    return run


def remove_repeats(docs: DataFrame, span: int = SPAN, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words (and the kept bytes) of each row."""
    rows = keyed(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    long = rows.filter(F.octet_length(text) >= min(span, 2 * WORDS - 1))
    hashed = materialize(long.select("rid", F.sha2(text.cast("binary"), 256).alias("copy")))
    copies = hashed.groupBy("copy").agg(F.min("rid").alias("first"), F.count("*").alias("n")).filter("n > 1")
    whole = materialize(hashed.join(materialize(copies), "copy").select("rid", "first"))
    # Later copies leave the search: the first stands for them.
    later = whole.filter("rid <> first").select("rid")
    texts = long.select("rid", text.alias("text")).join(lookup(later), "rid", "left_anti")
    found = joined_ranges(repeated_starts(texts.filter(F.octet_length("text") >= span), span), "lo", "hi", 1)
    # Starts at most WORDS apart cover one run of words.
    runs = joined_ranges(repeated_starts(texts, WORDS, words=True), "lo", "hi", WORDS)
    passages = runs.select("rid", F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["hi"] - r["lo"] + WORDS).alias("passages"))
    marks = found.join(whole.select("rid", F.lit(True).alias("whole")), "rid", "full_outer").join(passages, "rid", "full_outer")
    marks = lookup(marks, F.coalesce(F.size("ranges"), F.lit(0)))
    out = rows.select("rid", "doc_id", text.alias("text")).join(marks, "rid", "left")
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long" + ", kept binary" * with_text
    return out.select(F.col("doc_id").cast("long"), "text", F.coalesce("whole", F.lit(False)).alias("whole"), "ranges", F.coalesce("passages", F.lit(0)).alias("passages")).mapInArrow(cutter(span, with_text), ddl)
