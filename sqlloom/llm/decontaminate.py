"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of template words: numbers, units and names are typed placeholders, other
words are lower-cased. Windows of WINDOW template words of the benchmark are hash-joined with those
of every document; a window of placeholders alone says nothing by its template, so it is hashed by its
words. Runs of windows that match one item at one offset make an aligned passage; in it the slots must
agree: equal benchmark slots must meet equal document slots, and different names different names (two
numbers may become equal by chance). A document is a leak if a consistent passage covers MIN_SHARE of an
item's words, or MIN_WORDS of them.

Nulls are empty texts without words; an item or text of fewer than WINDOW words is taken as one window
of its own, and such items are looked for inside documents too; of a repeated item_id every text counts,
and a leak of one of them is a leak of the id; repeated documents and repeated or null doc_ids get a row
each; empty tables give no rows, or rows without leaks; other columns are ignored by scan() and kept by
remove(), whatever their names. Very long texts are held whole, one at a time, with their windows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import blob, bounded_batches, keyed, lookup, materialize

WINDOW = 8
MIN_SHARE, MIN_WORDS = 0.5, 13
#: Benchmark windows that may be held by each worker; beyond it windows meet by a shuffled join.
HELD_WINDOWS = 2_000_000
# Units of measure, in lower case.
UNITS = """mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz pound pounds
ounce ounces gram grams kilogram kilograms ml l liter liters litre litres gallon gallons s sec second seconds
min minute minutes h hr hour hours day days week weeks month months year years % $ usd eur euro euros dollar
dollars cent cents mph kph meter meters metre metres kilometer kilometers centimeter centimeters""".split()
_NUMBER = re.compile(rb"[+-]?[$]?\d[\d,.:/]*%?")
_END = (b".", b"!", b"?", b":")
_STRIP = b".,;:!?\"'()[]{}"
NUM, UNIT, NAME = b"<num>", b"<unit>", b"<name>"
_KEPT_WORDS = 200_000


def _hash(x: bytes) -> int:
    return xxh3_64_intdigest(x)


NAME_SLOT = _hash(NAME)
SLOTS = np.array([_hash(NUM), _hash(UNIT), NAME_SLOT], np.uint64)


class _Kinds(dict):
    """Number of a word; under it the hash of its template word at a sentence's start and inside, and
    whether it ends one."""

    units = {u.encode() for u in UNITS}

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.first, self.inside, self.ends = np.empty(1024, np.uint64), np.empty(1024, np.uint64), np.empty(1024, bool)

    def __missing__(self, word: bytes) -> int:
        own = word.strip(_STRIP)
        low = own.lower()
        slot = NUM if _NUMBER.fullmatch(own) else UNIT if low in self.units and len(low) > 1 else None
        n = len(self)
        if n == len(self.first):
            self.first, self.inside, self.ends = (np.concatenate([x, np.empty_like(x)]) for x in (self.first, self.inside, self.ends))
        self.first[n] = _hash(slot or low)
        # A capital inside a sentence marks a name; at its start it tells nothing.
        self.inside[n] = NAME_SLOT if slot is None and own[:1].isupper() and not own.isupper() else self.first[n]
        self.ends[n] = word.endswith(_END)
        self[word] = n
        return n


def _clean(word: bytes) -> bytes:
    return word.strip(_STRIP).lower()


def template(text: bytes, kinds: _Kinds) -> tuple[list[bytes], np.ndarray]:
    """Words and the hashes of their template words."""
    if len(kinds) > _KEPT_WORDS:
        kinds.reset()
    words = text.split()
    at = np.fromiter(map(kinds.__getitem__, words), np.int64, len(words))
    starts = np.r_[True, kinds.ends[at[:-1]]] if len(at) else np.empty(0, bool)
    return words, np.where(starts, kinds.first[at], kinds.inside[at])


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            out = (out ^ h[i : len(h) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return out


def windows(words: list[bytes], h: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """A hash of each run of `size` template words; one for the whole where there are fewer."""
    size = min(size, len(h))
    if not size:
        return np.empty(0, np.uint64)
    out = _rolled(h, size)
    slots = np.cumsum(np.r_[0, (h == SLOTS[0]) | (h == SLOTS[1]) | (h == SLOTS[2])])
    bare = np.flatnonzero(slots[size:] - slots[:-size] == size)
    if len(bare):
        plain = np.zeros(len(h), np.uint64)
        used = np.unique(np.concatenate([bare + i for i in range(size)]))
        plain[used] = [_hash(b"=" + _clean(words[i])) for i in used.tolist()]
        out[bare] = _rolled(plain, size)[bare]
    return out


def consistent(item: list[bytes], words: list[bytes], h: np.ndarray) -> bool:
    """Equal slots of the item meet equal slots of the document, and different names different names.
    h: hashes of the template words, the same in both."""
    there: dict[bytes, bytes] = {}
    back: dict[bytes, bytes] = {}
    for i in np.flatnonzero(np.isin(h, SLOTS)).tolist():
        a, b = _clean(item[i]), _clean(words[i])
        if there.setdefault(a, b) != b or (int(h[i]) == NAME_SLOT and back.setdefault(b, a) != a):
            return False
    return True


def passages(places: dict[int, np.ndarray], wanted: list[tuple[int, int]], least: int) -> Iterator[tuple[int, int, int]]:
    """(offset, first, last item place) of the maximal runs of at least `least` windows at one offset.

    places: document places of each window, in order; wanted: (item place, window). Item places are gone
    through in order with the document places that the last one met, so a window that is frequent on both
    sides costs a merge, not all pairs."""
    none = np.empty(0, np.int64)
    held, begun, before = none, none, -2
    for place, w in [*sorted(wanted), (-1, None)]:
        now = places.get(w, none)
        start, ended = np.full(len(now), place), np.ones(len(held), bool)
        if place == before + 1 and len(held) and len(now):
            i = np.minimum(np.searchsorted(held, now - 1), len(held) - 1)
            on = held[i] == now - 1
            start[on] = begun[i[on]]
            ended[i[on]] = False
        ended &= before - begun + 1 >= least
        yield from zip((held[ended] - before).tolist(), begun[ended].tolist(), [before] * int(ended.sum()), strict=True)
        held, begun, before = now, start, place


def leaked(words: list[bytes], places: dict[int, np.ndarray], item_words: list[bytes], item_hashes: np.ndarray, wanted: list[tuple[int, int]]) -> bool:
    """Whether a document leaks an item whose windows `wanted` it holds."""
    size = min(WINDOW, len(item_words))
    need = math.ceil(min(MIN_WORDS, MIN_SHARE * len(item_words)))
    return any(
        consistent(item_words[lo : hi + size], words[lo + offset : hi + size + offset], item_hashes[lo : hi + size])
        for offset, lo, hi in passages(places, wanted, need - size + 1)
    )


def _grouped(w: np.ndarray, at: np.ndarray) -> dict[int, np.ndarray]:
    """Places, in order, of each window."""
    order = np.lexsort((at, w))
    w, at = w[order], at[order]
    cuts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else []
    return dict(zip(w[cuts].tolist(), np.split(at, cuts[1:]), strict=True)) if len(w) else {}


_MADE = "n_hits long, items array<long>"


def _held(docs: DataFrame, bench: list[tuple[int, bytes]]) -> DataFrame:
    """docs(row, text) with n_hits and items. Every worker holds the benchmark's windows in one sorted
    array: documents are read once and no row moves."""
    kinds = _Kinds()
    made = [template(text, kinds) for _, text in bench]
    rows = [(w, i, place) for i, (words, h) in enumerate(made) for place, w in enumerate(windows(words, h).tolist())]
    rows.sort()
    keys = np.array([r[0] for r in rows], np.uint64)
    where = np.array([r[1:] for r in rows], np.int64).reshape(-1, 2)
    short = sorted({len(words) for words, _ in made} & set(range(1, WINDOW)))
    shared = docs.sparkSession.sparkContext.broadcast((keys, where, bench))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (keys, where, bench) = _Kinds(), shared.value

        def judge(text: bytes) -> tuple[int, list[int]]:
            words, h = template(text, own)
            ws, ats = [], []
            for size in [WINDOW, *short] if len(keys) else []:
                w = windows(words, h, size) if len(h) >= size else np.empty(0, np.uint64)
                hit = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, w), len(keys) - 1)] == w)
                ws.append(w[hit])
                ats.append(hit)
            n = sum(map(len, ats))
            if not n:
                return 0, []
            places = _grouped(np.concatenate(ws), np.concatenate(ats))
            wanted: dict[int, list[tuple[int, int]]] = {}
            for w in places:
                for j in range(*(int(np.searchsorted(keys, np.uint64(w), side)) for side in ("left", "right"))):
                    wanted.setdefault(int(where[j, 0]), []).append((int(where[j, 1]), w))
            return n, sorted({bench[i][0] for i, own_windows in wanted.items() if leaked(words, places, *template(bench[i][1], own), own_windows)})

        for batch in batches:
            found = [judge(t) for t in blob(batch["text"])]
            made = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch["row"], *made], ["row", "n_hits", "items"])

    return docs.mapInArrow(run, f"row {docs.schema['row'].dataType.simpleString()}, {_MADE}")


def _joined(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """docs(rid, text) -> rid, n_hits, items of documents that hold a benchmark window, by shuffled hash
    joins, for benchmarks of any size.

    Document windows that the benchmark lacks drop out first. A document then meets each item whose windows
    it holds, never pairs of places; the items of a document stream past it one by one."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([min(WINDOW, len(t.split())) for t in blob(batch["text"])], pa.int32())], names=["size"])

    # At most WINDOW - 1 numbers: short items are looked for inside documents too.
    short = sorted(r["size"] for r in bench.select("text").mapInArrow(lengths, "size int").filter((F.col("size") > 0) & (F.col("size") < WINDOW)).distinct().collect())

    def cut(batches: Iterator[pa.RecordBatch], sizes: list[int]) -> Iterator[pa.RecordBatch]:
        """Windows of each of `sizes`; without sizes, those of an item by its own length."""
        own = _Kinds()
        for batch in batches:
            for row, text in zip(batch["id"].to_pylist(), blob(batch["text"]), strict=True):
                words, h = template(text, own)
                for size in sizes or [min(WINDOW, len(h))]:
                    w = windows(words, h, size).view(np.int64) if len(h) >= size else np.empty(0, np.int64)
                    if len(w):
                        yield pa.record_batch([pa.array(np.full(len(w), row)), pa.array(w), pa.array(np.arange(len(w)))], names=["id", "w", "at"])

    ddl = "id long, w long, at long"
    bench = materialize(bench.withColumn("key", F.monotonically_increasing_id()))
    left = docs.select(F.col("rid").alias("id"), "text").mapInArrow(lambda b: cut(b, [WINDOW, *short]), ddl).withColumnRenamed("id", "rid")
    right = materialize(bench.select(F.col("key").alias("id"), "text").mapInArrow(lambda b: cut(b, []), ddl).withColumnRenamed("id", "key"))
    hits = materialize(left.join(right.select("w").distinct(), "w", "left_semi"))
    pair = F.collect_list(F.struct("w", "at")).alias("hits")
    found = hits.select("rid", "w").distinct().join(right, "w").groupBy("rid", "key").agg(pair).join(bench, "key")
    own = docs.select("rid", "text").join(hits.groupBy("rid").agg(pair), "rid")
    parts = own.select("rid", F.lit(None).cast("long").alias("item"), "text", "hits").unionByName(found.select("rid", F.col("item_id").alias("item"), "text", "hits"))
    ordered = parts.repartition("rid").sortWithinPartitions("rid", F.col("item").asc_nulls_first(), "text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _Kinds()
        out: list[tuple[int, int, list[int]]] = []
        rows = (r for b in batches for i in range(len(b)) for r in b.slice(i, 1).to_pylist())
        words, places = [], {}
        for r in rows:
            if r["item"] is None:
                words = template((r["text"] or "").encode(), kinds)[0]
                places = _grouped(*np.array([(h["w"], h["at"]) for h in r["hits"]], np.int64).T)
                if len(out) >= 1000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), made.types, strict=True)], schema=made)
                    out = []
                out.append((r["rid"], len(r["hits"]), []))
            elif r["item"] not in out[-1][2] and leaked(words, places, *template(r["text"].encode(), kinds), [(h["at"], h["w"]) for h in r["hits"]]):
                out[-1][2].append(r["item"])
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), made.types, strict=True)], schema=made)

    made = pa.schema([("rid", pa.int64()), ("n_hits", pa.int64()), ("items", pa.list_(pa.int64()))])
    return ordered.mapInArrow(judge, f"rid long, {_MADE}")


def leaks(docs: DataFrame, bench: DataFrame, held_windows: int = HELD_WINDOWS) -> DataFrame:
    """docs(row, text): row, n_hits and the leaked items. Which of two paths finds them does not show."""
    bounded_batches(docs.sparkSession)
    bench = bench.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("item_id is not null").distinct()
    words = bench.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")) + 1)).first()[0] or 0
    if words <= held_windows:  # a bound on the windows and, at a few bytes a word, on the texts
        return _held(docs, [(r["item_id"], r["text"].encode()) for r in bench.collect()])
    rows = keyed(docs.select("row", "text", F.col("row.doc_id").alias("doc_id")), "doc_id", "row", "text")
    marked = lookup(_joined(rows, bench))
    none = F.array().cast("array<long>")
    return rows.join(marked, "rid", "left").select("row", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("items", none).alias("items"))


def _rows(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(F.struct(*[F.col(c) for c in columns]).alias("row"), F.col("text").cast("string").alias("text"))


def scan(docs: DataFrame, bench: DataFrame, held_windows: int = HELD_WINDOWS) -> DataFrame:
    """doc_id, n_hits (windows that the benchmark holds), contaminated and the leaked items (ids, comma-joined)
    of each row."""
    found = leaks(_rows(docs, "doc_id"), bench, held_windows)
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_hits", (F.size("items") > 0).alias("contaminated"), F.array_join("items", ",").alias("items"))


def remove(docs: DataFrame, bench: DataFrame, held_windows: int = HELD_WINDOWS) -> DataFrame:
    """docs, all columns, without leaking rows."""
    return leaks(_rows(docs, *docs.columns), bench, held_windows).filter(F.size("items") == 0).select("row.*")
