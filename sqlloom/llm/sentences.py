"""Substring dedup by sliding sentence spans.

A text is cut into sentences (at line ends and after . ! ? followed by a blank). Every run of SPAN
consecutive sentences is hashed, over words joined by one blank; runs of fewer than MIN_WORDS words are
lengthened by the sentences that follow, and again by those before, until they have as many, so that a
few short exclamations do not count as a passage and one at a passage's end is in a run inside it. A
sentence of MIN_WORDS words is a run by itself. So all whole sentences of a repeated passage are covered
if they have MIN_WORDS words together. Hashes meet globally; of each repeated run the first (least row,
then place) stays, and sentences covered by any other occurrence go.

Nulls are empty texts; texts with fewer than SPAN sentences are one run if they have MIN_WORDS words,
so exact copies of short texts are found too; repeated rows and ids are separate rows, of which the least
row key is first; an empty table gives no rows; other columns are ignored. Texts of any length are cut whole.
Hashes have 128 bits, so that chance equality removes nothing even among 10^12 runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import blob, joined_ranges, keyed, lookup, materialize

SPAN = 2
MIN_WORDS = 20
#: Runs after which an Arrow batch ends, once a text is done.
ROWS = 50_000
_CUT = re.compile(rb"[^\n]*?(?:[.!?]+(?=[ \t])[ \t]*|\n+|$)", re.S)


def sentences(text: bytes) -> list[bytes]:
    """Pieces that make up the text when joined."""
    return [m for m in _CUT.findall(text) if m]


def runs(text: bytes, span: int = SPAN, least: int = MIN_WORDS) -> tuple[list[int], list[int], list[bytes]]:
    """First sentence, sentence after the last, and 128-bit hash of each run."""
    words = [s.split() for s in sentences(text)]
    sizes = np.cumsum([0, *map(len, words)])
    n = len(words)
    first, last, hashes = [], [], []
    joined = [b" ".join(w) for w in words]
    filled = [i for i in range(n) if words[i]]
    found = {(i, i + 1) for i in filled if sizes[i + 1] - sizes[i] >= least}
    for k, i in enumerate(filled):
        # `span` sentences with words, and as many more after or before them as it takes.
        if k + span > len(filled) and not (k == 0 and len(filled) < span):
            break
        end = filled[min(k + span, len(filled)) - 1] + 1
        if sizes[end] - sizes[i] >= least:
            found.add((i, end))
            continue
        after = int(np.searchsorted(sizes, sizes[i] + least))
        if after <= n:
            found.add((i, after))
        before = int(np.searchsorted(sizes, sizes[end] - least, "right")) - 1
        if before >= 0:
            found.add((before, end))
    for i, end in sorted(found):
        first.append(i)
        last.append(end)
        hashes.append(xxh3_128_digest(b" ".join(x for x in joined[i:end] if x)))
    return first, last, hashes


def hashed_runs(rows: DataFrame, span: int = SPAN, least: int = MIN_WORDS) -> DataFrame:
    """rid, first, last and hash (two numbers) of every run of rows(rid, text)."""
    names = ["rid", "first", "last", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, firsts, lasts, hashes = [], [], [], []
            for rid, text in zip(batch["rid"].to_pylist(), blob(batch["text"]), strict=True):
                found = runs(text, span, least)
                rids += [rid] * len(found[0])
                for column, values in zip((firsts, lasts, hashes), found, strict=True):
                    column += values
                if len(rids) >= ROWS:
                    yield made(rids, firsts, lasts, hashes)
                    rids, firsts, lasts, hashes = [], [], [], []
            yield made(rids, firsts, lasts, hashes)

    def made(rids: list[int], firsts: list[int], lasts: list[int], hashes: list[bytes]) -> pa.RecordBatch:
        h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
        return pa.record_batch([pa.array(rids, pa.int64()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=names)

    return rows.mapInArrow(run, "rid long, first int, last int, h1 long, h2 long")


def repeated(found: DataFrame) -> DataFrame:
    """rid, first, last of runs that are not the first of their hash. Counting combines in each task;
    the join keeps a hash that very many rows hold on one side only, where it can be split."""
    firsts = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("rid", "first")).alias("least")).filter("n > 1").select("h1", "h2", "least")
    return found.join(materialize(firsts), ["h1", "h2"]).filter(F.struct("rid", "first") != F.col("least")).select("rid", "first", "last")


def remove_repeats(docs: DataFrame, span: int = SPAN, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_sentences, n_removed, the removed sentence numbers, and the text that stays."""
    rows = keyed(docs).select("rid", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialize(hashed_runs(rows.select("rid", "text"), span, least))
    marks = lookup(joined_ranges(repeated(found), "first", "last").withColumnRenamed("ranges", "spans"), F.size("spans"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.string()), ("text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, spans in zip(batch["doc_id"].to_pylist(), blob(batch["text"]), batch["spans"].to_pylist(), strict=True):
                pieces = sentences(text)
                gone = np.zeros(len(pieces), bool)
                for s in spans or ():
                    gone[s["first"] : s["last"]] = True
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2)
                kept = b"".join(p for p, g in zip(pieces, gone, strict=True) if not g) if len(edges) else text
                out.append((doc, len(pieces), int(gone.sum()), ",".join(f"{a}-{b}" for a, b in edges), kept.decode()))
            columns = zip(*out, strict=True) if out else [[] for _ in schema]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return rows.join(marks, "rid", "left").select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_sentences long, n_removed long, removed string, text string")
