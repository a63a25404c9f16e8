"""SimHash near-duplicates through Gray-ordered hierarchical indexes.

Fingerprints (one row per distinct value) are routed by blocks: two that differ in at most K bits
agree on at least one of K + 1 blocks of 16 bits. Within a block value the remaining bits are
sorted by Gray rank, cut into leaves of neighbours, and leaves are grouped into upper nodes. A node
keeps the bits on which all below it agree (mask and pattern); a search adds up the differences on
those bits from the root down and drops a whole group once they exceed K. Of the links of one block
value only a spanning forest is kept, so a dense group of n gives at most n - 1 rows and loses no
link between components. Block values with very many fingerprints are routed again by blocks of the bits
that are left, as often as it takes, so none of them is one task's work.

Nulls, empty texts and texts of blanks have no words and fingerprint zero, which links like any
other. Repeated rows share a fingerprint and keep one row each. Null doc_ids get a fingerprint, but
are not used as a component's smallest id unless it has no other. A share of exactly half leaves a bit at 0.
An empty table gives no rows. deduplicate() keeps every column, whatever its name. Texts of any length are
read whole, with eight bytes for each shingle beside them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import blob, bounded_batches, components, keyed, lookup, materialize

K = 3
SEED = 42
SHINGLE = 3
LEAF, FAN = 16, 16
#: Block values with more fingerprints than this are routed by further blocks. A bucket never has more.
HOT = 4096
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.array([xxh64_intdigest(g, SEED) for g in grams], "<u8")
    n, octets, out = len(hashes), hashes.view(np.uint8).reshape(-1, 8), 0
    if n == 1:
        return int(hashes[0])
    for i in range(8):
        ones = np.bincount(octets[:, i], minlength=256) @ _BITS
        out |= int(((2 * ones > n) << np.arange(8)).sum()) << (8 * i)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed 64-bit integer."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in blob(batch["text"])], np.uint64).view(np.int64)
            yield pa.record_batch([batch["doc_id"], pa.array(values)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def index(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of the tree over Gray-sorted values, leaves first: (first child, mask, pattern) of each
    node; mask has the bits on which everything below the node agrees."""
    levels, both, either, size = [], values, values, LEAF
    while True:
        starts = np.arange(0, len(both), size)
        both, either = np.bitwise_and.reduceat(both, starts), np.bitwise_or.reduceat(either, starts)
        levels.append((starts, ~(both ^ either), both))
        if len(starts) == 1:
            return levels
        size = FAN


def forest(values: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct values, as pairs of values."""
    values = values[np.argsort(gray_rank(values))]
    levels, parent, out = index(values), np.arange(len(values)), []
    block = max(16, 2_000_000 // len(values))  # bounds the pairs in memory

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for at in range(0, len(values), block):
        part = np.arange(at, min(at + block, len(values)))
        q, v = search(values, levels, part, k)
        far = parent[q] != parent[v]
        for i, j in zip(q[far].tolist(), v[far].tolist(), strict=True):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
        while ((up := parent[parent]) != parent).any():
            parent = up
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return values[pairs[:, 0]], values[pairs[:, 1]]


def search(values: np.ndarray, levels: list, part: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of positions, i in part and j after i, whose values differ in at most k bits.

    All queries descend together. A node's differences are counted on its agreed bits; those on which
    its parent agreed are among them, so the count accumulates on the way down.
    """
    q, node = part, np.zeros(len(part), np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        starts, mask, pattern = levels[depth]
        keep = np.bitwise_count((values[q] ^ pattern[node]) & mask[node]) <= k
        q, node = q[keep], node[keep]
        n = len(levels[depth - 1][0]) if depth else len(values)
        size = FAN if depth else LEAF
        child = (starts[node][:, None] + np.arange(size)).ravel()
        q = np.repeat(q, size)
        keep = (child < n) if depth else (child < n) & (child > q)
        q, node = q[keep], child[keep]
    keep = np.bitwise_count(values[q] ^ values[node]) <= k
    return q[keep], node[keep]


def _links(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by key; a key's rows may span frames."""
    key, rest = None, []

    def close() -> Iterator[pd.DataFrame]:
        values = np.unique(np.concatenate(rest)) if rest else np.empty(0, np.int64)
        if len(values) > 1:
            a, b = forest(values.view(np.uint64), k)
            if len(a):
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    for frame in frames:
        keys, fps = frame["key"].to_numpy(), frame["fp"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
        for i, start in enumerate(cuts):
            if keys[start] != key:
                yield from close()
                key, rest = keys[start], []
            rest.append(fps[start : cuts[i + 1] if i + 1 < len(cuts) else len(keys)])
    yield from close()


def links(distinct: DataFrame, k: int = K) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp, enough to keep every component together.

    A key is a block and its value; keys with more than HOT fingerprints are dealt anew by blocks of the bits
    that are left, until none is hot or so few bits are left that none can be."""
    blocks = k + 1
    rows, left, dealt = distinct.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest")), 64, []
    while True:
        width = left // blocks

        def block(i: int, width: int = width) -> Column:
            """The key of block i, and the bits without it."""
            value = F.shiftrightunsigned("rest", i * width).bitwiseAND(F.lit((1 << width) - 1))
            low = F.col("rest").bitwiseAND(F.lit((1 << i * width) - 1))
            high = F.shiftleft(F.shiftrightunsigned("rest", (i + 1) * width), i * width) if (i + 1) * width < 64 else F.lit(0).cast("long")
            return F.struct(F.xxhash64("key", F.lit(i), value).alias("key"), low.bitwiseOR(high).alias("rest"))

        rows = rows.select("fp", F.explode(F.array(*map(block, range(blocks)))).alias("r")).select("fp", "r.*")
        left -= width
        if 1 << left <= HOT:
            dealt.append(rows)
            break
        hot = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("key"))  # at most rows / HOT
        if hot.isEmpty():
            dealt.append(rows)
            break
        dealt.append(rows.join(hot, "key", "left_anti").select("fp", "key", "rest"))
        rows = materialize(rows.join(hot, "key", "left_semi").select("fp", "key", "rest"))
    keyed_rows = reduce(DataFrame.unionByName, dealt).select("fp", "key")
    sorted_rows = keyed_rows.repartition("key").sortWithinPartitions("key")
    return sorted_rows.mapInPandas(lambda frames: _links(frames, k), "a long, b long")


def cluster(docs: DataFrame, shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, a row for each document."""
    prints = materialize(fingerprints(docs, shingle))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = components(links(distinct.select("fp"), k))  # (node, label) of linked fingerprints
    known = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    known = materialize(known)
    tops = known.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = known.select("fp", "label").join(materialize(tops), "label").select("fp", "component_id")
    return prints.join(materialize(ids), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """docs, all columns, with one row of each component: that of the smallest row key (doc_id, where
    that is unique)."""
    rows = keyed(docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("row")), "doc_id", "text", "row")
    found = cluster(rows.select(F.col("rid").alias("doc_id"), "text"), shingle, k)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("rid"))
    return rows.select("rid", "row").join(lookup(gone), "rid", "left_anti").select("row.*")
