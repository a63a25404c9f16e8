"""Best-fit packing planned over a histogram of lengths.

1. Tokenise (Arrow, one pass, written once): a row for each piece, with its length.
2. Count pieces by length: at most `capacity` rows, whatever the corpus, go to the driver.
3. Best fit, longest first, over the counts: bins with the same content are one entry.
4. A piece's rank within its length picks its planned slot. Ranks come from counts by
   (length, hash bucket) and a row number inside a bucket, so no length meets in one task.

Nulls are empty texts (one end token); null or repeated doc_ids are separate documents; an empty
table gives no rows; other columns are ignored. Of sequences with equal room the one opened last is filled
first, and pieces of equal length take their slots by hash bucket, doc_id, piece and row; any such choice
packs as well. A very long text is encoded whole and cut into pieces, so the rows it gives are bounded.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bounded_batches, materialize

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Hash buckets of a length for ranking, as a multiple of the shuffle partitions.
BUCKETS = 4


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes, as the tokenizers library gives them.

    Where a byte-level vocabulary numbers its tokens in the order of its merges, ids are merge ranks, and
    a rank encoder made from the same file finds them several times faster. Texts that may hold a
    special token, and other vocabularies, go to the library itself."""

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        model = parts["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        vocab, special = model["vocab"], [t["content"] for t in parts.get("added_tokens", [])]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        step = parts.get("pre_tokenizer") or {}
        ordered = step.get("type") == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space") and not parts.get("normalizer")
        ordered = ordered and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special} if ordered else None
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")

    def encode(self, text: str) -> bytes:
        if self.ranks and not self.special.search(text):
            return np.asarray(self.ranks.encode_to_numpy(text, disallowed_special=()), "<u4").tobytes()
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def tokenized(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids with keep_ids) for each piece.

    Only documents longer than capacity are cut; their first piece takes the remainder.
    """
    bounded_batches(docs.sparkSession)
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * keep_ids
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = encode(text or "") + end
                stop, piece, start = len(ids) // 4, 0, 0
                while start < stop:
                    length = (stop - 1) % capacity + 1 if start == 0 else capacity
                    own = ids[4 * start : 4 * (start + length)]
                    row = [doc, piece, start, length, zlib.crc32(own)]
                    for column, value in zip(out, row + [np.frombuffer(own, "<i4")] * keep_ids, strict=True):
                        column.append(value)
                    piece, start = piece + 1, start + length
            yield pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest length first, over counts.

    Returns (length, first rank, ranks, first sequence, items a sequence, offset): ranks
    [first, first + ranks) of that length fill sequences in turn, `items` in each, from offset on.
    Entries depend on the distinct lengths, not on the number of pieces.
    """
    slots = []
    free: dict[int, list[tuple[int, int]]] = {}  # room left: runs of sequences (first, how many)
    rooms: list[int] = []
    fresh = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = free[room].pop()
                if not free[room]:
                    del free[room], rooms[at]
            else:
                room, first = capacity, fresh
                n = -(-left // (capacity // length))
                fresh += n
            items = room // length
            full = min(n, left // items)
            if full:
                slots.append((length, rank, full * items, first, items, capacity - room))
                put(room - items * length, first, full)
                rank, left = rank + full * items, left - full * items
            if full < n and left:  # fewer than a sequence takes
                slots.append((length, rank, left, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, n - full)
    return slots


def ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """pieces with `rank`, 0.. without gaps within each length."""
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", "salt"), F.lit(buckets)))
    sizes = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "salt")
    rows = pieces.withColumn("rank", F.row_number().over(inside) - 1).join(bases, ["length", "bucket"])
    return rows.withColumn("rank", F.col("rank") + F.col("base")).drop("bucket", "base")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with sequence_id and offset; sequences are gapless from 0."""
    spark = docs.sparkSession
    pieces = materialize(tokenized(docs, tokenizer, capacity, keep_ids).withColumn("salt", F.monotonically_increasing_id()))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # <= capacity rows
    slots = spark.createDataFrame(plan(counts, capacity), "length long, lo long, n long, first long, items long, at long")
    rows = ranked(pieces, BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rank = F.col("rank") - F.col("lo")
    # The plan has a size bound of its own (a function of capacity), so it may be broadcast.
    placed = rows.join(F.broadcast(slots), (rows["length"] == slots["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("lo") + F.col("n")))
    return placed.select(
        "doc_id", "piece", "start", rows["length"], "ids_crc32",
        (F.col("first") + F.floor(rank / F.col("items"))).alias("sequence_id"),
        (F.col("at") + (rank % F.col("items")) * rows["length"]).alias("offset"),
        *["ids"] * keep_ids,
    )
