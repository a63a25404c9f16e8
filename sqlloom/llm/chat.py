"""Chat formatting in budgeted windows.

A conversation's turns, in order, become windows of at most BUDGET tokens. Prefix sums of turn tokens
choose how many whole turns a window takes. Later windows begin with the system turn and with a
limited history of the turns before, both repeated; only an assistant text's first place is under
the loss mask, so repeated targets are masked. A turn that is longer than the budget by itself has a
window of its own.

A turn is written `### role: text</turn>` and a line end. Inside texts and roles every backslash and
every control string (`###`, `</turn>`) gets a backslash before it, and roles also before a colon, so
reading back is exact whatever a text says.

Rows are taken by turn, ties by role and text; a null text or role is empty; null turns come first;
rows with a null conv_id are one conversation; repeated rows are turns of their own; an empty table
gives no windows; other columns are ignored. A conversation streams through its task: what is held
is the system turn, the history and the turns of one window, however long it is.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .packing import TOKENIZER, encoder

BUDGET = 1024
#: Turns and tokens of history that a later window repeats at most.
HISTORY_TURNS, HISTORY_TOKENS = 2, 256
OPEN, CLOSE = "### ", "</turn>\n"
TARGET = "assistant"
_CONTROL = re.compile(r"\\|###|</turn>")
_PLAIN = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\])*?)</turn>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _PLAIN.sub(r"\1", text)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its text begins and ends in it."""
    head = f"{OPEN}{escape(role).replace(':', chr(92) + ':')}: "
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def read_turns(window: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(window)]


def windows(turns: Iterator[tuple[str, str]], size, budget: int = BUDGET) -> Iterator[dict]:
    """Windows of one conversation. size(written turn) is its number of tokens."""
    system, history, at, number = None, [], 0, 0
    pending, sums = [], [0]
    turns = iter(turns)
    more = True
    while more or pending:
        repeated = ([system] if system and at else []) + history
        room = budget - sum(t[3] for t in repeated)
        # Read on until the pending turns pass the room, or the conversation ends.
        while more and (not pending or sums[-1] <= room):
            turn = next(turns, None)
            if turn is None:
                more = False
                break
            written = (*write_turn(*turn), size(write_turn(*turn)[0]), turn[0])
            if system is None and not at and not pending:
                system = written if turn[0] == "system" else False
            pending.append(written)
            sums.append(sums[-1] + written[3])
        if not pending:
            break
        take = bisect_right(sums, room) - 1
        if take < 1 and repeated:  # the turn comes before its context: without history, then alone
            repeated = repeated[:1] if system and at else []
            take = bisect_right(sums, budget - sum(t[3] for t in repeated)) - 1
            repeated = repeated if take >= 1 else []
        take = max(1, take)
        parts, loss, place = [], [], 0
        for i, (text, start, end, _, role) in enumerate(repeated + pending[:take]):
            if i >= len(repeated) and role == TARGET:
                loss.append((place + start, place + end))
            parts.append(text)
            place += len(text)
        tokens = sum(t[3] for t in repeated) + sums[take]
        yield {"window": number, "text": "".join(parts), "first_turn": at, "n_turns": take, "n_repeated": len(repeated), "tokens": tokens, "loss": loss}
        number, at = number + 1, at + take
        done, pending = pending[:take], pending[take:]
        sums = [s - sums[take] for s in sums[take:]]
        own = [t for t in done if t is not system]
        history, held = [], 0
        for turn in reversed(own[-HISTORY_TURNS:]):
            held += turn[3]
            if held > HISTORY_TOKENS:
                break
            history.insert(0, turn)


_WINDOW = "conv_id long, window int, text string, first_turn long, n_turns long, n_repeated int, tokens long, loss array<struct<start:int,end:int>>"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def format_windows(conversations: DataFrame, tokenizer: str | None = None, budget: int = BUDGET) -> DataFrame:
    """The windows of each conversation, a conversation's windows together and in order."""
    bounded_batches(conversations.sparkSession)
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("first_turn", pa.int64()), ("n_turns", pa.int64()), ("n_repeated", pa.int32()), ("tokens", pa.int64()), ("loss", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        out: list[dict] = []
        held = 0
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            for w in windows(((r[1], r[2]) for r in rows), lambda t: len(encode(t)) // 4, budget):
                out.append({"conv_id": conv, **w, "loss": [{"start": a, "end": b} for a, b in w["loss"]]})
                held += len(w["text"])
                if held > 4_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, _WINDOW)


def digest(formatted: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The contract's columns, read back from windows as format_windows() gives them; and n_over, windows of
    more tokens than `budget`, which hold one turn that is longer by itself."""
    bounded_batches(formatted.sparkSession)
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64()), ("n_over", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = chars = size = count = over = 0
            for _, text, repeated, spans, tokens in rows:
                over += tokens > budget
                for role, said in read_turns(text)[repeated:]:
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for s in spans:
                    said = unescape(text[s["start"] : s["end"]])
                    loss.update(said.encode())
                    chars += len(said)
                size, count = size + len(text), count + 1
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, count, over))
            if len(out) >= 5000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long, n_over long"
    return formatted.select("conv_id", "text", "n_repeated", "loss", "tokens").mapInArrow(run, ddl)
