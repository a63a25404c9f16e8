"""The plain Python face: parse one statement or a script without Spark, with replaceable parts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from .functions.detect import candidates
from .functions.text import split_statements
from .operators.lineage import PLUGINS as DIALECTS
from .operators.lineage import record
from .plans.lineage import Result
from .plans.statements import parse_script as _parse_script
from .plans.statements import parse_statement

_parser: Callable = _parse_script


def configure(parser: Callable | None) -> None:
    """Replace the script parser for the process; None restores the built-in one."""
    global _parser
    _parser = parser or _parse_script


def register(dialect: str, parser: Callable) -> None:
    """Add or replace the parser of a dialect; the last registration wins."""
    DIALECTS[dialect.upper()] = parser


def select_dialect(sql: str, hints: Iterable[str] = (), detection: bool = True) -> tuple[str, float]:
    """First hint with confidence 1; without detection UNKNOWN with 0; else the best candidate."""
    for hint in hints:
        return hint.upper(), 1.0
    return candidates(sql)[0] if detection else ("UNKNOWN", 0.0)


def parse_script(sql: str, dialect: str | None = None, hints: Iterable[str] = (), detection: bool = True) -> list[dict]:
    """A record for each statement, in the shape of the result tables."""
    hints = [dialect] if dialect else list(hints)
    own = next((DIALECTS[h.upper()] for h in hints if h.upper() in DIALECTS), None)
    if own:
        rows = [(s, 1.0, own(s, hints[0].upper(), {})) for s in split_statements(sql or "")]
    elif hints or detection:
        rows = _parser(sql or "", hints[0].upper() if hints else None)
    else:
        rows = [(s, 0.0, parse_statement(s, "UNKNOWN")) for s in split_statements(sql or "")]
    return [record(None, i, *row) for i, row in enumerate(rows)]


def parse(sql: str, dialect: str | None = None, **options) -> dict:
    """The first statement's record; empty SQL gives an EMPTY_SQL error."""
    found = parse_script(sql, dialect, **options)
    if found:
        return found[0]
    return record(None, 0, sql or "", 0.0, Result("UNKNOWN", diagnostics=[("ERROR", "EMPTY_SQL", "there is no statement")]))
