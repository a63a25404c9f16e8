"""Tokens of SQL text, by dialect."""

from __future__ import annotations

import re
from typing import NamedTuple

DIALECTS = ("SPARK", "HIVE", "FLINK", "STARROCKS", "MYSQL", "ORACLE", "SQLSERVER", "POSTGRESQL", "OCEANBASE")


class Token(NamedTuple):
    kind: str  # word, name (quoted), text, number, op
    text: str  # as written
    value: str  # lower-case word, or the name without quotes


class ParseError(ValueError):
    """SQL that the grammar has no place for."""


_COMMON = r"""
  (?P<blank>\s+|--[^\n]*|/\*(?!\+).*?\*/|/\*\+.*?\*/{hash})
 |(?P<name>`(?:[^`]|``)*`{names})
 |(?P<text>[rRbBnNxXeE]?'(?:[^'\\]|''|\\.)*'{texts}|\$\$.*?\$\$)
 |(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?(?:[LSDFlsdf]|BD|bd)?(?![\w])|0[xX][0-9a-fA-F]+)
 |(?P<word>[@#\#]{{0,2}}[^\W\d][\w$\#]*|\d+[^\W\d]\w*|@@?\w+)
 |(?P<op>\|>|<=>|->>|->|=>|::|:=|\|\||&&|<<|>>|<=|>=|<>|!=|==|[-+*/%=<>!~^&|?:.,;(){{}}\[\]@\#\\$])
"""


def _lexer(double_is_name: bool, brackets: bool, hashes: bool) -> re.Pattern:
    names = r'|"(?:[^"]|"")*"' if double_is_name else ""
    names += r"|\[(?:[^\W\d]|[@\#])[^\]]*\]" if brackets else ""
    texts = "" if double_is_name else r'|"(?:[^"\\]|""|\\.)*"'
    return re.compile(_COMMON.format(hash=r"|\#[^\n]*" if hashes else "", names=names, texts=texts), re.S | re.X)


_LEXERS = {d: _lexer(d in ("POSTGRESQL", "ORACLE", "SQLSERVER"), d == "SQLSERVER", d in ("MYSQL", "POSTGRESQL", "OCEANBASE")) for d in DIALECTS}


def tokenize(sql: str, dialect: str) -> list[Token]:
    lexer, out, at = _LEXERS[dialect], [], 0
    while at < len(sql):
        m = lexer.match(sql, at)
        if not m:
            raise ParseError(f"line {sql.count(chr(10), 0, at) + 1}:{at - sql.rfind(chr(10), 0, at) - 1} unexpected {sql[at]!r}")
        at, kind, text = m.end(), m.lastgroup, m[0]
        if kind == "blank":
            continue
        value = text[1:-1].replace(text[-1] * 2, text[-1]) if kind == "name" else text.lower() if kind == "word" else text
        out.append(Token(kind, text, value))
    return out
