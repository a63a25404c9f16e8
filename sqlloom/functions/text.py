"""Script text: splitting, comments, placeholders."""

from __future__ import annotations

import re

_PLACEHOLDER = re.compile(r"\$\{[^}]*\}|\{\{.*?\}\}", re.S)
#: What a template placeholder is read as.
PLACEHOLDER = "placeholder_value"


def split_statements(script: str) -> list[str]:
    """Statements of a script: cut at semicolons outside quotes and comments.

    Outside quotes the two-character sequences backslash-n and backslash-r count as line ends and
    backslash-t as a blank. Parts that hold nothing but comments and blanks are left out."""
    out: list[str] = []
    part: list[str] = []
    quote, i = "", 0
    while i < len(script):
        c, two = script[i], script[i : i + 2]
        if quote:
            part.append(c)
            if c == "\\" and two[1:] == quote:
                part.append(quote)
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote = c
            part.append(c)
        elif two == "--":
            end = script.find("\n", i)
            end = len(script) if end < 0 else end
            part.append(script[i:end])
            i = end - 1
        elif two == "/*":
            end = script.find("*/", i + 2)
            end = len(script) if end < 0 else end + 2
            part.append(script[i:end])
            i = end - 1
        elif two in ("\\n", "\\r", "\\t"):
            part.append(" " if two == "\\t" else "\n")
            i += 1
        elif c == ";":
            out.append("".join(part))
            part = []
        else:
            part.append(c)
        i += 1
    out.append("".join(part))
    return _blocks([p.strip() for p in out if strip_comments(p).strip()])


#: Statements whose body holds statements of its own, up to the END of their BEGIN.
_BLOCK = re.compile(r"\s*(?:execute\s+statement\s+set\s+begin|create\s+(?:or\s+(?:replace|alter)\s+)?(?:procedure|proc|function|trigger|package)\b.*\bbegin)\b", re.I | re.S)
_OPEN = re.compile(r"\bbegin\b(?!\s+(?:tran|transaction|try|catch)\b)", re.I)
_CLOSE = re.compile(r"\s*end\b(?!\s*(?:if|loop|case|while|repeat|for)\b)", re.I)


def _blocks(parts: list[str]) -> list[str]:
    """parts, with those of one block joined again; a block without its END stays in parts."""
    out, i = [], 0
    while i < len(parts):
        end, depth = i, 0
        if _BLOCK.match(strip_comments(parts[i])):
            depth = len(_OPEN.findall(strip_comments(parts[i])))
            while depth and end + 1 < len(parts):
                end += 1
                text = strip_comments(parts[end])
                depth += len(_OPEN.findall(text)) - bool(_CLOSE.match(text))
        if depth:
            end = i
        out.append(";\n".join(parts[i : end + 1]))
        i = end + 1
    return out


_COMMENT = re.compile(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`)|--[^\n]*|/\*.*?(?:\*/|\Z)""", re.S)


def strip_comments(sql: str) -> str:
    """sql with each comment outside quotes as one blank."""
    return _COMMENT.sub(lambda m: m[1] or " ", sql)


def normalize_placeholders(sql: str) -> str:
    """${...} and {{...}} as an identifier, inside string literals too."""
    return _PLACEHOLDER.sub(PLACEHOLDER, sql)
