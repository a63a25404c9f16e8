"""Command line: python -m sqlloom.cli [--dialect NAME] [SQL ...]; SQL is read from stdin if none is given."""

from __future__ import annotations

import json
import sys
from typing import TextIO

from .api import parse_script
from .plans.tokens import DIALECTS

# Other spellings of dialect names.
ALIASES = {"postgres": "POSTGRESQL", "pg": "POSTGRESQL", "sql-server": "SQLSERVER", "mssql": "SQLSERVER"}
USAGE = "usage: sqlloom [-h] [--dialect NAME | --dialect=NAME] [SQL ...]"


def dialect_of(name: str) -> str:
    found = ALIASES.get(name.lower(), name.upper().replace("-", ""))
    if found not in DIALECTS:
        raise ValueError(f"unknown dialect: {name}")
    return found


def run(args: list[str], stdin: TextIO, stdout: TextIO, stderr: TextIO) -> int:
    """0 with a JSON array on stdout; 2 with the usage on stderr for bad arguments or empty SQL."""
    words, dialect, rest = [], None, iter(args)
    try:
        for arg in rest:
            if arg in ("-h", "--help"):
                print(USAGE, file=stderr)
                return 0
            if arg == "--dialect":
                value = next(rest, None)
                if value is None:
                    raise ValueError("--dialect needs a value")
                dialect = dialect_of(value)
            elif arg.startswith("--dialect="):
                dialect = dialect_of(arg.partition("=")[2])
            elif arg.startswith("--"):
                raise ValueError(f"unknown option: {arg}")
            else:
                words.append(arg)
    except ValueError as e:
        print(e, USAGE, sep="\n", file=stderr)
        return 2
    sql = " ".join(words) if words else stdin.read()
    if not sql.strip():
        print(USAGE, file=stderr)
        return 2
    json.dump(parse_script(sql, dialect), stdout, indent=2, ensure_ascii=False)
    print(file=stdout)
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:], sys.stdin, sys.stdout, sys.stderr))
