"""Tokens of the query language."""

from __future__ import annotations

import re
from typing import NamedTuple


class ParseError(ValueError):
    """The text isn't a statement or expression of the language."""


class Token(NamedTuple):
    kind: str  # word, int, double, string, op, end
    text: str
    value: object
    at: int
    spaced: bool  # white space before it


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_PATTERN = re.compile(
    r"""(?P<blank>\s+|--[^\n]*)
      | (?P<double>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)
      | (?P<int>\d+)
      | (?P<word>[A-Za-z_\u0080-￿$][\w$]*)
      | (?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")
      | (?P<op>=>|!=|>=|<=|[-+*/%=<>(){}\[\],.:;@])""",
    re.X | re.S,
)


def _unquote(text: str) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        return chr(int(c[1:], 16)) if c[0] == "u" and len(c) == 5 else _ESCAPES.get(c, c)

    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", one, text[1:-1], flags=re.S)


def tokenize(text: str) -> list[Token]:
    """All tokens of ``text``, with one of kind ``end`` last."""
    out, at, spaced = [], 0, False
    while at < len(text):
        m = _PATTERN.match(text, at)
        if not m:
            raise ParseError(f"unexpected character {text[at]!r} at {at}")
        kind, s = m.lastgroup, m[0]
        if kind == "word" and s.startswith("$") and len(s) == 1:
            kind = "op"
        if kind == "blank":
            spaced = True
        else:
            value = int(s) if kind == "int" else float(s) if kind == "double" else _unquote(s) if kind == "string" else s
            out.append(Token(kind, s, value, at, spaced))
            spaced = False
        at = m.end()
    out.append(Token("end", "", None, at, spaced))
    return out
