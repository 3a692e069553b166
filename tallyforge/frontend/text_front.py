"""A generic text adapter: tokens of any prose by an ASCII pattern, no structure. No file extension leads to it."""

from __future__ import annotations

import re

from .ir import CODE_PUNCTUATION, Node, Token

#: Fixed value: the pattern, the same in Java, RE2 and Python.
PATTERN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^A-Za-z0-9_ \t\r\n]"
_RE = re.compile(PATTERN)


def kind(text: str) -> str:
    c = text[0]
    if c == "_" or ("a" <= c.lower() <= "z" and c.isascii()):
        return "identifier"
    return "literal" if "0" <= c <= "9" else "punctuation" if c in CODE_PUNCTUATION else "operator"


def parse(source: bytes) -> tuple[Node, list[Token]]:
    text, tokens, at, last = source.decode("utf-8", "replace"), [], 0, 0
    for m in _RE.finditer(text):
        at += len(text[last : m.start()].encode())
        last = m.start()
        tokens.append(Token(kind(m[0]), m[0], at, at + len(m[0].encode())))
    return Node("other", 0, len(source)), tokens
