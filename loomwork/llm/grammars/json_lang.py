"""JSON (RFC 8259)."""

from __future__ import annotations

import re

from ..peg import Grammar, LexError, Token

GRAMMAR = Grammar("""
file <- value EOF
value <- object / array / STRING / NUMBER / 'true' / 'false' / 'null'
object <- '{' (member (',' member)*)? '}'
%member <- STRING ':' value
array <- '[' (value (',' value)*)? ']'
""")
_TOKEN = re.compile(r'(?P<space>[ \t\r\n]+)|(?P<STRING>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<NUMBER>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<WORD>true|false|null)(?!\w)|(?P<OP>[{}\[\],:])', re.A)


def tokens(text: str) -> list[Token]:
    out, at = [], 1 if text.startswith("﻿") else 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise LexError(at, "unterminated or bad string" if text[at] == '"' else "bad character", text[at] == '"' and "\n" not in text[at:])
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0] if m.lastgroup in ("OP", "WORD") else "", at))
        at = m.end()
    return [*out, Token("EOF", "", len(text))]
