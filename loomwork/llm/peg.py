"""Packrat parsing-expression grammars: grammar text in, recogniser over tokens out.

Grammar text has one rule a line group: ``name <- expression``. Expressions are
``a b`` (sequence), ``a / b`` (ordered choice), ``a? a* a+ &a !a`` and
parentheses. ``'x'`` takes a token whose text is x, ``WORD`` in capitals a token
of that kind, other names call rules. ``%name`` defines a rule without memory
(for rules that never run twice at one place). The first rule is the start; a
text is valid only if it takes all tokens, the last of which has kind EOF.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str
    text: str
    at: int


class LexError(Exception):
    """The text cannot be cut into tokens from ``at`` on; ``open_ended`` if something was never closed."""

    def __init__(self, at: int, why: str, open_ended: bool = False):
        super().__init__(why)
        self.at, self.why, self.open_ended = at, why, open_ended


_LEX = re.compile(r"\s*(?:(?P<def>%?[a-z_]\w*)\s*<-|'(?P<lit>[^']+)'|(?P<kind>[A-Z][A-Z_]*)|(?P<rule>[a-z_]\w*)|(?P<op>[/?*+&!()]))")


def _read(grammar: str) -> dict[str, tuple[bool, tuple]]:
    toks, at = [], 0
    grammar = re.sub(r"#[^\n']*(?=\n|$)", "", grammar)
    while grammar[at:].strip():
        m = _LEX.match(grammar, at)
        if not m:
            raise ValueError(f"grammar: {grammar[at : at + 40]!r}")
        toks.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    toks.append(("end", ""))
    i, rules = 0, {}

    def choice() -> tuple:
        nonlocal i
        alts = [sequence()]
        while toks[i] == ("op", "/"):
            i += 1
            alts.append(sequence())
        return alts[0] if len(alts) == 1 else ("choice", alts)

    def sequence() -> tuple:
        nonlocal i
        parts = []
        while toks[i][0] in ("lit", "kind", "rule") or toks[i] in (("op", "("), ("op", "&"), ("op", "!")):
            parts.append(prefix())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def prefix() -> tuple:
        nonlocal i
        if toks[i] in (("op", "&"), ("op", "!")):
            kind = "and" if toks[i][1] == "&" else "not"
            i += 1
            return kind, prefix()
        kind, text = toks[i]
        i += 1
        if kind == "op":
            e = choice()
            assert toks[i] == ("op", ")"), f"grammar: ')' wanted near {toks[i]}"
            i += 1
        else:
            e = (kind, text)
        while toks[i][0] == "op" and toks[i][1] in "?*+":
            e = (toks[i][1], e)
            i += 1
        return e

    while toks[i][0] == "def":
        name = toks[i][1]
        i += 1
        rules[name.lstrip("%")] = (not name.startswith("%"), choice())
    assert toks[i][0] == "end", f"grammar: {toks[i]}"
    return rules


class Grammar:
    """A recogniser made from grammar text. It keeps no state between texts."""

    def __init__(self, text: str):
        self.rules = _read(text)
        self.start = next(iter(self.rules))
        self._fast, self._traced = (self._make(t) for t in (False, True))

    def _make(self, traced: bool):
        lines, names = ["def parse(K, T):"], iter(range(10**9))
        lines += [f"    M_{n} = {{}}" for n, (memo, _) in self.rules.items() if memo]
        if traced:
            lines += ["    far, want = [0], set()", "    def miss(p, what):", "        if p > far[0]:", "            far[0] = p; want.clear()", "        if p == far[0]:", "            want.add(what)"]

        def new() -> str:
            return f"v{next(names)}"

        def gen(e: tuple, src: str, dst: str, pad: str) -> None:
            op = e[0]
            if op in ("lit", "kind"):
                lines.append(f"{pad}{dst} = {src} + 1 if {'T' if op == 'lit' else 'K'}[{src}] == {e[1]!r} else -1")
                if traced:
                    lines.append(f"{pad}if {dst} < 0: miss({src}, {e[1]!r})")
            elif op == "rule":
                if e[1] not in self.rules:
                    raise ValueError(f"grammar: no rule {e[1]}")
                lines.append(f"{pad}{dst} = r_{e[1]}({src})")
            elif op == "seq":
                gen(e[1][0], src, dst, pad)
                for part in e[1][1:]:
                    lines.append(f"{pad}if {dst} >= 0:")
                    pad += "    "
                    at = new()
                    lines.append(f"{pad}{at} = {dst}")
                    gen(part, at, dst, pad)
            elif op == "choice":
                if not traced and all(x[0] == "lit" for x in e[1]):
                    lines.append(f"{pad}{dst} = {src} + 1 if T[{src}] in {{{', '.join(repr(x[1]) for x in e[1])}}} else -1")
                    return
                gen(e[1][0], src, dst, pad)
                for alt in e[1][1:]:
                    lines.append(f"{pad}if {dst} < 0:")
                    pad += "    "
                    gen(alt, src, dst, pad)
            elif op in ("*", "+"):
                t = new()
                if op == "+":
                    gen(e[1], src, dst, pad)
                    lines.append(f"{pad}while {dst} >= 0:")
                else:
                    lines.append(f"{pad}{dst} = {src}")
                    lines.append(f"{pad}while True:")
                gen(e[1], dst, t, pad + "    ")
                lines.append(f"{pad}    if {t} <= {dst}: break")
                lines.append(f"{pad}    {dst} = {t}")
            elif op == "?":
                gen(e[1], src, dst, pad)
                lines.append(f"{pad}if {dst} < 0: {dst} = {src}")
            elif op in ("and", "not"):
                t = new()
                gen(e[1], src, t, pad)
                lines.append(f"{pad}{dst} = {src} if {t} {'>=' if op == 'and' else '<'} 0 else -1")

        for name, (memo, e) in self.rules.items():
            lines.append(f"    def r_{name}(p):")
            if memo:
                lines.append(f"        q = M_{name}.get(p)")
                lines.append("        if q is not None: return q")
            gen(e, "p", "q", "        ")
            if memo:
                lines.append(f"        M_{name}[p] = q")
            lines.append("        return q")
        lines.append(f"    end = r_{self.start}(0)")
        lines.append("    return end, far[0], want" if traced else "    return end")
        scope: dict = {}
        exec(compile("\n".join(lines), "<grammar>", "exec"), scope)  # noqa: S102
        return scope["parse"]

    def accepts(self, tokens: list[Token]) -> bool:
        return self._fast([t.kind for t in tokens], [t.text for t in tokens]) == len(tokens)

    def furthest(self, tokens: list[Token]) -> tuple[int, list[str]]:
        """Index of the token that no rule got past, and what would have been taken there."""
        _, far, want = self._traced([t.kind for t in tokens], [t.text for t in tokens])
        return min(far, len(tokens) - 1), sorted(want)
