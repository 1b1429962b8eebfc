"""Regular expressions that are spared where a plain look for a substring tells that they cannot match."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_of(pattern: str) -> str:
    """The longest text, in lower case, that every match of the pattern holds letter case aside; empty if none is sure.

    Only what stands outside groups, classes and alternatives counts, and not
    what may be left out.
    """
    runs, run, i, depth = [], "", 0, 0

    def close() -> None:
        nonlocal run
        runs.append(run)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            nxt, i = pattern[i + 1], i + 2
            if depth:
                continue
            if nxt.isalnum():
                close()
            else:
                run += nxt
            continue
        i += 1
        if c == "[":
            end = i + (pattern[i : i + 1] == "^")
            end = pattern.index("]", end + 1)
            i = end + 1
            close()
        elif c == "(":
            depth += 1
            close()
        elif c == ")":
            depth -= 1
            close()
        elif depth:
            continue
        elif c == "|":
            return ""
        elif c in "?*{":
            run = run[:-1]
            close()
            if c == "{":
                i = pattern.index("}", i) + 1
        elif c in ".^$+":
            close()
        else:
            run += c
    close()
    best = max(runs, key=len)
    return best.lower() if best.isascii() else ""


def may_match(low: Column, pattern: str) -> Column:
    """Whether a text, given in lower case, holds what every match of the pattern holds."""
    need = literal_of(pattern)
    return F.contains(low, F.lit(need)) if len(need) > 1 else F.lit(True)


def found(text: Column, low: Column, pattern: str, flags: str) -> Column:
    """Whether the pattern occurs, letter case aside."""
    return may_match(low, pattern) & text.rlike(flags + pattern)


