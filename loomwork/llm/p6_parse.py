"""Source files that do not parse: packrat grammars per language, the place and cause of failure, and rates."""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grammars import json_lang, python_lang, shell_lang, sql_lang
from .peg import LexError

#: Language of a file by its extension (fixed values).
LANGUAGES = {"py": "python", "sql": "sql", "hql": "sql", "sh": "shell", "json": "json"}
PARSERS = {"json": json_lang, "python": python_lang, "sql": sql_lang, "shell": shell_lang}
_MARKER = re.compile(r"(?m)^(?:<{7}|>{7}|\|{7}|={7})(?:[ \t].*)?\r?$")
#: Calls of grammar rules that one token can nest at most; the recursion limit grows with the text.
CALLS = 60


class Verdict(NamedTuple):
    valid: bool
    line_no: int | None = None
    column_no: int | None = None
    cause: str | None = None
    detail: str | None = None


def _fail(text: str, at: int, lang: str, open_ended: bool, detail: str) -> Verdict:
    line, col = text.count("\n", 0, at) + 1, at - (text.rfind("\n", 0, at) + 1) + 1
    marks = [text.count("\n", 0, m.start()) + 1 for m in _MARKER.finditer(text)]
    starts = [m[0][0] for m in _MARKER.finditer(text)]
    if "<" in starts and ">" in starts and any(m <= line + 1 for m in marks):
        cause = "merge conflict"
    elif other := next((o for o in PARSERS if o != lang and (o != "shell" or text.startswith("#!")) and _valid(text, o)), None):
        cause, detail = "wrong extension", f"valid {other}"
    elif open_ended or not text[at:].strip():
        cause = "cut off"
    else:
        cause = "syntax"
    return Verdict(False, line, col, cause, detail)


def _valid(text: str, lang: str) -> bool:
    p = PARSERS[lang]
    try:
        return bool(text.strip()) and p.GRAMMAR.accepts(p.tokens(text))
    except LexError:
        return False


def check(text: str, lang: str) -> Verdict:
    """Whether the text is valid as a whole for the language, else where it fails furthest and why.

    Empty texts are valid but for JSON.
    """
    p = PARSERS[lang]
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + CALLS * (len(text) + 1)))
    try:
        toks = p.tokens(text)
    except LexError as e:
        return _fail(text, e.at, lang, e.open_ended, e.why)
    if p.GRAMMAR.accepts(toks):
        return Verdict(True)
    far, want = p.GRAMMAR.furthest(toks)
    names = {"KEY", "OP", "NAME", "WORD"}
    shown = ", ".join(sorted(w if w in names else w for w in want)[:8])
    return _fail(text, toks[far].at, lang, toks[far].kind in ("EOF", "DEDENT"), f"wanted {shown}")


def parse_files(files: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """One row per file with a text in a known language.

    Columns: file_id, file_path, repo (of repo_id, else the directory after
    /srv/git/), language, valid, line_no, column_no (where no rule got
    further), cause (merge conflict, wrong extension, cut off, syntax), detail,
    hinted (whether a migration result of the path told errors; null without
    hints). Null texts and unknown extensions are no case. Files of the same
    text and language in a batch are parsed once.
    """
    src = files.select(
        F.col("file_id").cast("long").alias("file_id"),
        "file_path",
        F.coalesce(F.col("repo_id").cast("string"), F.regexp_extract("file_path", "^/srv/git/([^/]+)/", 1)).alias("repo"),
        F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"),
        F.col("raw_code").alias("text"),
    ).filter(F.col("text").isNotNull() & F.col("ext").isin(*LANGUAGES))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[bytes, Verdict] = {}
            lang = b["ext"].map(LANGUAGES)
            rows = []
            for t, g in zip(b["text"], lang, strict=True):
                key = hashlib.blake2b(f"{g}\0{t}".encode("utf-8", "replace"), digest_size=16).digest()
                if key not in seen:
                    seen[key] = check(t, g)
                rows.append(seen[key])
            out = pd.DataFrame(rows, columns=Verdict._fields).astype({"line_no": "Int32", "column_no": "Int32"})
            yield pd.concat([b[["file_id", "file_path", "repo"]].reset_index(drop=True), lang.rename("language").reset_index(drop=True), out], axis=1)

    out = src.mapInPandas(parse, "file_id long, file_path string, repo string, language string, valid boolean, line_no int, column_no int, cause string, detail string")
    if hints is None:
        return out.withColumn("hinted", F.lit(None).cast("boolean"))
    told = hints.groupBy("file_path").agg(F.max(F.coalesce(F.size("errors") > 0, F.lit(False))).alias("hinted"))
    return out.join(told, "file_path", "left").select(*out.columns, "hinted")


def rates(parsed: DataFrame) -> DataFrame:
    """Files, invalid files and their rate per repository and language."""
    bad = F.count_if(~F.col("valid"))
    return parsed.groupBy("repo", "language").agg(
        F.count("*").alias("files"), bad.alias("invalid"), (bad / F.count("*")).alias("rate")
    )
