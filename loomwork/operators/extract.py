"""SQL statements in code files: found, cleaned, checked and typed."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import DIALECTS, SHELL_RUNNERS, SQL_CALLS, SQL_INSIDE, SQL_NAMES, SQL_STARTS

#: Statements shorter than this are none (fixed value).
LEAST = 10
SCHEMA = "source_file string, ordinal int, sql string, line_start int, line_end int, sql_type string, context string"

_LONG = [(q, re.compile(rf"{q}(.*?){q}", re.S)) for q in ('"""', "'''")]
_QUOTED = r"\"((?:[^\"\\]|\\.)*+)\"|'((?:[^'\\]|\\.)*+)'"
_PY = [
    re.compile(rf"(?:(?P<name>\w*(?:{SQL_NAMES}))\s*=\s*[fFrR]?|\.(?:{SQL_CALLS})\s*\(\s*[fFrR]?)(?:\"\"\"(?P<a>.*?)\"\"\"|'''(?P<b>.*?)''')", re.S | re.I),
    re.compile(rf"(?:(?P<name>\w*(?:{SQL_NAMES}))\s*=\s*|\.(?:{SQL_CALLS})\s*\(\s*)(?!\"\"\"|''')(?:\"(?P<a>(?:[^\"\\\n]|\\.)*+)\"|'(?P<b>(?:[^'\\\n]|\\.)*+)')", re.I),
]
_SH = [
    *(re.compile(rf"\b{re.escape(cmd)}\s+(?:[^\n\"']*?\s)?{flag}\s+(?:\"(?P<a>.*?)\"|'(?P<b>.*?)')", re.S) for cmd, flag in SHELL_RUNNERS),
    re.compile(r"\b(?:hive|beeline|impala-shell|spark-sql)\s*<<(?P<dash>-?)\s*['\"]?(?P<tag>\w+)['\"]?[ \t]*\n(?P<a>.*?)\n[ \t]*(?P=tag)[ \t]*(?=\n|$)(?P<b>)", re.S),
    re.compile(r"(?P<name>\w*(?:SQL|HQL|QUERY))\s*=\s*(?:\"(?P<a>.*?)\"|'(?P<b>.*?)')", re.S | re.I),
]


def clean(sql: str) -> str:
    """Written escapes undone, blanks collapsed, blank lines dropped."""
    for a, b in (("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\'", "'")):
        sql = sql.replace(a, b)
    return re.sub(r"\n\s*\n", "\n", re.sub(r"[ \t]+", " ", sql.strip())).strip()


def is_statement(sql: str) -> bool:
    up = sql.strip().upper()
    return len(up) >= LEAST and (up.startswith(tuple(SQL_STARTS)) or any(w in up for w in SQL_INSIDE))


def dialect_of(sql: str) -> str:
    up = sql.upper()
    return next((d for d, words in DIALECTS if any(w in up for w in words)), "generic")


def split_statements(text: str) -> list[str]:
    """Parts between semicolons outside quotes; a backslash escapes."""
    out, start, quote, i = [], 0, "", 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == ";":
            out.append(text[start:i].strip())
            start = i + 1
        i += 1
    return [s for s in [*out, text[start:].strip()] if s]


#: A quoted value, which is kept, or a remark.
_REMARK = re.compile(r"'(?:[^'\\]|\\.)*+'|\"(?:[^\"\\]|\\.)*+\"|(?P<remark>--[^\n]*|/\*.*?\*/)", re.S)


def strip_comments(text: str) -> str:
    """The text without remarks; what looks like one within quotes stays."""
    return _REMARK.sub(lambda m: "" if m["remark"] else m[0], text)


def _places(text: str) -> Callable[[int], int]:
    """Where a character of the text without comments stands in the text."""
    after, shift, gone = [], [], 0
    for m in _REMARK.finditer(text):
        if m["remark"]:
            after.append(m.start() - gone)
            gone += m.end() - m.start()
            shift.append(gone)

    def place(at: int) -> int:
        k = bisect.bisect_right(after, at)
        return at + (shift[k - 1] if k else 0)

    return place


def _found(text: str, patterns: list[re.Pattern], loose: bool) -> Iterator[tuple[str, int, int, str]]:
    seen = set()
    for p in patterns:
        for m in p.finditer(text):
            sql = clean(m["a"] if m["a"] is not None else m["b"] or "")
            key = (sql, m.start("a") if m["a"] is not None else m.start("b"))
            if is_statement(sql) and key not in seen:
                seen.add(key)
                yield sql, m.start(), m.end(), (m.groupdict().get("name") or "")
    if loose:
        known = {k[0] for k in seen}
        for _, p in _LONG:
            for m in p.finditer(text):
                sql = clean(m[1])
                if is_statement(sql) and sql not in known:
                    known.add(sql)
                    yield sql, m.start(), m.end(), ""


def statements_of(text: str, kind: str) -> list[tuple[str, int, int, str, str]]:
    """(sql, first line, last line, dialect, name it is given to) of a file: py, sh, sql or hql; others as py and sh, else sql."""
    rows = []
    line = lambda at: text.count("\n", 0, at) + 1
    if kind == "py":
        found = list(_found(text, _PY, True))
    elif kind == "sh":
        found = list(_found(text, _SH, False))
    elif kind in ("sql", "hql"):
        found = []
    else:
        found = [*_found(text, _PY, True), *_found(text, _SH, False)]
    if kind in ("sql", "hql") or kind not in ("py", "sh") and not found:
        bare, place, at = strip_comments(text), _places(text), 0
        for raw in split_statements(bare):
            start = bare.index(raw, at)  # only white space and semicolons stand before it
            at = start + len(raw)
            sql = clean(raw)
            if is_statement(sql):
                rows.append((sql, line(place(start)), line(place(at - 1)), dialect_of(sql), "stmt"))
        return rows
    for sql, a, b, name in found:
        rows.append((sql, line(a), line(b), dialect_of(sql), name))
    return sorted(rows, key=lambda r: (r[1], r[2], r[0]))


def extract(files: DataFrame, path: str, text: str) -> DataFrame:
    """One row per statement found in the files (SCHEMA). Null texts have none. A map, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, t in zip(b["path"], b["text"], strict=True):
                kind = (p or "").rsplit(".", 1)[-1].lower()
                rows += [(p, i, *r) for i, r in enumerate(statements_of(t, kind), 1)]
            yield pd.DataFrame(rows, columns=["source_file", "ordinal", "sql", "line_start", "line_end", "sql_type", "context"])

    return files.select(F.col(path).alias("path"), F.col(text).alias("text")).filter("text <> ''").mapInPandas(run, SCHEMA)


def dialect(sql: Column) -> Column:
    """The dialect of a statement by words in it; the first dialect that has one."""
    up, out = F.upper(sql), None
    for name, words in DIALECTS:
        hit = F.coalesce(up.rlike("|".join(words)), F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("generic")


def valid(sql: Column) -> Column:
    up = F.upper(F.trim(sql))
    return (F.length(up) >= LEAST) & (up.rlike("^(?:" + "|".join(SQL_STARTS) + ")") | up.rlike("|".join(SQL_INSIDE)))


def summary(files: DataFrame, statements: DataFrame, path: str) -> DataFrame:
    """One row: files, with and without SQL, statements."""
    per = statements.groupBy(F.col("source_file").alias(path)).agg(F.count("*").alias("n"))
    return files.select(path).distinct().join(per, path, "left").agg(
        F.count("*").alias("files"), F.count("n").alias("with_sql"), (F.count("*") - F.count("n")).alias("without_sql"), F.coalesce(F.sum("n"), F.lit(0)).alias("statements")
    )


def outcomes(files: DataFrame, path: str, text: str) -> DataFrame:
    """One row: files of a directory, with and without SQL, skipped (extensions that hold none), errors (no text), statements."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    kinds = files.select(F.col(path).alias("path"), F.col(text).alias("text"), ext.isin("sql", "hql", "py", "sh").alias("taken"))
    found = extract(kinds.filter("taken"), "path", "text").groupBy("source_file").agg(F.count("*").alias("n"))
    per = kinds.join(found.withColumnRenamed("source_file", "path"), "path", "left")
    good = F.col("taken") & F.col("text").isNotNull()
    return per.agg(
        F.count("*").alias("files"), F.count_if(good & F.col("n").isNotNull()).alias("with_sql"), F.count_if(good & F.col("n").isNull()).alias("without_sql"),
        F.count_if(~F.col("taken")).alias("skipped"), F.count_if(F.col("taken") & F.col("text").isNull()).alias("errors"), F.coalesce(F.sum("n"), F.lit(0)).alias("statements"),
    )
