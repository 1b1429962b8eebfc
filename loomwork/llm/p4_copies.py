"""Duplicates hidden by formatting: one canonical key per text, and skew-proof counting of keys."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import hot_bound
from ..session import stage

#: Keys are hot from this many rows, or this share of all rows if that is more: at most 1 / HOT_SHARE keys are hot.
HOT_ROWS, HOT_SHARE, SALTS = 8, 0.001, 64
#: Characters up to which a part of a canonical text is kept as it is.
LONG = 1000

_TOKEN = re.compile(
    r"""(?xs)
      (?P<space>\s+)
    | (?P<line>--[^\n]*) | (?P<block>/\*.*?(?:\*/|\Z))
    | (?P<quoted>'(?:[^'\\]|\\.|'')*(?:'|\Z) | "(?:[^"\\]|\\.|"")*(?:"|\Z))
    | `(?P<name>[^`]*)`
    | (?P<word>[\w$]+) | (?P<op><=>|<>|!=|<=|>=|\|\||&&|::|==|->|=>) | (?P<other>.)
    """
)
_LIST_END = frozenset("from where group having order limit union intersect except minus window distribute sort cluster lateral ;".split())
_GROUP_END = frozenset("having order limit union intersect except minus window distribute sort cluster qualify with ;".split())


def _short(s: str) -> str:
    """A part of a canonical text; a long one by its digest, so that nested parts are not copied again and again."""
    return s if len(s) <= LONG else "\x02" + hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=32).hexdigest()


def _sorted_items(tokens: list[str], at: int, stop: frozenset) -> tuple[str, int]:
    items, item = [], []
    while at < len(tokens) and tokens[at] not in stop:
        if tokens[at] == ",":
            items.append(_short(" ".join(item)))
            item = []
        else:
            item.append(tokens[at])
        at += 1
    items.append(_short(" ".join(item)))
    return " , ".join(sorted(items)), at


def _canon(tokens: list[str]) -> str:
    """Tokens of one pair of parentheses, with the items of its select and GROUP BY lists in order."""
    out, at = [], 0
    while at < len(tokens):
        t = tokens[at]
        if t == "select":
            out.append(t)
            at += 1
            while at < len(tokens) and tokens[at] in ("distinct", "all"):
                out.append(tokens[at])
                at += 1
            items, at = _sorted_items(tokens, at, _LIST_END)
            out.append(items)
        elif t == "group" and at + 1 < len(tokens) and tokens[at + 1] == "by":
            items, at = _sorted_items(tokens, at + 2, _GROUP_END)
            out.append(f"group by {items}")
        else:
            out.append(t)
            at += 1
    return " ".join(out)


def canonical(sql: str) -> str:
    """The statement without what does not count.

    White space and letter case outside quoted values, back quotes round names,
    closing semicolons, and the order of items in select and GROUP BY lists (of
    subqueries too) are disregarded; operators, numbers, quoted values, the
    order of conditions and the words of comments count. Parentheses may be
    nested to any depth; ones that are never closed stay open. Long parts are
    given by their digests.
    """
    open_: list[list[str]] = [[]]
    for m in _TOKEN.finditer(sql):
        kind = m.lastgroup
        if kind == "space":
            continue
        t = m[kind]
        if kind in ("line", "block"):
            mark, body = t[:2], t[2:]
            if kind == "block" and body.endswith("*/"):
                body = body[:-2]
            open_[-1].append("\x01" + " ".join([mark, *re.findall(r"\w+|[^\w\s]", body.lower())]))
        elif kind == "quoted":
            open_[-1].append("\x01" + t)
        elif t == "(":
            open_.append([])
        elif t == ")" and len(open_) > 1:
            inner = open_.pop()
            open_[-1].append(_short(f"( {_canon(inner)} )"))
        else:
            open_[-1].append(t.lower())
    while open_[-1] and open_[-1][-1] == ";":
        open_[-1].pop()
    while len(open_) > 1:
        inner = open_.pop()
        open_[-1].append(_short(f"( {_canon(inner)}"))
    return _canon(open_[0])


@F.pandas_udf(T.BinaryType())
def canonical_key(sql: pd.Series) -> pd.Series:
    return sql.map(lambda s: hashlib.blake2b(canonical(s).encode("utf-8", "replace"), digest_size=16).digest())


def keyed(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """id, key of each row with a text; null and blank texts state nothing and take no part."""
    t = df.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("t")).filter(r"t rlike '\\S'")
    return t.select("id", canonical_key("t").alias("key"))


def collapse(keys: DataFrame, hot_rows: int = HOT_ROWS, hot_share: float = HOT_SHARE, salts: int = SALTS) -> tuple[DataFrame, DataFrame, list[bytes]]:
    """(hot, rest, hot keys): one row per key with keep_id (its smallest id) and copies (its rows).

    Exact counts, combined before the shuffle, tell the hot keys; their number
    is bounded by the share. Hot rows are grouped by key and salt, then by key;
    the others by one shuffle.
    """
    counts = stage(keys.groupBy("key").agg(F.count("*").alias("n")), "counts")
    bound = hot_bound(counts, "n", hot_rows, hot_share)
    hot_keys = [bytes(r[0]) for r in counts.filter(F.col("n") >= bound).select("key").collect()]
    best = (F.min("id").alias("keep_id"), F.count("*").alias("copies"))
    is_hot = _among(hot_keys)
    rest = keys.filter(~is_hot).groupBy("key").agg(*best)
    salted = keys.filter(is_hot).groupBy("key", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(*best)
    hot = salted.groupBy("key").agg(F.min("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))
    return hot, rest, hot_keys


def _among(keys: list[bytes]) -> F.Column:
    return F.col("key").isin(keys) if keys else F.lit(False)


def statements(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """One row per distinct statement: keep_id, copies, and its text as the kept row writes it."""
    hot, rest, _ = collapse(stage(keyed(df, row_id, text), "keys"))
    kept = hot.union(rest).select("keep_id", "copies")
    src = df.select(F.col(row_id).cast("long").alias("keep_id"), F.col(text).alias("text")).dropDuplicates(["keep_id"])
    return kept.join(src, "keep_id").select("keep_id", "copies", "text")


def copies(df: DataFrame, row_id: str, text: str, **skew) -> DataFrame:
    """keep_id, copy_id: each further row of a group with the group's smallest id.

    The few hot groups reach their rows by broadcast (their number is bounded),
    and their rows are not shuffled; the others meet by a join on the key. A row id that occurs twice is one row.
    """
    keys = stage(keyed(df, row_id, text), "keys")
    hot, rest, hot_keys = collapse(keys, **skew)
    met = keys.filter(_among(hot_keys)).join(F.broadcast(hot), "key"), keys.filter(~_among(hot_keys)).join(rest.filter("copies > 1").hint("merge"), "key")
    return met[0].union(met[1]).filter("id <> keep_id").select("keep_id", F.col("id").alias("copy_id")).distinct()
