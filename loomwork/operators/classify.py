"""Which engine code is for, by scored rules. Patterns are literals of the plan, so each is compiled once."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import found
from ..functions.rules import ENGINE_RULES

#: Pieces of evidence shown, and characters of each (fixed values).
SHOWN, SHOWN_CHARS = 8, 30
#: How each pattern is read by the JVM: letter case aside, lines by line feed, classes by Unicode.
FLAGS = "(?dUim)"

Rules = list[tuple[str, str, int]]


def usable(rules: Rules) -> Rules:
    """The rules whose pattern is valid; the others are skipped."""
    out = []
    for r in rules:
        try:
            re.compile(r[1])
        except re.error:
            continue
        out.append(r)
    return out


def families(rules: Rules) -> list[str]:
    return list(dict.fromkeys(r[0] for r in rules))


def _prepared(df: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(key), t.alias("_t"), F.lower(t).alias("_low"))


def _hit(pattern: str) -> Column:
    return found(F.col("_t"), F.col("_low"), pattern, FLAGS)


def _score(rules: Rules) -> Column:
    return sum((F.when(_hit(p), s).otherwise(0) for _, p, s in rules), F.lit(0)).cast("long")


def _evidence(rules: Rules) -> Column:
    shown = []
    for _, p, s in rules:
        group = 1 if re.compile(p).groups else 0
        hit = F.concat(F.substring(F.regexp_extract("_t", FLAGS + p, group), 1, SHOWN_CHARS), F.lit(f" (+{s})"))
        shown.append(F.when(_hit(p), hit))
    return F.array_join(F.slice(F.array_compact(F.array(*shown)), 1, SHOWN), "; ")


def scores(df: DataFrame, key: str, text: str, rules: Rules = ENGINE_RULES, evidence: bool = False) -> DataFrame:
    """key, family, ordinal, score (and evidence): one row per file and family that scores; each rule counts once. One scan, no join."""
    rules, rows = usable(rules), []
    for i, fam in enumerate(families(rules)):
        own = [r for r in rules if r[0] == fam]
        rows.append(F.struct(F.lit(fam).alias("family"), F.lit(i).alias("ordinal"), _score(own).alias("score"), *([_evidence(own).alias("evidence")] if evidence else [])))
    return _prepared(df, key, text).select(key, F.inline(F.array(*rows))).filter("score > 0")


def best(df: DataFrame, key: str, text: str, rules: Rules = ENGINE_RULES) -> DataFrame:
    """key, family, score: the family that scores highest (ties by rule order), ``unknown`` if none. Row by row, without a shuffle."""
    rules = usable(rules)
    per = [
        F.struct(_score([r for r in rules if r[0] == fam]).alias("score"), F.lit(-i).alias("o"), F.lit(fam).alias("family"))
        for i, fam in enumerate(families(rules))
    ]
    top = _prepared(df, key, text).select(key, F.array_max(F.array(*per)).alias("_b"))
    return top.select(key, F.when(F.col("_b.score") > 0, F.col("_b.family")).otherwise("unknown").alias("family"), F.col("_b.score").alias("score"))
