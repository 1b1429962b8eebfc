"""Ordered text rewrites of code, with the changes and warnings they make."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import CLASS_RENAMES, MODULE_MOVES, PARAM_RENAMES, PROVIDERS, SPARK_REWRITES


def ordered(rules: list[tuple] = SPARK_REWRITES, version: str | None = None) -> list[tuple]:
    """Rules by falling priority, then as they stand; only those up to a version, compared by number."""
    key = lambda v: tuple(int(x) for x in v.split("."))
    return [r for _, r in sorted(enumerate(rules), key=lambda x: (-x[1][3], x[0])) if version is None or key(r[4]) <= key(version)]


def _count(text: Column, pattern: str, is_regex: bool) -> Column:
    if is_regex:
        return F.regexp_count(text, F.lit(pattern))
    return ((F.length(text) - F.length(F.replace(text, F.lit(pattern), F.lit("")))) / len(pattern)).cast("int")


def _replace(text: Column, pattern: str, new: str, is_regex: bool) -> Column:
    return F.regexp_replace(text, pattern, re.sub(r"([\\$])", r"\\\1", new)) if is_regex else F.replace(text, F.lit(pattern), F.lit(new))


def fold(df: DataFrame, text: str, rules: list[tuple] = SPARK_REWRITES, version: str | None = None) -> DataFrame:
    """``df`` with rewritten (text after all rules that may be applied), changes and warnings (arrays of rule, hits).

    Rules run one after another on the text so far; a rule that may not be
    applied only warns. Null text stays null.
    """
    out, notes = df.withColumn("rewritten", F.col(text)), []
    for name, pattern, new, _, _, is_regex, may in ordered(rules, version):
        out = out.withColumn(f"_n_{name}", _count(F.col("rewritten"), pattern, is_regex))
        notes.append((name, may))
        if may:
            out = out.withColumn("rewritten", _replace(F.col("rewritten"), pattern, new, is_regex))
    hit = lambda n: F.when(F.col(f"_n_{n}") > 0, F.struct(F.lit(n).alias("rule"), F.col(f"_n_{n}").alias("hits")))
    empty = F.array().cast("array<struct<rule: string, hits: int>>")
    gather = lambda may: F.array_compact(F.array(*(hit(n) for n, m in notes if m == may))) if any(m == may for _, m in notes) else empty
    return out.withColumns({"changes": gather(True), "warnings": gather(False)}).drop(*(f"_n_{n}" for n, _ in notes))


def move_modules(text: Column, moves: list[tuple] = MODULE_MOVES) -> Column:
    """Import paths moved, the longest first and only whole paths; lines that import a module that is gone become remarks."""
    for old, new in sorted(moves, key=lambda m: (-len(m[0]), m[0])):
        path = re.escape(old)
        if new is None:
            text = F.regexp_replace(text, rf"(?m)^(?=[^#\n]*(?<![\w.]){path}(?![\w.]))", "# REMOVED: ")
        else:
            text = F.regexp_replace(text, rf"(?<![\w.]){path}(?![\w.])", new)
    return text


def rename_classes(text: Column, renames: list[tuple] = CLASS_RENAMES) -> Column:
    for old, new in renames:
        text = F.regexp_replace(text, rf"\b{old}\b", new)
    return text


def rename_params(text: Column, renames: list[tuple] = PARAM_RENAMES) -> Column:
    for pattern, new in renames:
        text = F.regexp_replace(text, pattern, new)
    return text


def ensure_import(text: Column, name: str, line: str) -> Column:
    """``line`` after the last import if ``name`` is used but never imported."""
    lines = F.split(text, "\n")
    last = F.array_max(F.transform(lines, lambda s, i: F.when(s.rlike(r"^(?:import|from) "), i).otherwise(-1)))
    put = F.concat_ws("\n", F.concat(F.slice(lines, F.lit(1), last + 1), F.array(F.lit(line)), F.slice(lines, last + 2, F.size(lines))))
    return F.when(text.rlike(rf"\b{name}\b") & ~text.rlike(rf"(?m)^(?:import|from) .*\b{name}\b"), put).otherwise(text)


def upgrade_flows(df: DataFrame, text: str) -> DataFrame:
    """``df`` with rewritten workflow definitions: modules, classes, parameters, then missing imports."""
    t = rename_params(rename_classes(move_modules(F.col(text))))
    return df.withColumn("rewritten", ensure_import(t, "EmptyOperator", "from airflow.operators.empty import EmptyOperator"))


def providers(df: DataFrame, module: str) -> DataFrame:
    """``df`` with provider: the package of the first prefix that fits, null if none. Prefixes are literals of the plan."""
    out = None
    for prefix, package in PROVIDERS:
        hit = F.col(module).startswith(prefix)
        out = F.when(hit, package) if out is None else out.when(hit, package)
    return df.withColumn("provider", out)


def moved(df: DataFrame, module: str, moves: list[tuple] = MODULE_MOVES) -> DataFrame:
    """``df`` with new_module and kind (moved, removed, unknown)."""
    table = F.create_map(*(x for old, new in moves for x in (F.lit(old), F.lit(new).cast("string"))))
    known = F.map_contains_key(table, F.col(module))
    new = F.try_element_at(table, F.col(module))
    return df.withColumns({"new_module": new, "kind": F.when(~known, "unknown").when(new.isNull(), "removed").otherwise("moved")})
