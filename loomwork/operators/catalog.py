"""The catalogs of changes as tables, with look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalogs as C

SCHEMA = "kind string, category string, old string, new string, version string, severity string, is_regex boolean, auto_fixable boolean"


def changes(spark: SparkSession, kind: str | None = None, category: str | None = None, upto: str | None = None, severity: str | None = None, fixable: bool | None = None) -> DataFrame:
    """All catalog rows (SCHEMA), filtered; versions are compared by number."""
    rows = [("api", c, o, n, v, None, False, True) for c, o, n, v in C.API_CHANGES]
    rows += [("config", c, o, n, v, None, False, f) for c, o, n, v, _, f in C.CONFIG_CHANGES]
    rows += [("deprecation", c, o, n, v, s, True, False) for c, o, n, v, s in C.DEPRECATIONS]
    rows += [("syntax", c, o, n, v, None, r, f) for c, o, n, v, r, f in C.SYNTAX_CHANGES]
    number = lambda v: tuple(int(x) for x in v.split("."))
    keep = [
        r
        for r in rows
        if kind in (None, r[0]) and category in (None, r[1]) and (upto is None or number(r[4]) <= number(upto)) and severity in (None, r[5]) and fixable in (None, r[7])
    ]
    return spark.createDataFrame(keep, SCHEMA)


def renames(spark: SparkSession) -> DataFrame:
    """kind, old, new, change (renamed, removed, same) of everything a workflow definition may name."""
    tables = {"module": C.MODULES, "class": C.CLASSES, "operator": C.OPERATORS, "dag_param": C.DAG_PARAMS, "operator_param": C.OPERATOR_PARAMS, "context": C.CONTEXT, "template": C.TEMPLATES, "connection": C.CONNECTIONS}
    rows = [(k, o, n) for k, t in tables.items() for o, n in t] + [(f"section {s}", o, n) for s, o, n in C.SECTIONS]
    change = F.when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "same").otherwise("renamed")
    return spark.createDataFrame(rows, "kind string, old string, new string").withColumn("change", change)


def new_params(params: Column, table: list[tuple] = C.DAG_PARAMS) -> Column:
    """A map of parameters under their new names; those that are gone or unknown drop out."""
    known = F.create_map(*(F.lit(x) for old, new in table if new is not None for x in (old, new)))
    return F.transform_keys(F.map_filter(params, lambda k, _: F.map_contains_key(known, k)), lambda k, _: F.element_at(known, k))


def new_templates(text: Column) -> Column:
    """Template variables under their new names, blanks inside the braces aside."""
    for old, new in C.TEMPLATES:
        if old != new:
            word = old.strip("{} ")
            text = F.regexp_replace(text, r"\{\{\s*" + word + r"\s*\}\}", new)
    return text


def new_import(line: Column, table: list[tuple] = C.MODULES) -> Column:
    """``from module import x`` or ``import module`` with the module's new place; a module that is gone makes it a remark; others stay."""
    module = F.coalesce(F.nullif(F.regexp_extract(line, r"^\s*from\s+([\w.]+)\s+import\b", 1), F.lit("")), F.regexp_extract(line, r"^\s*import\s+([\w.]+)", 1))
    known = F.create_map(*(x for old, new in table for x in (F.lit(old), F.lit(new).cast("string"))))
    new = F.try_element_at(known, module)
    return F.when(~F.map_contains_key(known, module), line).when(new.isNull(), F.concat(F.lit("# REMOVED: "), line)).otherwise(F.replace(line, module, new))


def deprecated_hits(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pattern, severity, hits of every catalogued deprecation in a text; patterns are literals of the plan."""
    found = F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(s).alias("severity"), F.regexp_count(text, F.lit(p)).alias("hits")) for _, p, _, _, s in C.DEPRECATIONS))
    return df.filter(F.col(text).isNotNull()).select(F.col(key), F.inline(found)).filter("hits > 0")
