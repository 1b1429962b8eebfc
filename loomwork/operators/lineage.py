"""Tables that SQL names, by kind of statement; variables in names; common table expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import may_match
from ..functions.rules import NAME_PART, SQL_WORDS, STATEMENTS

VARIABLE = r"\$\{[A-Za-z_]\w*\}|\$[A-Za-z_]\w*|\{[A-Za-z_]\w*\}"


#: A quoted value (kept), or a remark; what is never closed goes to the end of its line or text.
_QUOTED_OR_REMARK = r"('(?:[^'\\]|\\.|'')*+'|\"(?:[^\"\\]|\\.|\"\")*+\")|--[^\n]*|(?s)/\*.*?\*/"


def without_comments(sql: Column) -> Column:
    """The text without remarks; what looks like one within quotes stays."""
    return F.regexp_replace(sql, _QUOTED_OR_REMARK, "$1")


def without_code(text: Column) -> Column:
    """Python and shell lines that are no SQL (imports, shebang, # remarks) blanked out."""
    for p in (r"(?m)^[ \t]*import [^\n]+", r"(?m)^[ \t]*from [A-Za-z_][\w.]* import [^\n]+", r"(?m)^[ \t]*#[^\n]*"):
        text = F.regexp_replace(text, p, "")
    return text


def clean_name(name: Column) -> Column:
    return F.regexp_replace(name, '[`"]', "")


def is_variable(name: Column) -> Column:
    return name.rlike(VARIABLE)


def variables(text: Column) -> Column:
    """Variable tokens in order: array of struct(kind, name, full)."""
    full = F.regexp_extract_all(text, F.lit(f"({VARIABLE})"), F.lit(1))
    return F.transform(
        full,
        lambda v: F.struct(F.when(v.startswith("{"), "python").otherwise("shell").alias("kind"), F.regexp_replace(v, r"[${}]", "").alias("name"), v.alias("full")),
    )


def definitions(text: Column, kind: str) -> Column:
    """Map of assigned variables; the last assignment holds. kind: py (quoted values) or sh (no substitutions)."""
    pat = r"(?m)^[ \t]*([A-Za-z_]\w*)[ \t]*=[ \t]*[\"']([^\"'\n]*)[\"'][ \t]*$" if kind == "py" else r"(?m)^[ \t]*([A-Za-z_]\w*)=[\"']?([^\"'\n`(]*)[\"']?[ \t]*$"
    names, values = (F.regexp_extract_all(text, F.lit(pat), F.lit(i)) for i in (1, 2))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    # of equal names only the last pair stays
    kept = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(kept)


def substitute(text: Column, values: Column) -> Column:
    """``${v}``, ``$v`` and ``{v}`` replaced by their values; unknown ones stay."""
    token = lambda k: F.concat(F.lit(r"\$\{"), k, F.lit(r"\}|\$"), k, F.lit(r"(?![\w{])|\{"), k, F.lit(r"\}"))
    quote = lambda v: F.regexp_replace(v, r"([\\$])", r"\\$1")
    return F.aggregate(F.map_entries(values), text, lambda s, e: F.regexp_replace(s, token(e["key"]), quote(e["value"])))


def _named(kind: str):
    return lambda t: F.struct(F.lit(kind).alias("stmt_type"), clean_name(t).alias("table_name"))


def tables(df: DataFrame, key: str, sql: str, require_schema: bool = True) -> DataFrame:
    """key, stmt_type, table_name: the tables each text names, once per kind; one scan, a rule is a literal of the plan.

    Names need two parts unless ``require_schema`` is off. Words of SQL are no
    tables; names with variables always count. Names that are CTEs of the same
    text are left out.
    """
    more = rf"(?:\.{NAME_PART})" + ("" if require_schema else "?")
    text, none = F.col("_t"), F.array().cast("array<string>")
    hits = [
        F.transform(
            F.when(may_match(F.col("_low"), before), F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?dUi){before}({NAME_PART}{more})"), F.lit(1)))).otherwise(none),
            _named(kind),
        )
        for kind, before in STATEMENTS
    ]
    last = F.element_at(F.split("table_name", r"\."), -1)
    names = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)(?:\bWITH\s+(?:RECURSIVE\s+)?|\)\s*,\s*)(\w+)\s+AS\s*\("), F.lit(1)), lambda c: F.lower(c))
    return (
        df.filter(F.col(sql).isNotNull())
        .select(F.col(key), without_comments(F.col(sql)).alias("_t"))
        .withColumn("_low", F.lower("_t"))
        .select(key, names.alias("_ctes"), F.inline(F.flatten(F.array(*hits))))
        .filter(is_variable(F.col("table_name")) | (last.rlike(r"^[A-Za-z_]\w*$") & ~F.upper(last).isin(SQL_WORDS)))
        .filter(~F.array_contains("_ctes", F.lower("table_name")))
        .select(key, "stmt_type", "table_name")
        .distinct()
    )


_SKIPPED = re.compile(r"'(?:[^'\\]|\\.|'')*+'|\"(?:[^\"\\]|\\.|\"\")*+\"|--[^\n]*|/\*.*?\*/", re.S)


def cte_names(sql: str) -> list[str]:
    """Names of the CTEs of a text in order, nested ones included; quoted values and remarks open and close nothing."""
    sql = _SKIPPED.sub(lambda m: " " * len(m[0]), sql)
    head, out = re.compile(r"\s*([A-Za-z_]\w*)\s+AS\s*\(", re.I), []
    for w in re.finditer(r"\bWITH\s+(?:RECURSIVE\s+)?", sql, re.I):
        at = w.end()
        while m := head.match(sql, at):
            out.append(m[1])
            depth, at = 1, m.end()
            while at < len(sql) and depth:
                depth += (sql[at] == "(") - (sql[at] == ")")
                at += 1
            nxt = re.compile(r"\s*,").match(sql, at)
            if not nxt:
                break
            at = nxt.end()
    return out


def ctes(df: DataFrame, key: str, sql: str) -> DataFrame:
    """key, cte_names (in order), total, unique_names, is_recursive, is_multiple of each text with a CTE."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "cte_names": b["t"].map(cte_names), "is_recursive": b["t"].str.contains(r"\bWITH\s+RECURSIVE\b", case=False)})

    kind = dict(df.dtypes)[key]
    got = df.select(F.col(key).alias("k"), F.col(sql).alias("t")).filter(F.col("t").rlike(r"(?i)\bWITH\b")).mapInPandas(run, f"k {kind}, cte_names array<string>, is_recursive boolean")
    n = F.size("cte_names")
    return got.filter(n > 0).select(F.col("k").alias(key), "cte_names", n.alias("total"), F.array_sort(F.array_distinct("cte_names")).alias("unique_names"), "is_recursive", (n > 1).alias("is_multiple"))


def extension(path: str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def resolved(df: DataFrame, path: str, text: str) -> DataFrame:
    """``df`` with values (the variables a file defines) and clean (its text with them in place), by the file's extension.

    Python and shell files lose the lines that are no SQL; variables that have
    no value stay as they are.
    """
    kind, none = extension(path), F.create_map().cast("map<string,string>")
    values = F.when(kind == "py", definitions(F.col(text), "py")).when(kind == "sh", definitions(F.col(text), "sh")).otherwise(none)
    bare = F.when(kind.isin("py", "sh"), without_code(F.col(text))).otherwise(F.col(text))
    return df.withColumn("values", values).withColumn("clean", substitute(bare, F.col("values")))


def analysis(df: DataFrame, key: str, path: str, text: str, require_schema: bool = True) -> DataFrame:
    """One row per file of SQL, Python or shell that names tables: key, by_type (map of kind to tables in order), all_tables, variable_tables.

    variable_tables maps a name that still has variables to the names of them.
    Variables a file defines are put in place first. Other files have no row.
    """
    ready = resolved(df.filter(extension(path).isin("sql", "hql", "py", "sh")), path, text)
    per_kind = tables(ready, key, "clean", require_schema).groupBy(key, "stmt_type").agg(F.array_sort(F.collect_set("table_name")).alias("names"))
    per_file = per_kind.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("stmt_type", "names")))).alias("by_type"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("all_tables"),
    )
    parts = F.transform(F.filter("all_tables", is_variable), lambda t: F.struct(t, F.transform(variables(t), lambda v: v["name"])))
    return per_file.withColumn("variable_tables", F.map_from_entries(parts))


def listing(found: DataFrame, key: str) -> DataFrame:
    """key, text: the analysis of each file as a listing with counts, kinds and names in order."""
    part = F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit(" ("), F.size(e["value"]).cast("string"), F.lit("): "), F.array_join(e["value"], ", ")))
    head = F.concat(F.lit("tables: "), F.size("all_tables").cast("string"))
    return found.select(key, F.array_join(F.concat(F.array(head), part), "\n").alias("text"))
