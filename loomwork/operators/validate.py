"""Issues in code by line, scores and grades, lint reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import FLOW_WEIGHTS, GRADES, LINT_WEIGHTS, SPARK_CHECKS, SPARK_WEIGHTS


def issues(df: DataFrame, key: str, text: str, checks: list[tuple[str, str]] = SPARK_CHECKS) -> DataFrame:
    """key, line_no, col_no, severity, code (the text found): one row per line and check that hits. Checks are literals, nothing is joined."""
    lines = df.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("_i", "_l"))
    found = F.array_compact(F.array(*(F.when(F.contains("_l", F.lit(p)), F.struct(F.instr("_l", p).alias("col_no"), F.lit(s).alias("severity"), F.lit(p).alias("code"))) for p, s in checks)))
    return lines.select(key, (F.col("_i") + 1).alias("line_no"), F.inline(found))


def tally(found: DataFrame, key: str) -> DataFrame:
    """key, errors, warnings, infos."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return found.groupBy(key).agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"))


def _loss(w: dict) -> Column:
    return F.col("errors") * w["error"] + F.col("warnings") * w["warning"] + F.col("infos") * w["info"]


def spark_score(per: DataFrame) -> DataFrame:
    """``per`` with score: 1 less the weights of its issues, between 0 and 1."""
    return per.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - _loss(SPARK_WEIGHTS))))


def flow_score(per: DataFrame, weights: dict = FLOW_WEIGHTS) -> DataFrame:
    """``per`` with score (100 less the weights, 0 at least), grade and is_compatible (no errors)."""
    out = per.withColumn("score", F.greatest(F.lit(0), 100 - _loss(weights)))
    return out.withColumns({"grade": grade(F.col("score")), "is_compatible": F.col("errors") == 0})


def lint_score(per: DataFrame) -> DataFrame:
    return flow_score(per, LINT_WEIGHTS)


def grade(score: Column) -> Column:
    out = None
    for least, g in GRADES[:-1]:
        out = F.when(score >= least, g) if out is None else out.when(score >= least, g)
    return out.otherwise(GRADES[-1][1])


def summary(results: DataFrame, success: str, score: str) -> DataFrame:
    """One row over migration results: total, succeeded, failed, success_rate, avg_score of scores above 0."""
    ok = F.count_if(F.coalesce(F.col(success), F.lit(False)))
    return results.agg(
        F.count("*").alias("total"), ok.alias("succeeded"), (F.count("*") - ok).alias("failed"),
        F.try_divide(ok, F.count("*")).alias("success_rate"), F.avg(F.when(F.col(score) > 0, F.col(score))).alias("avg_score"),
    )


def duration_text(seconds: Column) -> Column:
    """ms below a second, s below a minute, else minutes and seconds."""
    return (
        F.when(seconds < 1, F.concat(F.round(seconds * 1000).cast("int").cast("string"), F.lit("ms")))
        .when(seconds < 60, F.concat(F.format_number(seconds, 2), F.lit("s")))
        .otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), F.floor(seconds % 60).cast("string"), F.lit("s")))
    )


def lint_rows(lines: DataFrame, line: str) -> DataFrame:
    """Rows of a lint report ``path:row:col: code message``: path, row, col, code, message, category; other lines are left out."""
    pat = r"^(.+?):(\d+):(\d+): ([A-Z]+\d+) (.*)$"
    g = lambda i: F.regexp_extract(line, pat, i)
    got = lines.filter(F.col(line).rlike(pat)).select(g(1).alias("path"), g(2).cast("int").alias("row"), g(3).cast("int").alias("col"), g(4).alias("code"), g(5).alias("message"))
    first = F.substring("code", 1, 1)
    kind = F.when(first == "E", "error").when(first == "W", "warning").when(first == "F", "logic").when(first == "C", "complexity").when(first == "N", "naming").otherwise("other")
    return got.withColumn("category", kind)


def severity_of(code: Column) -> Column:
    """error for E and F codes, warning for W, else info."""
    return F.when(code.rlike("^[EF]"), "error").when(code.startswith("W"), "warning").otherwise("info")


def per_code(found: DataFrame, code: str) -> DataFrame:
    return found.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("hits"))


#: A lint report as JSON: an array of findings.
LINT_JSON = "array<struct<filename: string, code: string, message: string, location: struct<row: int, column: int>, fix: struct<applicability: string>>>"


def lint_json(reports: DataFrame, column: str) -> DataFrame:
    """path, row, col, code, message, severity, fixable: findings of JSON reports, one report a row. What is no report has no findings."""
    found = reports.select(F.inline(F.from_json(column, LINT_JSON)))
    severity = F.when(F.col("code").rlike("^[EF]"), "error").when(F.col("code").startswith("W"), "warning").otherwise("info")
    return found.select(
        F.col("filename").alias("path"), F.col("location.row").alias("row"), F.col("location.column").alias("col"), "code", "message", severity.alias("severity"), F.col("fix").isNotNull().alias("fixable")
    )


def lint_summary(found: DataFrame) -> DataFrame:
    """path, findings, errors, warnings, infos, fixable, codes (in order), score and grade of each file of lint findings."""
    counts = found.groupBy("path").agg(F.count("*").alias("findings"), F.count_if("fixable").alias("fixable"), F.array_sort(F.collect_set("code")).alias("codes"))
    return counts.join(lint_score(tally(found, "path")), "path")


def lint_text(found: DataFrame) -> DataFrame:
    """path, text: the findings of each file as lines ``row:col code message`` under its name."""
    line = F.concat(F.lit("  "), F.col("row").cast("string"), F.lit(":"), F.col("col").cast("string"), F.lit(" "), "code", F.lit(" "), "message")
    lines = F.array_sort(F.collect_list(F.struct("row", "col", line.alias("line"))))
    return found.groupBy("path").agg(lines.alias("l")).select("path", F.concat_ws("\n", "path", F.transform("l", lambda x: x["line"])).alias("text"))


def star_imports(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, module of every ``from module import *``."""
    lines = df.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("_i", "_l"))
    module = F.regexp_extract("_l", r"^\s*from\s+([\w.]+)\s+import\s+\*", 1)
    return lines.select(key, (F.col("_i") + 1).alias("line_no"), module.alias("module")).filter("module <> ''")
