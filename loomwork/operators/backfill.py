"""Calendars for backfills, restarts, and INI look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def days(df: DataFrame, begin: str, end: str) -> DataFrame:
    """``df`` once per day from begin to end (dates or yyyyMMdd text), in a column ``day``; no rows where begin is after end."""
    b, e = (F.try_to_date(F.col(c).cast("string"), "yyyyMMdd") if dict(df.dtypes)[c] != "date" else F.col(c) for c in (begin, end))
    return df.withColumn("day", F.explode(F.when(b <= e, F.sequence(b, e))))


def from_step(jobs: DataFrame, step: str, start: int) -> DataFrame:
    """Jobs from a step on: those before it are skipped on a restart."""
    return jobs.filter(F.col(step) >= start)


def days_before(day: Column, n: int) -> Column:
    return F.date_sub(day, n)


def previous_month_end(day: Column) -> Column:
    return F.last_day(F.add_months(day, -1))


def ini(lines: DataFrame, line_no: str, line: str) -> DataFrame:
    """section, key, value of an INI file's lines: the text between the first and second ``=``; remarks and blanks skipped."""
    t = F.trim(F.col(line))
    w = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    got = lines.select(F.col(line_no).alias("line_no"), t.alias("t")).withColumn("section", F.last(F.when(F.col("t").rlike(r"^\[.*\]$"), F.regexp_extract("t", r"^\[(.*)\]$", 1)), ignorenulls=True).over(w))
    return got.filter(F.col("t").rlike(r"^[^#;\[=][^=]*=")).select("section", F.trim(F.split("t", "=")[0]).alias("key"), F.trim(F.split("t", "=")[1]).alias("value"))
