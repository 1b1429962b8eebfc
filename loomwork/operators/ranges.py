"""Joins of points with intervals, as equi joins on buckets of fitting width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_join(points: DataFrame, at: Column, intervals: DataFrame, low: Column, high: Column, width: float, by: list[str] | None = None) -> DataFrame:
    """Rows of ``points`` and ``intervals`` with low <= at < high, all columns of both; equal in ``by`` too.

    ``at``, ``low`` and ``high`` are numbers (seconds of times). An interval has
    the level at which buckets of ``width * 2 ** level`` are as long as it, so
    it lies in two of them at most; a point is looked up once at each level that
    occurs. However long intervals are, nothing is compared but what shares a
    bucket. Nulls and empty intervals meet nothing; column names must differ,
    but for ``by``.
    """
    by = by or []
    i = intervals.withColumns({"_lo": low.cast("double"), "_hi": high.cast("double")}).filter("_lo < _hi")
    i = i.withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2((F.col("_hi") - F.col("_lo")) / width))).cast("int"))
    levels = [r[0] for r in i.select("_level").distinct().collect()]  # one for each power of two
    size = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_level"))
    bucket = lambda c: F.floor(F.col(c) / size)
    i = i.withColumn("_bucket", F.explode(F.array_distinct(F.array(bucket("_lo"), bucket("_hi")))))
    p = points.withColumn("_at", at.cast("double")).filter("_at is not null")
    p = p.withColumn("_level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("_bucket", bucket("_at"))
    return p.join(i.hint("merge"), [*by, "_level", "_bucket"]).filter("_lo <= _at and _at < _hi").drop("_lo", "_hi", "_at", "_level", "_bucket")


def nearest_before(points: DataFrame, at: str, marks: DataFrame, mark_at: str, by: list[str]) -> DataFrame:
    """As-of join: every point with the newest mark of the same ``by`` not after it (as column mark, a struct), null if none.

    One shuffle by key and a running maximum over both sides together; no pair
    of a point and a mark is made but the one that holds.
    """
    from pyspark.sql import Window

    columns = [c for c in marks.columns if c not in by]
    a = points.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*points.columns).alias("_p"), F.lit(None).cast(marks.select(F.struct(*columns)).schema[0].dataType).alias("_m"))
    b = marks.select(*by, F.col(mark_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("_p"), F.struct(*columns).alias("_m"))
    w = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("mark", F.last("_m", ignorenulls=True).over(w))
    return both.filter("_side = 1").select("_p.*", "mark")
