"""Table profiles: all scalar metrics of all columns in one pass, frequencies in one further pass."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text longer than this is masked in samples; rows of a sample; values of a frequency list (fixed values).
LONG_TEXT, SAMPLE_ROWS, TOP_VALUES, MASK = 200, 5, 10, "忽略超长文本"
#: Status of a table or column in a work list (fixed values).
STATUS = {"none": 0, "todo": 1, "done": 2, "error": 4, "again": 9}


def type_class(kind: T.DataType) -> str:
    """string, numeric, date or default, by data type."""
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "default"


def classify_type(name: str) -> str:
    """string, clob, numeric, date or default, by the name of a type in any database; the first family that matches."""
    for found, pattern in (("string", "str|char"), ("clob", "clob|text"), ("numeric", "int|dec|long|float|num"), ("date", "time|date")):
        if re.search(pattern, name.lower()):
            return found
    return "default"


def where(df: DataFrame, condition: str | None) -> DataFrame:
    """``df`` under a condition as work lists write it, with or without the word WHERE; blank means all rows."""
    text = re.sub(r"(?i)^\s*where\s+", "", condition or "").strip()
    return df.filter(text) if text else df


def _simple(df: DataFrame, columns: list[str] | None) -> list[T.StructField]:
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    return [f for f in fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))]


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def scalar_metrics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: counts, lengths (text), extremes and average (numbers). One aggregation, one scan.

    Nested columns are left out. An empty table has counts of 0 and null for the rest.
    """
    fields = _simple(df, columns)
    null = F.lit(None)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        c, kind = _q(f.name), type_class(f.dataType)
        text, num = kind == "string", kind == "numeric"
        parts = {
            "null_count": F.count_if(c.isNull()),
            "blank_count": F.count_if(F.trim(c) == "") if text else null.cast("long"),
            "min_len": F.min(F.length(c)) if text else null.cast("int"),
            "max_len": F.max(F.length(c)) if text else null.cast("int"),
            "avg_len": F.avg(F.length(c)) if text else null.cast("double"),
            "min_number": F.min(c).cast("double") if num else null.cast("double"),
            "max_number": F.max(c).cast("double") if num else null.cast("double"),
            "avg_number": F.avg(c.cast("double")) if num else null.cast("double"),
            "min_value": null.cast("string") if num else F.min(c.cast("string") if kind == "default" else c).cast("string"),
            "max_value": null.cast("string") if num else F.max(c.cast("string") if kind == "default" else c).cast("string"),
        }
        aggs += [v.alias(f"c{i}_{k}") for k, v in parts.items()]
    names = list(parts) if fields else []
    rows = F.array(
        *(
            F.struct(F.lit(f.name).alias("column_name"), F.lit(i).alias("position"), F.lit(type_class(f.dataType)).alias("type_class"), F.col("n").alias("row_count"), *(F.col(f"c{i}_{k}").alias(k) for k in names))
            for i, f in enumerate(fields)
        )
    )
    return df.agg(*aggs).select(F.inline(rows))


#: Characters up to which texts are compared as they are.
SHORT = 100


def _values(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """(column_name, value) of every cell, as text; the table is read once."""
    fields = _simple(df, columns)
    cells = F.array(*(F.struct(F.lit(f.name).alias("column_name"), _q(f.name).cast("string").alias("value")) for f in fields))
    return df.select(F.inline(cells))


def frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, value, cnt of every distinct value; null is a value. Counted before the shuffle."""
    return _values(df, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))


def uniqueness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: distinct values, those that occur once, those that occur more often. Nulls do not count.

    A column at a time, so that a scan reads only that column and its values
    are counted before the shuffle. Values are compared as they are; texts of
    more than SHORT characters by their SHA-256.
    """
    found = None
    for f in _simple(df, columns):
        c = _q(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(F.length(c) <= SHORT, c).otherwise(F.concat(F.lit("\0"), F.sha2(c, 256)))
        counts = df.select(c.alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("cnt"))
        one = counts.agg(
            F.lit(f.name).alias("column_name"), F.count("*").alias("distinct_count"), F.count_if(F.col("cnt") == 1).alias("unique_count"), F.count_if(F.col("cnt") > 1).alias("dup_count")
        )
        found = one if found is None else found.union(one)
    if found is None:
        return df.sparkSession.createDataFrame([], "column_name string, distinct_count long, unique_count long, dup_count long")
    return found


def top_values(df: DataFrame, columns: list[str] | None = None, n: int = TOP_VALUES) -> DataFrame:
    """column_name, rank, value, cnt, rate of the n most frequent values; ties by value, nulls first.

    The rank is cut off before the final sort (the window is limited per partition), so no column's values meet in one task whole.
    """
    total = df.count()
    w = Window.partitionBy("column_name").orderBy(F.desc("cnt"), F.asc_nulls_first("value"))
    few = frequencies(df, columns).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return few.select("column_name", "rank", "value", "cnt", (F.col("cnt") / F.lit(total)).alias("rate"))


def profile(df: DataFrame, columns: list[str] | None = None, condition: str | None = None) -> DataFrame:
    """The full profile: scalar metrics, uniqueness and the five rates, one row per column."""
    df = where(df, condition)
    out = scalar_metrics(df, columns).join(F.broadcast(uniqueness(df, columns)), "column_name", "left")
    for c in ("distinct_count", "unique_count", "dup_count"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    rate = lambda c: F.try_divide(F.col(c), F.col("row_count")).alias(c.replace("_count", "_rate"))
    return out.select("*", *(rate(f"{c}_count") for c in ("null", "blank", "distinct", "unique", "dup")))


def sample_rows(df: DataFrame, key: str, n: int = SAMPLE_ROWS) -> DataFrame:
    """The n rows with the smallest keys."""
    return df.orderBy(F.asc_nulls_last(_q(key))).limit(n)


def sample_columns(df: DataFrame, key: str, n: int = SAMPLE_ROWS) -> DataFrame:
    """A sample turned round: column_name, row1 .. rowN; long text is masked."""
    few = sample_rows(df, key, n)
    cells = F.array(
        *(
            F.struct(F.lit(f.name).alias("column_name"), F.when(F.length(_q(f.name).cast("string")) > LONG_TEXT, MASK).otherwise(_q(f.name).cast("string")).alias("v"))
            for f in _simple(df, None)
        )
    )
    numbered = few.withColumn("_r", F.row_number().over(Window.orderBy(F.asc_nulls_last(_q(key))))).select("_r", F.inline(cells))
    return numbered.groupBy("column_name").agg(*(F.max(F.when(F.col("_r") == i, F.col("v"))).alias(f"row{i}") for i in range(1, n + 1)))


def dictionary(spark: SparkSession, table: str, df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The data dictionary of a DataFrame: names, types, nullability and comments in order.

    ``keys`` names the primary key, as a catalog tells it or ``key_columns`` finds it.
    """
    rows = [
        (table, i, f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO", f.metadata.get("comment"), "YES" if f.name in (keys or []) else "NO", type_class(f.dataType))
        for i, f in enumerate(df.schema.fields, 1)
    ]
    return spark.createDataFrame(rows, "table_name string, ordinal_position int, column_name string, type_name string, is_nullable string, remarks string, is_primary_key string, type_class string")


def key_columns(metrics: DataFrame) -> DataFrame:
    """column_name of each column of a profile that could be a primary key: no nulls, and every value once."""
    return metrics.filter("row_count > 0 and null_count = 0 and unique_count = row_count").select("column_name")


def catalog_dictionary(columns: DataFrame, keys: DataFrame, comments: DataFrame) -> DataFrame:
    """The data dictionary from catalog tables: columns (table_name, column_name, ordinal_position, data_type, is_nullable),
    keys (table_name, column_name) and comments (table_name, column_name, comment); left joins on both."""
    on = ["table_name", "column_name"]
    key = keys.select(*on).distinct().withColumn("is_primary_key", F.lit("YES"))
    return (
        columns.join(key, on, "left")
        .join(comments.select(*on, F.col("comment").alias("remarks")), on, "left")
        .select("table_name", "ordinal_position", "column_name", F.col("data_type").alias("type_name"), "is_nullable", "remarks", F.coalesce("is_primary_key", F.lit("NO")).alias("is_primary_key"))
    )


def parse_describe(rows: DataFrame, order: str) -> DataFrame:
    """DESCRIBE output (col_name, data_type, comment) as a dictionary: blank and # lines skipped, numbered in ``order``."""
    kept = rows.filter((F.trim("col_name") != "") & ~F.col("col_name").startswith("#"))
    return kept.select(
        F.row_number().over(Window.orderBy(order)).alias("ordinal_position"),
        F.trim("col_name").alias("column_name"),
        "data_type",
        F.lit("YES").alias("is_nullable"),
        F.lit("NO").alias("is_primary_key"),
        F.col("comment").alias("remarks"),
    )


def expand_tables(work: DataFrame, catalog: DataFrame) -> DataFrame:
    """Work-list rows with table name ``*`` become one row per table of their schema in the catalog."""
    star = work.filter(F.col("table_name") == "*").drop("table_name").join(catalog.select("schema_name", "table_name"), "schema_name")
    return work.filter(F.col("table_name") != "*").unionByName(star.select(*work.columns))


def first_per_id(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with a key, one per key letter case aside: the first in ``order``."""
    w = Window.partitionBy(F.lower(_q(key))).orderBy(order)
    return df.filter(F.trim(_q(key)) != "").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def replace_partition(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys that ``new`` brings, and ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def next_status(status: Column, failed: Column) -> Column:
    """Status after a run: todo and again become done, or error where it failed; others stay."""
    due = status.isin(STATUS["todo"], STATUS["again"])
    return F.when(due & failed, STATUS["error"]).when(due, STATUS["done"]).otherwise(status)


def entropy(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, entropy in bits of the values of a column, nulls aside: of their counts, so that no group's rows meet in one task."""
    counts = df.filter(_q(column).isNotNull()).groupBy(*keys, _q(column).alias("_v")).agg(F.count("*").alias("_n"))
    n = F.sum("_n")
    return counts.groupBy(*keys).agg((F.log2(n) - F.sum(F.col("_n") * F.log2("_n")) / n).alias("entropy"))
