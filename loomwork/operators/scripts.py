"""Scripts of SQL statements, the words by which engines limit rows, and table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from .extract import split_statements, strip_comments
from .lineage import cte_names

# --- fixed values: how an engine limits a query to n rows: before the columns, as a condition, or at the end ---
LIMITS = {
    "hive": ("", "", " LIMIT {n}"),
    "impala": ("", "", " LIMIT {n}"),
    "mysql": ("", "", " LIMIT {n}"),
    "oracle": ("", "ROWNUM <= {n}", ""),
    "sqlserver": ("TOP {n} ", "", ""),
}


def limited(dialect: str, columns: str, table: str, n: int, where: str = "") -> str:
    """A query for ``n`` rows of a table in the words of an engine."""
    head, cond, tail = (x.format(n=int(n)) for x in LIMITS[dialect])
    conditions = [f"({where})" if cond and where else where, cond]
    told = " AND ".join(c for c in conditions if c)
    return f"SELECT {head}{columns} FROM {table}" + (f" WHERE {told}" if told else "") + tail


def run_script(spark: SparkSession, script: str, values: dict[str, str] | None = None) -> DataFrame | None:
    """Run the statements of a script one after another; the frame of the last, None without any.

    ``${name}`` is replaced by its value first. Errors are raised, with what ran before in place.
    """
    for name, value in (values or {}).items():
        script = script.replace("${" + name + "}", str(value))
    out = None
    for statement in split_statements(strip_comments(script)):
        out = spark.sql(statement)
    return out


@udtf(returnType="ordinal int, name string")
class CteNames:
    """Table function: the names of the CTEs of a statement, in order."""

    def eval(self, sql: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(cte_names(sql or ""), 1)


@udtf(returnType="ordinal int, statement string")
class Statements:
    """Table function: the statements of a script, in order."""

    def eval(self, script: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(split_statements(strip_comments(script or "")), 1)


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL: cte_names(sql), statements_of(script)."""
    spark.udtf.register("cte_names", CteNames)
    spark.udtf.register("statements_of", Statements)
