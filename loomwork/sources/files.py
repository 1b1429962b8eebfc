"""Files and databases in, text and JSON out."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inventory import select_files

#: Extensions of code files, by default (fixed values).
EXTENSIONS = (".py", ".sh", ".sql", ".hql")


def extensions_of(patterns: Iterable[str]) -> list[str]:
    """Extensions that globs such as ``*.py`` name; the default ones if none do."""
    found = [p[p.rindex(".") :] for p in patterns if "." in p and not p.endswith(".*")]
    return sorted(set(found) or EXTENSIONS)


def binary_files(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path, content, length, modificationTime of the files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root)


def as_text(content: Column) -> Column:
    """UTF-8 text of binary content; GBK where it is no UTF-8."""

    @F.pandas_udf("string")
    def gbk(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else x.decode("gbk", "replace"))

    ok = F.is_valid_utf8(content)
    return F.when(ok, content.cast("string")).otherwise(gbk(F.when(~ok, content)))


def code_files(spark: SparkSession, root: str, include: str = "", exclude: str = "", glob: str = "*", recursive: bool = True) -> DataFrame:
    """path (relative to ``root``), raw_code, size_bytes, modified_at of code files by ``;``-separated globs."""
    files = binary_files(spark, root, glob, recursive)
    rel = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    got = files.select(rel.alias("path"), "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    return select_files(got, "path", include, exclude).withColumn("raw_code", as_text(F.col("content"))).drop("content")


def jdbc(spark: SparkSession, kind: str, host: str, database: str, table: str, split_by: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table of mysql, oracle, sqlserver, hive or impala. ``split_by`` (column, low, high, parts) reads it in parallel."""
    urls = {
        "mysql": f"jdbc:mysql://{host}/{database}",
        "oracle": f"jdbc:oracle:thin:@//{host}/{database}",
        "sqlserver": f"jdbc:sqlserver://{host};databaseName={database}",
        "hive": f"jdbc:hive2://{host}/{database}",
        "impala": f"jdbc:hive2://{host}/{database}",
    }
    if kind not in urls:
        raise ValueError(f"no connector for {kind}; known: {', '.join(urls)}")
    r = spark.read.format("jdbc").option("url", urls[kind]).option("dbtable", table).options(**options)
    if split_by:
        c, low, high, n = split_by
        r = r.options(partitionColumn=c, lowerBound=low, upperBound=high, numPartitions=n)
    return r.load()


def catalog_tables(spark: SparkSession, schema: str) -> DataFrame:
    """schema_name, table_name of a catalog schema."""
    return spark.sql(f"SHOW TABLES IN {schema}").select(F.col("namespace").alias("schema_name"), F.col("tableName").alias("table_name"))


def write_statements(statements: DataFrame, path: str, kind: str = "json") -> None:
    """Extracted statements as JSON lines, or as SQL text in line order, in a folder per source file."""
    by_file = statements.withColumn("file", F.regexp_replace("source_file", "[^A-Za-z0-9._-]", "_"))
    if kind == "json":
        by_file.write.partitionBy("file").json(path)
    elif kind in ("sql", "txt"):
        head = F.concat(F.lit("-- lines "), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit("\n"))
        tail = F.lit(";\n" if kind == "sql" else "\n")
        by_file.repartition("file").sortWithinPartitions("file", "line_start").select("file", F.concat(head, "sql", tail).alias("value")).write.partitionBy("file").text(path)
    else:
        raise ValueError(f"no such kind of output: {kind}")


def write_mirrored(files: DataFrame, path: str, text: str, root: str, into: str, suffix: str | None = None, skip_empty: bool = True) -> None:
    """Texts below ``into`` in the tree of their paths below ``root``: a folder for each directory and name, under another suffix if told.

    Texts are JSON strings, one a line, so that line ends survive. ``skip_empty`` leaves out null and blank texts.
    """
    kept = files.filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != "") if skip_empty else files
    below = F.regexp_replace(F.col(path), "^" + root.rstrip("/") + "/?", "")
    name = F.element_at(F.split(below, "/"), -1)
    new = F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(suffix)) if suffix else name
    folder = F.coalesce(F.nullif(F.regexp_replace(below, "/?[^/]*$", ""), F.lit("")), F.lit("."))
    kept.select(folder.alias("folder"), new.alias("name"), F.to_json(F.struct(F.col(text).alias("text"))).alias("value")).write.partitionBy("folder", "name").text(into)


def read_mirrored(spark: SparkSession, into: str) -> DataFrame:
    """folder, name, text of what write_mirrored wrote."""
    got = spark.read.schema("value string, folder string, name string").text(into)
    return got.select("folder", "name", F.from_json("value", "text string")["text"].alias("text"))
