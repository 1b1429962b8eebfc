"""Cases, scripts and jobs from templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def fill_empty(df: DataFrame) -> DataFrame:
    """Rows that hold something, as text, with nulls as empty text."""
    return df.na.drop("all").select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns))


def substitute(template: Column, values: dict[str, Column], mark: tuple[str, str] = ("<", ">"), unknown: str | None = "") -> Column:
    """The template with ``<name>`` replaced by values (null as empty). Names without a value become ``unknown``; None keeps them."""
    out = template
    for name, v in values.items():
        out = F.replace(out, F.lit(f"{mark[0]}{name}{mark[1]}"), F.coalesce(v.cast("string"), F.lit("")))
    if unknown is not None:
        out = F.regexp_replace(out, "\\" + mark[0] + r"\w+" + "\\" + mark[1], unknown)
    return out


def cases(tasks: DataFrame, order: str, templates: list[dict[str, str]]) -> DataFrame:
    """Every task with every template: the first template's fields, index (over all, from 1) and task_index.

    Templates are a list of the configuration and become an array literal, so
    nothing is joined. Ids are numbered within ranges of the order, then
    shifted by the rows before each range: no single task sees all rows.
    """
    fields = list(templates[0])
    kinds = F.array(*(F.struct(F.lit(i).alias("o"), *(F.lit(t.get(f, "")).alias(f) for f in fields)) for i, t in enumerate(templates)))
    ranked = row_ids(tasks, order).withColumnRenamed("id", "task_index").select("*", F.explode(kinds).alias("_v"))
    n = len(templates)
    ranked = ranked.withColumn("index", (F.col("task_index") - 1) * n + F.col("_v.o") + 1)
    values = {c: F.col(c) for c in tasks.columns} | {"index": F.col("index"), "task_index": F.col("task_index")}
    filled = [substitute(substitute(F.col(f"_v.{f}"), values), values, ("{", "}")).alias(f) for f in fields]
    return ranked.select("index", "task_index", *filled)


def row_ids(df: DataFrame, order: str, start: int = 1) -> DataFrame:
    """``df`` with consecutive ids by ``order`` from ``start``.

    Range-partitioned: ranks within partitions plus the rows of the partitions
    before, whose counts (one per partition) are all that is gathered. Staged
    in between, so that a lost partition cannot come back with other ranges.
    """
    parts = df.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id())
    ranked = stage(parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(order))), "ranked")
    counts = ranked.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return ranked.join(F.broadcast(before), "_p").withColumn("id", F.col("_r") + F.col("_b") + (start - 1)).drop("_p", "_r", "_b")


def script_path(path: Column, root: str, strip: str = "", add: str = "/") -> Column:
    """Directory of a file below ``root``, without a prefix, with another; no closing slash."""
    rel = F.regexp_replace(F.regexp_replace(path, "/[^/]*$", ""), "^" + root.rstrip("/").replace(".", r"\.") + "/?", "")
    rel = F.regexp_replace(rel, "^" + strip, "") if strip else rel
    full = F.when(rel == "", F.lit(add)).otherwise(F.concat(F.lit(add), rel))
    return F.when(full == "/", full).otherwise(F.regexp_replace(full, "/+$", ""))


def escaped(content: Column) -> Column:
    """Backslashes, quotes, line feeds and tabs as escapes; carriage returns dropped."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", ""), ("\t", "\\t")):
        content = F.replace(content, F.lit(a), F.lit(b))
    return content


def scripts(files: DataFrame, path: str, content: str, root: str, literals: dict[str, str], twice: bool = False) -> DataFrame:
    """One script document (JSON) per file: name, directory, content and literals. ``twice`` escapes the content before too."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    body = escaped(F.col(content)) if twice else F.col(content)
    doc = F.struct(body.alias("content"), script_path(F.col(path), root).alias("directory"), name.alias("name"), *(F.lit(v).alias(k) for k, v in literals.items()))
    return files.select(F.col(path), name.alias("name"), F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


def jobs(docs: DataFrame, order: str, document: str, template: str, fields: list[str], custom: dict[str, str], mapping: dict[str, str], start: int) -> DataFrame:
    """One job per script document: an id from ``start`` in order, and the template filled; unmatched names stay.

    Values: the document's fields, custom ones, id, and mapped ones (target from
    a field, or the text itself where there is no such field).
    """
    got = row_ids(docs, order, start).withColumn("_d", F.from_json(document, ", ".join(f"{f} string" for f in fields)))
    values = {f: F.col(f"_d.{f}") for f in fields} | {k: F.lit(v) for k, v in custom.items()} | {"id": F.col("id")}
    values |= {t: values.get(s, F.lit(s)) for t, s in mapping.items()}
    job = substitute(F.lit(template), values, unknown=None)
    return got.select("id", order, job.alias("job"), F.try_parse_json(job).isNotNull().alias("is_json"))


def deep_merge(base: dict, over: dict) -> dict:
    """Settings over defaults: objects merge, all else is replaced."""
    return {k: deep_merge(base[k], over[k]) if isinstance(base.get(k), dict) and isinstance(over.get(k), dict) else over.get(k, base.get(k)) for k in {**base, **over}}
