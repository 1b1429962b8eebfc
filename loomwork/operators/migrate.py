"""Migration of code files as rows: rewritten text, changes, warnings, errors, score and outcome; backups, rollback, reports."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import SPARK_CHECKS, SPARK_REWRITES
from . import facts, flows, rewrite, validate

#: Outcomes: rewritten, nothing to do, not what the migration is for, failed.
MIGRATED, SKIPPED, FAILED = "success", "skipped", "failed"


def has_spark_code(found: DataFrame, key: str = "key") -> DataFrame:
    """key, has_spark of the facts of each file: an import of Spark, a session, or a method of frames or RDDs."""
    spark_import = (F.col("kind") == "import") & F.col("name").rlike(r"^pyspark(\.|$)")
    sure = (F.col("kind") == "frame_op") & (F.col("detail") != "low")
    return found.groupBy(key).agg(F.max(F.coalesce(spark_import | sure | F.col("kind").isin("session", "rdd_op"), F.lit(False))).alias("has_spark"), F.max(F.col("kind") == "syntax_error").alias("broken"))


def _strings(items: list[Column]) -> Column:
    return F.array_compact(F.array(*items)) if items else F.array().cast("array<string>")


def backup_name(path: Column, at: Column) -> Column:
    """stem_YYYYMMDD_HHMMSS.ext beside the file."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.regexp_extract(path, r"(\.[^./]*)$", 1))


def migrate(files: DataFrame, path: str, text: str, version: str | None = None, dry_run: bool = False, at: Column | None = None) -> DataFrame:
    """One row per file: path, status, changes, warnings, errors, score, original, rewritten, backup_path.

    Only ``.py`` files are taken; others, missing texts and texts that do not
    parse have failed. Files without Spark code or without changes are skipped.
    The rewritten text is checked line by line; errors fail the file, warnings
    are told. A dry run has no backup path. Paths should be unique. Nothing is
    written: see apply.
    """
    src = files.select(F.col(path).alias("path"), F.col(text).alias("original"), F.xxhash64(path).alias("key"))
    python = F.col("path").endswith(".py") & F.col("original").isNotNull()
    kinds = has_spark_code(facts.facts(src.filter(python), "key", "original"))
    done = rewrite.fold(src.join(kinds, "key", "left"), "original", SPARK_REWRITES, version)
    hits = lambda severity: _strings([F.when(F.contains("rewritten", F.lit(p)), F.lit(p)) for p, s in SPARK_CHECKS if s == severity])
    per_line = lambda severity: sum((F.regexp_count("rewritten", F.lit(r"(?m)^.*\Q" + p + r"\E.*$")) for p, s in SPARK_CHECKS if s == severity), F.lit(0))
    counted = done.withColumns({"errors": per_line("error"), "warnings_": per_line("warning"), "infos": per_line("info"), "bad": hits("error"), "odd": hits("warning")})
    scored = validate.spark_score(counted.withColumnRenamed("warnings", "told").withColumnRenamed("warnings_", "warnings"))
    broken, spark = F.coalesce("broken", F.lit(False)), F.coalesce("has_spark", F.lit(False))
    status = (
        F.when(~python | broken | (spark & (F.size("bad") > 0)), FAILED)
        .when(~spark | (F.size("changes") == 0), SKIPPED)
        .otherwise(MIGRATED)
    )
    names = lambda c: F.transform(c, lambda x: x["rule"])
    none = F.array().cast("array<string>")
    why = (
        F.when(~F.col("path").endswith(".py"), F.array(F.lit("not a Python file")))
        .when(F.col("original").isNull(), F.array(F.lit("no text")))
        .when(broken, F.array(F.lit("does not parse")))
        .when(spark, F.col("bad"))
        .otherwise(none)
    )
    works = spark & ~broken & python
    out = scored.select(
        "path", status.alias("status"),
        F.when(works, names("changes")).otherwise(none).alias("changes"),
        F.when(works, F.concat(names("told"), F.col("odd"))).when(python & ~broken, F.array(F.lit("no Spark code"))).otherwise(none).alias("warnings"),
        why.alias("errors"),
        F.when(works, F.col("score")).otherwise(F.lit(0.0)).alias("score"),
        "original",
        F.when(works, F.col("rewritten")).otherwise(F.col("original")).alias("rewritten"),
    )
    backup = F.when(F.col("status") == MIGRATED, backup_name(F.col("path"), at if at is not None else F.current_timestamp()))
    return out.withColumn("backup_path", F.lit(None).cast("string") if dry_run else backup)


def migrate_flows(files: DataFrame, path: str, text: str, dry_run: bool = False, at: Column | None = None) -> DataFrame:
    """The same for workflow definitions: path, status, source_version, grade, errors, warnings, original, rewritten, backup_path.

    Files without a definition of a workflow are skipped; a rewritten text with
    errors has failed and is not applied.
    """
    src = files.select(F.col(path).alias("path"), F.col(text).alias("original"))
    new = rewrite.upgrade_flows(src, "original")
    version = flows.structures(src, "path", "original").filter("kind in ('version', 'syntax_error')").select("path", F.when(F.col("kind") == "version", F.col("name")).alias("source_version"))
    found = flows.checked(new, "path", "rewritten")
    gathered = lambda s: F.array_sort(F.collect_set(F.when(F.col("severity") == s, F.col("code"))))
    graded = validate.flow_score(validate.tally(found, "path")).select("path", "score", "grade")
    per = found.groupBy("path").agg(gathered("error").alias("errors"), gathered("warning").alias("warnings")).join(graded, "path")
    none = F.array().cast("array<string>")
    is_flow = F.col("original").rlike(r"DAG\(|@dag\b")
    all_ = new.join(version, "path", "left").join(per, "path", "left")
    errors = F.coalesce("errors", none)
    status = F.when(F.col("original").isNull() | ~F.col("path").endswith(".py"), FAILED).when(~is_flow & F.col("source_version").isNotNull(), SKIPPED).when(F.size(errors) > 0, FAILED).otherwise(MIGRATED)
    out = all_.select("path", status.alias("status"), "source_version", F.coalesce("grade", F.lit("A")).alias("grade"), errors.alias("errors"), F.coalesce("warnings", none).alias("warnings"), "original", "rewritten")
    backup = F.when(F.col("status") == MIGRATED, backup_name(F.col("path"), at if at is not None else F.current_timestamp()))
    return out.withColumn("backup_path", F.lit(None).cast("string") if dry_run else backup)


def totals(results: DataFrame) -> DataFrame:
    """One row: total, succeeded, skipped, failed, success_rate in percent of the files that were not skipped."""
    n = lambda s: F.count_if(F.col("status") == s)
    return results.agg(F.count("*").alias("total"), n(MIGRATED).alias("succeeded"), n(SKIPPED).alias("skipped"), n(FAILED).alias("failed")).withColumn(
        "success_rate", F.round(F.coalesce(F.try_divide(F.col("succeeded") * 100.0, F.col("total") - F.col("skipped")), F.lit(0.0)), 2)
    )


def apply(results: DataFrame, into: str) -> None:
    """Write what a migration made below the folder ``into``: rewritten texts under new/, originals that changed under backup/.

    Each is a Parquet table of path and text, written by all tasks; a rerun
    writes the same rows.
    """
    done = results.filter(F.col("status") == MIGRATED)
    done.select("path", F.col("rewritten").alias("text")).write.mode("overwrite").parquet(f"{into}/new")
    done.filter("backup_path is not null").select(F.col("backup_path").alias("path"), F.col("path").alias("original_path"), F.col("original").alias("text"), F.sha2("original", 256).alias("file_hash")).write.mode(
        "overwrite"
    ).parquet(f"{into}/backup")


def manifest(results: DataFrame) -> DataFrame:
    """original_path, backup_path, file_hash (sha256), size: a row per backup."""
    return results.filter("backup_path is not null").select(F.col("path").alias("original_path"), "backup_path", F.sha2("original", 256).alias("file_hash"), F.octet_length("original").alias("size"))


def verified(backups: DataFrame, texts: DataFrame) -> DataFrame:
    """``backups`` with is_intact: whether the text of the backup (path, text) still has its digest; false where it is gone."""
    now = texts.select(F.col("path").alias("backup_path"), F.sha2("text", 256).alias("_now"))
    return backups.join(now, "backup_path", "left").withColumn("is_intact", F.coalesce(F.col("_now") == F.col("file_hash"), F.lit(False))).drop("_now")


def restored(backups: DataFrame, texts: DataFrame) -> DataFrame:
    """path, text: the originals that intact backups give back."""
    good = verified(backups, texts).filter("is_intact").select("backup_path", "original_path")
    return good.join(texts.select(F.col("path").alias("backup_path"), "text"), "backup_path").select(F.col("original_path").alias("path"), "text")


def _quoted(path: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def rollback_lines(results: DataFrame) -> DataFrame:
    """path, line: the shell line that puts a file's backup back. A script is these lines between ``set -e`` and the end."""
    done = results.filter("backup_path is not null")
    return done.select("path", F.concat(F.lit("cp "), _quoted(F.col("backup_path")), F.lit(" "), _quoted(F.col("path"))).alias("line"))


def write_rollback(results: DataFrame, path: str) -> None:
    """The script in parts, one per task, each runnable by itself: it stops at the first line that fails."""
    lines = rollback_lines(results).select(F.concat(F.lit("set -e; "), "line").alias("line"))
    lines.write.mode("overwrite").text(path)


def recommendations(results: DataFrame, low: float = 0.8) -> DataFrame:
    """kind, files: files that failed, that score above 0 but below ``low``, that have warnings; only kinds with files."""
    failed, weak = F.col("status") == FAILED, (F.col("score") > 0) & (F.col("score") < low)
    n = results.agg(F.count_if(failed).alias("failed"), F.count_if(weak).alias("low_score"), F.count_if(F.size("warnings") > 0).alias("warnings"))
    return n.select(F.expr("stack(3, 'failed', failed, 'low_score', low_score, 'warnings', warnings) AS (kind, files)")).filter("files > 0")


def report(results: DataFrame, how: str = "markdown", most: int = 1000) -> str:
    """A report of totals, recommendations and the worst files (``most`` at most, by score), as markdown, html or json."""
    t = totals(results).first().asDict()
    advice = [r.asDict() for r in recommendations(results).collect()]
    worst = [r.asDict() for r in results.filter(F.col("status") == FAILED).orderBy("score", "path").select("path", "score", "errors").limit(most).collect()]
    if how == "json":
        import json

        return json.dumps({"totals": t, "recommendations": advice, "failed": worst}, ensure_ascii=False)
    rows = [(k, v) for k, v in t.items()] + [(a["kind"], a["files"]) for a in advice]
    if how == "html":
        cells = "".join(f"<tr><td>{html.escape(str(a))}</td><td>{html.escape(str(b))}</td></tr>" for a, b in rows)
        files = "".join(f"<li>{html.escape(w['path'])}: {html.escape('; '.join(w['errors']))}</li>" for w in worst)
        return f"<html><body><h1>Migration</h1><table>{cells}</table><ul>{files}</ul></body></html>"
    return "\n".join(["# Migration", "", "| | |", "|-|-|", *(f"| {a} | {b} |" for a, b in rows), "", *(f"- {w['path']}: {'; '.join(w['errors'])}" for w in worst), ""])
