"""File inventories: attributes, duplicates, snapshot status, backups and their retention."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage
from .skew import join_per_key

#: Status labels of an inventory (fixed values).
NEW, KEPT, GONE = "新增", "已有", "删除"


def attributes(df: DataFrame, path: str, content: str, created: str | None = None, modified: str | None = None) -> DataFrame:
    """Directory, name, extension without dot, size in MB (two places) and md5 of each file; with its times as text where they are given."""
    p, c = F.col(path), F.col(content)
    name = F.element_at(F.split(p, "/"), -1)
    dates = [F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias(n) for n, at in (("created", created), ("modified", modified)) if at]
    return df.select(
        F.regexp_replace(p, "/[^/]*$", "").alias("directory"),
        name.alias("name"),
        F.regexp_extract(name, r"\.([^.]*)$", 1).alias("extension"),
        F.round(F.octet_length(c) / 1048576.0, 2).alias("size_mb"),
        *dates,
        F.md5(c).alias("md5"),
    )


def size_text(size: Column) -> Column:
    """A number of bytes in B, KB, MB or GB, with one place from KB on, halves up."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        n = 1024**power
        out = F.when(size >= n, F.concat(F.format_string("%.1f", F.floor(size * 10 / n + 0.5) / 10), F.lit(f" {unit}"))).otherwise(out)
    return out


def newest_first(backups: DataFrame, original: str, at: str) -> DataFrame:
    """Backups with their place in the list of their file, newest first (ordinal)."""
    return backups.withColumn("ordinal", F.row_number().over(Window.partitionBy(original).orderBy(F.desc(at))))


def duplicate_counts(df: DataFrame, digest: str) -> DataFrame:
    """``df`` with dup_count: rows of the same digest, null where that is null.

    Counted before the shuffle; the rows of a digest of a large part of all
    rows get their count by broadcast and stay where they are.
    """
    rows, there = df.drop("dup_count"), F.col(digest).isNotNull()
    counts = stage(rows.filter(there).groupBy(digest).agg(F.count("*").alias("dup_count")), "digests")
    return join_per_key(rows.filter(there), counts, digest, "dup_count").unionByName(rows.filter(~there).withColumn("dup_count", F.lit(None).cast("long")))


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: * within a part, ** over parts, ?."""
    out = ""
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, c if c.isalnum() or c in "_/" else "\\" + c)
        i += 1
    return out


def matches(path: Column, patterns: str) -> Column:
    """Whether a path matches any of the ``;``-separated globs; one ending in / or \\ means any directory above the file."""
    tests = []
    for p in (x.strip() for x in patterns.split(";")):
        if not p:
            continue
        if p[-1] in "/\\":
            tests.append(path.rlike(f"(?:^|/){glob_regex(p[:-1])}/"))
        else:
            tests.append(path.rlike(f"(?:^|/){glob_regex(p)}$"))
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def select_files(df: DataFrame, path: str, include: str = "", exclude: str = "") -> DataFrame:
    """Files that match ``include`` (all if blank) and not ``exclude``."""
    keep = matches(F.col(path), include) if include.strip(" ;") else F.lit(True)
    return df.filter(keep & ~matches(F.col(path), exclude))


def merge_snapshot(old: DataFrame, new: DataFrame, key: str, keep: list[str], today: Column) -> DataFrame:
    """The inventory after a scan: key, status, digest, updated and the kept columns (tags, remarks).

    New files are new; files known and not gone before keep their labels and
    date; files no longer there are gone, dated today; gone files that come
    back are new. One full join on the key.
    """
    o = old.select(F.col(key), F.col("status").alias("_was"), F.col("digest").alias("_digest"), F.col("updated").alias("_updated"), *keep)
    n = new.select(F.col(key), F.col("digest"), F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), GONE).when(F.col("_was").isNull() | (F.col("_was") == GONE), NEW).otherwise(KEPT)
    return o.join(n, key, "full_outer").select(
        key,
        status.alias("status"),
        F.coalesce("digest", "_digest").alias("digest"),
        F.when(status == KEPT, F.col("_updated")).otherwise(today).alias("updated"),
        *keep,
    )


def fold_snapshots(snapshots: list[tuple[DataFrame, Column]], key: str, keep: list[str]) -> DataFrame:
    """The inventory after scans in order (each with its date), from nothing: see merge_snapshot.

    ``key`` may be a struct of several columns. Kept columns come from the scan
    that first brought a file. Each step is staged, so plans stay short.
    """
    state = None
    for new, today in snapshots:
        if state is None:
            state = new.select(key, F.lit(NEW).alias("status"), "digest", today.alias("updated"), *keep)
        else:
            brought = new.select(key, *(F.col(c).alias(f"_new_{c}") for c in keep))
            merged = merge_snapshot(state, new, key, keep, today).join(brought, key, "left")
            state = merged.withColumns({c: F.coalesce(c, f"_new_{c}") for c in keep}).drop(*(f"_new_{c}" for c in keep))
        state = stage(state, "inventory")
    if state is None:
        raise ValueError("no snapshots")
    return state


def load_previous(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The inventory that was written before; empty where there is none that can be read."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def keep_latest(df: DataFrame, key: str, at: str, tie: str, n: int) -> DataFrame:
    """The n newest rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def latest(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The value of the newest row of each key."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(at, value)).alias(value), F.max(at).alias(at))


def older_than(df: DataFrame, at: str, days: int, now: Column) -> DataFrame:
    """Rows older than so many days: what a retention by age drops."""
    return df.filter(F.col(at) < now - F.make_dt_interval(F.lit(days)))


def backup_stats(df: DataFrame, original: str, size: str, at: str) -> DataFrame:
    """One row: backups, total size, oldest, newest, distinct files."""
    return df.agg(F.count("*").alias("backups"), F.sum(size).alias("total_size"), F.min(at).alias("oldest"), F.max(at).alias("newest"), F.count_distinct(original).alias("files"))


def original_name(backup: Column) -> Column:
    """``stem.ext`` of a backup named ``stem_YYYYMMDD_HHMMSS.ext``; null for other names."""
    hit = backup.rlike(r"_\d{8}_\d{6}(\.[^./]*)?$")
    return F.when(hit, F.regexp_replace(backup, r"_\d{8}_\d{6}(?=\.[^./]*$|$)", ""))


def verify(df: DataFrame, content: str, digest: str) -> DataFrame:
    """``df`` with ``intact``: whether the content still has its sha256."""
    return df.withColumn("intact", F.sha2(F.col(content), 256) == F.lower(F.col(digest)))
