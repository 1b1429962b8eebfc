"""What changed between full snapshots (EXCEPT ALL both ways, then a full join of the residues)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import content_id, file_key, says_deleted
from ..session import stage


def diff_states(before: DataFrame, after: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Added, removed and changed keys between two tables of states.

    ``before`` and ``after`` hold one row per key. Identical rows cancel by
    EXCEPT ALL in both directions, so only residues meet in the full join.
    A null content is unknown: it is another content than none.
    Result: keys, change_kind (added, removed, changed). Ties and repeated rows
    cancel one for one; empty tables on one side give all added or all removed.
    Rows with a null in a key column take no part.
    """
    cols = [*keys, content]
    known = lambda d: d.select(*cols).dropna(subset=keys)
    b, a = known(before), known(after)
    gone = b.exceptAll(a).withColumnRenamed(content, "_was").withColumn("_b", F.lit(1))
    came = a.exceptAll(b).withColumnRenamed(content, "_is").withColumn("_a", F.lit(1))
    kind = (
        F.when(F.col("_b").isNull(), "added")
        .when(F.col("_a").isNull(), "removed")
        .when(F.col("_was") != F.col("_is"), "changed")
    )
    return (
        gone.join(came, keys, "full_outer")
        .select(*keys, kind.alias("change_kind"))
        .filter("change_kind is not null")
        .distinct()
    )


def complete_snapshots(log: DataFrame) -> DataFrame:
    """Complete snapshots with the complete ones before and after them in the repository."""
    w = Window.partitionBy("repo_id").orderBy("snapshot_no")
    return (
        log.filter(F.lower(F.trim("snapshot_state")) == "complete")
        .select("repo_id", "snapshot_no")
        .distinct()
        .select(
            "*",
            F.lag("snapshot_no").over(w).alias("before_no"),
            F.lead("snapshot_no").over(w).alias("after_no"),
        )
    )


def snapshot_states(files: DataFrame, log: DataFrame) -> DataFrame:
    """One row per repository, complete snapshot and file that is there.

    Of several lines for a file the one with the latest loaded_at holds, then
    the largest list_id. Lines that say the file was deleted drop out. A null
    hash takes the content last known from a complete snapshot; null if none.
    """
    lines = files.select(
        "repo_id",
        "snapshot_no",
        file_key(F.col("文件目录"), F.col("文件名")).alias("file_key"),
        F.struct(
            "loaded_at",
            "list_id",
            content_id(F.col("文件md5")).alias("md5"),
            says_deleted(F.col("文件状态")).alias("gone"),
        ).alias("line"),
    ).filter("file_key is not null")
    w = Window.partitionBy("repo_id", "file_key").orderBy("snapshot_no")
    return (
        lines.join(complete_snapshots(log), ["repo_id", "snapshot_no"])
        .groupBy("repo_id", "snapshot_no", "before_no", "after_no", "file_key")
        .agg(F.max("line").alias("line"))
        .filter("not line.gone")
        .select(
            "repo_id",
            "snapshot_no",
            "before_no",
            "after_no",
            "file_key",
            F.last("line.md5", ignorenulls=True).over(w).alias("md5"),
        )
    )


def snapshot_changes(files: DataFrame, log: DataFrame) -> DataFrame:
    """Files that each complete snapshot added, removed or changed against the complete one before it.

    Result: repo_id, snapshot_no (the later one), file_key, change_kind.
    All pairs of snapshots go through one EXCEPT ALL each way: a state is
    labelled with its own number as "after" and with the next complete number
    as "before". The states are staged: they are read twice on either side.
    """
    states = stage(snapshot_states(files, log), "states")
    after = states.filter("before_no is not null").select("repo_id", "snapshot_no", "file_key", "md5")
    before = states.filter("after_no is not null").select(
        "repo_id", F.col("after_no").alias("snapshot_no"), "file_key", "md5"
    )
    return diff_states(before, after, ["repo_id", "snapshot_no", "file_key"], "md5")
