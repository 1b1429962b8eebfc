"""Queries on the inventory tables for the general data problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental, snapshots
from ..session import table, work_path


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "file_list"), table(spark, d, "snapshot_log"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Changes of each kind per repository and snapshot."""
    return p3_found(spark, d).groupBy("repo_id", "snapshot_no", "change_kind").agg(F.count("*").alias("files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    target = incremental.Target(spark, work_path(spark, "due"))
    rows = incremental.replay(table(spark, d, "file_list_feed"), table(spark, d, "scan_run"), target)
    return rows.select("run_no", "file_key")


def p5_resumed(spark: SparkSession, d: str) -> DataFrame:
    """The same rows from runs that stop half way, lose a publication to another run, and go on."""
    feed, runs, path = table(spark, d, "file_list_feed"), table(spark, d, "scan_run"), work_path(spark, "due")
    half = len(incremental.successful_runs(runs)) // 2
    incremental.replay(feed, runs, incremental.Target(spark, path), half - 1)
    target = incremental.Target(spark, path)
    before = target.manifest()
    rows = incremental.replay(feed, runs, target, half)
    try:  # a run that began before that one ended
        target.publish(rows, half, before)
    except RuntimeError:
        return incremental.replay(feed, runs, incremental.Target(spark, path)).select("run_no", "file_key")
    raise AssertionError("a version was published twice")


_KEY = r"""regexp_replace(translate(coalesce("文件目录", '') || '/' || "文件名", '\', '/'), '/+', '/', 'g')"""

_P3 = rf"""
WITH ok AS (
  SELECT repo_id, snapshot_no,
         lag(snapshot_no) OVER (PARTITION BY repo_id ORDER BY snapshot_no) AS before_no,
         lead(snapshot_no) OVER (PARTITION BY repo_id ORDER BY snapshot_no) AS after_no
  FROM (SELECT DISTINCT repo_id, snapshot_no FROM snapshot_log WHERE lower(trim(snapshot_state)) = 'complete')),
held AS (
  SELECT f.repo_id, f.snapshot_no, before_no, after_no, {_KEY} AS file_key,
         nullif(lower(trim("文件md5")), '') AS md5, "文件状态" AS st,
         row_number() OVER (PARTITION BY f.repo_id, f.snapshot_no, {_KEY}
                            ORDER BY loaded_at DESC NULLS LAST, list_id DESC) AS rn
  FROM file_list f JOIN ok ON f.repo_id = ok.repo_id AND f.snapshot_no = ok.snapshot_no),
states AS (
  SELECT repo_id, snapshot_no, before_no, after_no, file_key,
         last_value(md5 IGNORE NULLS) OVER (PARTITION BY repo_id, file_key ORDER BY snapshot_no
                                            ROWS UNBOUNDED PRECEDING) AS md5
  FROM held
  WHERE rn = 1 AND file_key IS NOT NULL
    AND NOT coalesce(regexp_matches(st, '删|移除|(?i:delet|remov|gone|erased|dropped)')
                     AND NOT regexp_matches(st, '未删|没删|恢复|(?i:not (deleted|removed)|undelet|restored)'), false)),
b AS (SELECT repo_id, after_no AS snapshot_no, file_key, md5 FROM states WHERE after_no IS NOT NULL),
a AS (SELECT repo_id, snapshot_no, file_key, md5 FROM states WHERE before_no IS NOT NULL),
lab AS (
  SELECT repo_id, snapshot_no, file_key,
         CASE WHEN bx IS NULL THEN 'added' WHEN ax IS NULL THEN 'removed' WHEN bm <> am THEN 'changed' END AS change_kind
  FROM (SELECT repo_id, snapshot_no, file_key, md5 AS bm, 1 AS bx FROM b)
  FULL JOIN (SELECT repo_id, snapshot_no, file_key, md5 AS am, 1 AS ax FROM a) USING (repo_id, snapshot_no, file_key))
SELECT repo_id, snapshot_no, file_key, change_kind FROM lab WHERE change_kind IS NOT NULL"""

_P5 = rf"""
WITH ok AS (
  SELECT run_no, started_at, row_number() OVER (ORDER BY started_at, run_no) AS ix FROM scan_run
  WHERE lower(trim(run_status)) = 'success' AND started_at IS NOT NULL),
lines AS (
  SELECT {_KEY} AS file_key, nullif(lower(trim("文件md5")), '') AS md5, arrived_at, feed_id FROM file_list_feed),
state AS (
  SELECT ok.ix, ok.run_no, l.file_key, l.md5,
         row_number() OVER (PARTITION BY ok.ix, l.file_key ORDER BY l.arrived_at DESC, l.feed_id DESC) AS rn
  FROM ok JOIN lines l ON l.arrived_at <= ok.started_at AND l.md5 IS NOT NULL AND l.file_key IS NOT NULL),
held AS (SELECT ix, run_no, file_key, md5 FROM state WHERE rn = 1)
SELECT h.run_no, h.file_key FROM held h LEFT JOIN held p ON p.ix = h.ix - 1 AND p.file_key = h.file_key
WHERE p.md5 IS NULL OR p.md5 <> h.md5"""

QUERIES = {"p3_found": p3_found, "p3_rates": p3_rates, "p5_found": p5_found, "p5_resumed": p5_resumed}
SQL = {
    "p3_found": _P3,
    "p3_rates": f"""SELECT repo_id, snapshot_no, change_kind, count(*) AS files FROM ({_P3}) t
GROUP BY repo_id, snapshot_no, change_kind""",
    "p5_found": _P5,
    "p5_resumed": _P5,
}
