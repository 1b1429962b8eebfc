from __future__ import annotations

import datetime as dt

from loomwork.operators import snapshots
from pyspark.sql import functions as F

FILES = "list_id long, repo_id int, snapshot_no int, `文件目录` string, `文件名` string, `文件md5` string, `文件状态` string, loaded_at timestamp, extra string"
LOG = "repo_id int, snapshot_no int, snapshot_state string"
T = [dt.datetime(2025, 1, 1, h) for h in range(5)]


def changes(spark, rows, log):
    files = spark.createDataFrame([(*r, "x") for r in rows], FILES)
    return {tuple(r) for r in snapshots.snapshot_changes(files, spark.createDataFrame(log, LOG)).collect()}


def test_kinds_and_paths(spark):
    rows = [
        (1, 1, 1, "/a", "x.py", "AA", None, T[0]),
        (2, 1, 1, "/a", "y.py", "bb", None, T[0]),
        (3, 1, 1, "/a", "z.py", "cc", None, T[0]),
        (4, 1, 2, "\\a\\", "x.py", "aa", None, T[1]),  # the same file, written otherwise
        (5, 1, 2, "/a", "y.py", "dd", None, T[1]),
        (6, 1, 2, "/a", "z.py", "cc", " DELETED ", T[1]),
        (7, 1, 2, "/a//b", "n.py", None, None, T[1]),
    ]
    got = changes(spark, rows, [(1, 1, "complete"), (1, 2, "Complete")])
    assert got == {(1, 2, "/a/y.py", "changed"), (1, 2, "/a/z.py", "removed"), (1, 2, "/a/b/n.py", "added")}


def test_incomplete_snapshots_do_not_count(spark):
    rows = [(1, 1, 1, "/a", "x", "aa", None, T[0]), (2, 1, 3, "/a", "x", "bb", None, T[0])]
    log = [(1, 1, "complete"), (1, 2, "partial"), (1, 3, "complete")]
    assert changes(spark, rows, log) == {(1, 3, "/a/x", "changed")}


def test_latest_line_holds_and_null_hash_is_last_known(spark):
    rows = [
        (1, 1, 1, "/a", "x", "aa", None, T[0]),
        (2, 1, 2, "/a", "x", "bb", None, T[0]),
        (3, 1, 2, "/a", "x", None, None, T[1]),  # latest: content as last known
        (4, 1, 3, "/a", "x", "AA", None, T[1]),
        (5, 1, 3, "/a", "x", "AA", None, T[1]),  # repeated row
    ]
    log = [(1, n, "complete") for n in (1, 2, 3)]
    assert changes(spark, rows, log) == set()


def test_empty_and_null(spark):
    assert changes(spark, [(1, 1, 1, None, None, "aa", None, None)], [(1, 1, "complete"), (1, 2, None)]) == set()
    assert changes(spark, [], []) == set()


def test_statuses(spark):
    from loomwork.functions.paths import says_deleted

    rows = [("删除 ", True), ("已删除", True), ("deleted", True), ("REMOVED", True), ("未删除", False), ("新增", False), (None, False), ("not deleted", False)]
    got = spark.createDataFrame(rows, "s string, want boolean").withColumn("is", says_deleted(F.col("s"))).collect()
    assert all(r["is"] == r["want"] for r in got)


def test_diff_of_states_counts_repeats_one_for_one(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (3, "x")], "k int, v string")
    got = {tuple(r) for r in snapshots.diff_states(a, b, ["k"], "v").collect()}
    assert got == {(1, "removed"), (3, "added")}
