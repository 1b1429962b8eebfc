from __future__ import annotations

import datetime as dt

import pytest
from loomwork.operators import incremental as inc
from loomwork.session import work_path

FEED = "feed_id long, `文件目录` string, `文件名` string, `修改日期` string, `文件md5` string, arrived_at timestamp_ntz"
RUNS = "run_no int, started_at timestamp_ntz, run_status string"
H = [dt.datetime(2025, 1, 1, h) for h in range(12)]


def lines(spark, rows):
    return spark.createDataFrame([(i, "/a", n, "2025", m, H[h]) for i, (n, m, h) in enumerate(rows)], FEED)


def brute(rows, runs):
    ok = sorted((s, n) for n, s, st in runs if (st or "").lower() == "success")
    out, before = set(), {}
    for s, n in ok:
        now = {}
        for f, m, h in rows:
            if m and H[h] <= s:
                now[f] = m.lower()
        out |= {(n, f"/a/{f}") for f, m in now.items() if before.get(f) != m}
        before = now
    return out


def test_against_brute_force(spark):
    rows = [("x", "AA", 1), ("x", "aa", 2), ("y", "bb", 2), ("x", None, 3), ("y", "cc", 4), ("y", "bb", 5), ("z", "dd", 9), ("x", "ee", 11)]
    runs = [(1, H[1], "success"), (2, H[2], "failed"), (3, H[3], "SUCCESS"), (4, H[5], "success"), (5, H[6], None), (6, H[10], "success")]
    for stop in (None, 0, 2):
        target = inc.Target(spark, work_path(spark, "t"))
        if stop is not None:
            inc.replay(lines(spark, rows), spark.createDataFrame(runs, RUNS), target, stop)
            assert target.manifest()["last_ix"] == stop
        got = inc.replay(lines(spark, rows), spark.createDataFrame(runs, RUNS), target)
        assert {(r.run_no, r.file_key) for r in got.collect()} == brute(rows, runs)
        assert target.manifest()["version"] == 4  # one a run


def test_a_failed_publish_shows_nothing_and_is_made_good(spark):
    rows, runs = [("x", "aa", 1), ("y", "bb", 3)], [(1, H[2], "success"), (2, H[4], "success")]
    target = inc.Target(spark, work_path(spark, "t"))
    order = inc.successful_runs(spark.createDataFrame(runs, RUNS))
    base = target.manifest()
    placed = inc.lines_by_run(inc.feed_lines(lines(spark, rows)), order)
    inc.advance(target, placed, order, 0)
    with pytest.raises(RuntimeError):  # another run published since
        inc.advance(target, placed, order, 1, base)
    assert target.manifest()["version"] == 1 and target.read().count() == 1
    got = inc.replay(lines(spark, rows), spark.createDataFrame(runs, RUNS), target)
    assert {(r.run_no, r.file_key) for r in got.collect()} == {(1, "/a/x"), (2, "/a/y")}
    assert inc.replay(lines(spark, rows), spark.createDataFrame(runs, RUNS), target).count() == 2  # nothing twice


def test_empty(spark):
    target = inc.Target(spark, work_path(spark, "t"))
    assert inc.replay(lines(spark, []), spark.createDataFrame([], RUNS), target).count() == 0
    assert inc.replay(lines(spark, []), spark.createDataFrame([(1, H[0], "success")], RUNS), target).count() == 0


def test_a_manifest_that_was_not_finished(spark, monkeypatch):
    rows, runs = [("x", "aa", 1)], [(1, H[2], "success")]
    target = inc.Target(spark, work_path(spark, "t"))
    out = target._fs.create(target._at(f"{target.path}/manifest/1.json"), False)
    out.write(b'{"version": 1, "par')
    out.close()
    assert target.manifest()["version"] == 0 and target.read().count() == 0
    again = lambda: inc.replay(lines(spark, rows), spark.createDataFrame(runs, RUNS), target)
    with pytest.raises(RuntimeError):
        again()
    monkeypatch.setattr(inc, "STALE", -1)
    assert again().count() == 1
