from __future__ import annotations

import random

import pytest
from loomwork.operators import dml, ranges, scripts
from loomwork.session import work_path
from pyspark.sql import functions as F

ROWS = "k int, v string, n double"


def test_conditions_that_are_unknown_change_nothing(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (None, None, None), (2, "b", None)], ROWS)
    assert dml.deleted(t, "n > 0").count() == 2
    assert {r.k: r.v for r in dml.updated(t, {"v": "'x'", "n": 5}, "n > 0").collect()} == {1: "x", None: None, 2: "b"}
    assert dml.deleted(t.limit(0), "n > 0").count() == 0


def test_merge(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, "c", 3.0), (1, "d", 4.0)], ROWS)
    s = spark.createDataFrame([(1, "X"), (3, "Y"), (None, "Z")], "k int, v string")
    got = sorted((str(r.k), r.v, str(r.n)) for r in dml.merged(t, s, ["k"]).collect())
    assert got == [("1", "X", "1.0"), ("1", "X", "4.0"), ("2", "b", "2.0"), ("3", "Y", "None"), ("None", "Z", "None"), ("None", "c", "3.0")]
    assert sorted(r.v for r in dml.merged(t, s, ["k"], insert=False, delete="s_v = 'X'").collect()) == ["b", "c"]
    with pytest.raises(Exception, match="two source rows"):
        dml.merged(t, s.union(s), ["k"]).collect()
    assert dml.merged(t, s.limit(0), ["k"]).count() == 4 and dml.merged(t.limit(0), s, ["k"]).count() == 3


def test_table_of_versions(spark):
    t = dml.Table.create_as(spark.createDataFrame([(1, "a", 1.0)], ROWS), work_path(spark, "t"))
    with pytest.raises(RuntimeError):
        dml.Table.create_as(t.read(), t.path)
    t.insert(spark.createDataFrame([(2, "b", 2.0)], ROWS))
    t.truncate()
    assert t.read().count() == 0 and t.as_of(2).count() == 2
    t.add_column("more", spark.createDataFrame([], "x long").schema["x"].dataType)
    t.overwrite(t.as_of(1).withColumn("more", F.lit(7)))
    assert t.read().first()["more"] == 7 and t.as_of(1).first()["more"] is None
    t.drop()


def test_intervals_against_brute_force(spark):
    rnd = random.Random(3)
    points = [(i, rnd.choice("ab"), rnd.uniform(-50, 1000)) for i in range(300)] + [(900, "a", None), (901, None, 5.0)]
    spans = [(i, rnd.choice("ab"), lo := rnd.uniform(-60, 900), lo + rnd.choice([0.0, 0.5, 7.0, 90.0, 5000.0])) for i in range(60)] + [(90, "a", None, 4.0), (91, "a", 9.0, 1.0)]
    p, s = spark.createDataFrame(points, "i int, g string, x double"), spark.createDataFrame(spans, "j int, g string, lo double, hi double")
    want = {(i, j) for i, g, x in points for j, h, lo, hi in spans if g == h and None not in (x, lo) and lo <= x < hi}
    got = [(r.i, r.j) for r in ranges.interval_join(p, F.col("x"), s, F.col("lo"), F.col("hi"), 3.0, ["g"]).collect()]
    assert set(got) == want and len(got) == len(want)
    assert ranges.interval_join(p, F.col("x"), s.limit(0), F.col("lo"), F.col("hi"), 3.0, ["g"]).count() == 0


def test_scripts_raise_and_limit(spark):
    assert scripts.run_script(spark, "  -- nothing\n;") is None
    assert scripts.run_script(spark, "select 1 as a; select '${x};' as b", {"x": "q"}).first()["b"] == "q;"
    with pytest.raises(Exception, match="no_such_table"):
        scripts.run_script(spark, "select * from no_such_table")
    scripts.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM statements_of('select 1; select 2')").collect()] == [(1, "select 1"), (2, "select 2")]


def test_entropy_sizes_mirrors_and_logs(spark, tmp_path, capsys):
    from loomwork.operators import inventory, profile
    from loomwork.session import log
    from loomwork.sources import files

    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", None), ("c", None)], "k string, v string")
    assert {r.k: r.entropy for r in profile.entropy(df, ["k"], "v").collect()} == {"a": 1.0, "b": 0.0}
    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (5 * 1024**2,), (3 * 1024**3,), (None,)], "s long")
    assert [r[0] for r in sizes.select(inventory.size_text(F.col("s"))).collect()] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 MB", "3.0 GB", None]
    src = spark.createDataFrame([("/r/a/b.sql", "x\r\n\ny"), ("/r/c.sql", "1"), ("/r/d.sql", " "), ("/r/e.sql", None)], "p string, t string")
    files.write_mirrored(src, "p", "t", "/r", str(tmp_path / "m"), ".script")
    assert sorted(map(tuple, files.read_mirrored(spark, str(tmp_path / "m")).collect())) == [(".", "c.script", "1"), ("a", "b.script", "x\r\n\ny")]
    assert log("done").endswith(" done") and "done" in capsys.readouterr().err
