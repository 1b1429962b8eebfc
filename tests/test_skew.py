from __future__ import annotations

from loomwork.operators import skew
from loomwork.operators.components import components
from loomwork.session import release, stage
from pyspark.sql import functions as F


def test_join_per_key_is_an_inner_join(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i // 2}") for i in range(300)] + [(900, None)]
    df = spark.createDataFrame(rows, "id long, k string")
    per = stage(df.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least")))
    want = sorted(map(tuple, df.join(per, "k").select("id", "least").collect()))
    for hot in (1, 10, 10_000):
        assert sorted(map(tuple, skew.join_per_key(df, per, "k", "n", hot).select("id", "least").collect())) == want
    none = skew.join_per_key(df.limit(0), stage(per.limit(0)), "k", "n")
    assert none.count() == 0


def test_bounded(spark):
    df = stage(spark.range(10))
    plan = lambda most: df.join(skew.bounded(spark.range(5).toDF("id"), most), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(5) and "BroadcastHashJoin" not in plan(4)


def test_components_with_a_hub(spark):
    edges = [(0, i) for i in range(1, 1500)] + [(2000 + i, 2001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(1500)} | {2000 + i: 2000 for i in range(41)}


def test_release_deletes_what_was_staged(spark):
    import os

    path = stage(spark.range(3), "gone").inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path) and release(spark) >= 1 and not os.path.exists(path)
