"""Connected components by large-star and small-star steps, with bounded work per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .skew import join_per_key


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """Component of each node that occurs in ``edges``: columns node, component (its smallest node).

    Each round links every node to the smallest neighbour it knows; the number
    of rounds grows with the logarithm of the longest path. Only one total is
    sent to the driver. Loops and repeated edges change nothing; rows with a
    null end take no part; no edges give an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    e = stage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "least")
        large = join_per_key(both, least, "u", "n").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.filter("u <> v").distinct(), "large")
        down = stage(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "down")
        small = join_per_key(large, down, "u", "n").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(small.union(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
