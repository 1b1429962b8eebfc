from __future__ import annotations

import itertools
import os
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from loomwork.llm import p2_near
from loomwork.session import TIDY, drop, shared_dir, stage

WORDS = [f"w{i}" for i in range(400)]


def corpus(n, seed):
    rnd, rows = random.Random(seed), []
    while len(rows) < n:
        base = [rnd.choice(WORDS) for _ in range(rnd.randint(15, 60))]
        rows.append(" ".join(base))
        for _ in range(rnd.randint(0, 3)):
            t = list(base)
            for _ in range(rnd.randint(0, 4)):
                t[rnd.randrange(len(t))] = rnd.choice(WORDS)
            rows.append(rnd.choice([", ", " ", "\n"]).join(t).upper())
    return rows[:n] + [rows[0]] * 3


def brute(rows, least=0.7):
    sets = {}
    for i, t in enumerate(rows):
        w = re.findall("[a-z0-9_]+", (t or "").lower())
        if len(w) >= 15:
            sets[i] = set(zip(w, w[1:], strict=False))
    return {(a, b) for a, b in itertools.combinations(sets, 2) if 10 * len(sets[a] & sets[b]) >= 10 * least * len(sets[a] | sets[b])}


def test_recall_and_precision(spark):
    rows = corpus(300, 1)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "id long, t string, key string")
    got = {(r.id_a, r.id_b) for r in p2_near.similar_pairs(df, "id", "t").collect()}
    want = brute(rows)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_groups_lose_no_link(spark):
    rows = corpus(120, 2)
    df = spark.createDataFrame(list(enumerate(rows)), "id long, t string")
    got = {r.id: r for r in p2_near.groups(df, "id", "t").collect()}
    for a, b in brute(rows):
        assert got[a].group_id == got[b].group_id
    copies = [i for i, t in enumerate(rows) if t == rows[0]]
    assert {got[i].rep for i in copies} == {0} and got[0].copies == len(copies)


def test_null_short_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (4, "a b c")], "id long, t string")
    assert p2_near.similar_pairs(df, "id", "t").count() == 0
    assert p2_near.groups(df.limit(0), "id", "t").count() == 0


def test_hot_buckets_and_classes_are_met_in_parts(spark):
    rnd, base = random.Random(4), [random.Random(5).choice(WORDS) for _ in range(60)]
    rows = corpus(60, 3) + [" ".join(base)] * 40  # a class of many copies
    for _ in range(60):  # and a bucket of many like it
        t = list(base)
        t[rnd.randrange(60)] = rnd.choice(WORDS)
        rows.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(rows)), "id long, t string")
    want = brute(rows)
    one, parts = ([(r.id_a, r.id_b) for r in p2_near.similar_pairs(df, "id", "t", bucket=b).collect()] for b in (1000, 7))
    assert set(one) == set(parts) and len(parts) == len(set(parts))
    assert set(parts) <= want and len(parts) >= 0.99 * len(want)


def test_no_join_on_an_estimate(spark):
    df = spark.createDataFrame(list(enumerate(corpus(40, 6))), "id long, t string")
    plan = p2_near.similar_pairs(df, "id", "t")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    _, links = p2_near.similar_classes(p2_near.word_pairs(df, "id", "t"))
    assert "BroadcastHashJoin" not in links._jdf.queryExecution().executedPlan().toString()


def shuffled_records(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = store.stageList(None, False, False, quantiles, spark.sparkContext._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_a_record_is_not_shuffled_once_a_table_key(spark):
    rows = corpus(1500, 7)
    df = spark.createDataFrame(list(enumerate(rows)), "id long, t string")
    before = shuffled_records(spark)
    assert p2_near.similar_pairs(df, "id", "t").count() > 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    after = shuffled_records(spark)
    assert 0 < sum(n for stage, n in after.items() if stage not in before) < 100 * len(rows)


def test_shuffle_files_go_with_their_job(spark):
    blocks = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    df = spark.range(1000).repartition(3)
    before = blocks()
    staged = stage(df, "tidy", tidy=True)
    assert blocks() <= before and staged.count() == 1000
    assert spark.conf.get(TIDY, "false") == "false"


def test_word_pairs_are_hashed_as_by_spark(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("ab_09z") for _ in range(rnd.choice([1, 3, 4, 7, 8, 15, 16, 31, 32, 33, 64, 71, 100])))
    rows = [rnd.choice([" ", ".é", "\n-"]).join(word() for _ in range(rnd.randint(10, 40))) for _ in range(60)] + ["", "ü", " a"]
    w = F.regexp_extract_all(F.lower("t"), F.lit("[a-z0-9_]+"), F.lit(0))
    df = spark.createDataFrame(list(enumerate(rows)), "id long, t string").select("id", w.alias("w")).filter("size(w) >= 15")
    want = {r.id: r.h for r in df.select("id", F.expr("transform(sequence(0, size(w) - 2), i -> xxhash64(w[i], w[i + 1]))").alias("h")).collect()}
    got = {}
    for i, h in zip(*(x.tolist() for x in p2_near._pairs(pa.array(["of before", *rows]).slice(1), 15)), strict=True):
        got.setdefault(i, []).append(h - 2**64 * (h >= 2**63))
    assert got == want


def test_no_pair_is_lost_by_maps_and_second_keys(spark):
    rows = corpus(300, 9)
    df = spark.createDataFrame(list(enumerate(rows)), "id long, t string")
    by = {r.id: r for r in p2_near.sketches(p2_near.word_pairs(df, "id", "t")).collect()}
    met = set()
    for a, b in itertools.combinations(by, 2):
        x, y = by[a], by[b]
        lanes = [(i, 15 * j) for i in range(4) for j in range(4)]
        if any(u == v for u, v in zip(x.u, y.u, strict=True)) and any((x.v[i] ^ y.v[i]) >> j & 0x3FFF == 0 for i, j in lanes):
            met.add((a, b))
    got = {(r.id_a, r.id_b) for r in p2_near.similar_pairs(df, "id", "t").collect()}
    assert got == met & brute(rows)


def test_staged_tables_that_are_done_with_are_dropped(spark):
    folder = shared_dir(spark).removeprefix("file://")
    here = lambda: set(os.listdir(folder))
    one, two = stage(spark.range(3), "one"), stage(spark.range(3), "two")
    before = here()
    drop(one)
    assert len(before - here()) == 1 and two.count() == 3
    df = spark.createDataFrame(list(enumerate(corpus(60, 3) * 2)), "id long, t string")
    p2_near.similar_pairs(df, "id", "t", bucket=3)
    left = {n.rpartition("-")[0] for n in here() - before}
    assert "members" in left and not left & {"sketches", "representatives", "half_keys", "large", "tables"}
