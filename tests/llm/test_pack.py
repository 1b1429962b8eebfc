from __future__ import annotations

import base64
import random

import pytest
from loomwork.llm import p7_pack as P
from loomwork.llm import queries as Q

SPEC = "container_type string, capacity_tokens int"


def run(spark, sizes, spec, **kw):
    s = spark.createDataFrame(sizes, "doc long, size int")
    return P.containers(s, spark.createDataFrame(spec, SPEC), **kw).collect()


def test_every_document_once_whole_and_within_capacity(spark):
    rnd = random.Random(5)
    sizes = [(i, rnd.choice([rnd.randint(1, 60), rnd.randint(60, 250)])) for i in range(600)] + [(1000, 1250), (1001, 500), (1002, 251)]
    rows = run(spark, [*sizes, sizes[0]], [("s", 250), ("l", 1000)], group=150)
    for kind, cap in (("s", 250), ("l", 1000)):
        mine = [r for r in rows if r.container_type == kind]
        use: dict = {}
        for r in mine:
            use[r.container] = use.get(r.container, 0) + r.size
        assert max(use.values()) <= cap
        by_doc: dict = {}
        for r in mine:
            by_doc.setdefault(r.doc, []).append(r.size)
        assert {d: sum(v) for d, v in by_doc.items()} == dict(sizes)
        assert all(len(v) == 1 for d, v in by_doc.items() if dict(sizes)[d] <= cap)
        assert len(use) <= 1.02 * sum(s for _, s in sizes) / cap + 2
    split = sorted(r.size for r in rows if r.doc == 1000 and r.container_type == "s")
    assert split == [250] * 5


def test_local_search_beats_best_fit():
    sizes = {i: s for i, s in enumerate([7, 6, 3, 2, 2, 4, 6, 5, 5])}
    assert len(P._pack(sizes, 10)) == 4
    bins = P._Bins({0: 6, 1: 5, 2: 4, 3: 5}, 10)
    bins.items, bins.free = [[0], [1, 2], [3]], [4, 1, 5]
    bins.local_search()
    assert sum(bool(b) for b in bins.items) == 2


def test_sizes_of_zero_nulls_and_empty(spark):
    assert run(spark, [], [("s", 10)]) == []
    assert run(spark, [(1, 5)], []) == [] and run(spark, [(1, 5)], [("s", 0)]) == []
    assert {r.doc for r in run(spark, [(1, 0), (2, 10)], [("s", 10)])} == {1, 2}


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "a b-c"), (2, " "), (3, None), (None, "x"), (4, "数据 x1")], "id long, t string")
    assert {r.doc: r.size for r in P.token_counts(docs, "id", "t", None).collect()} == {1: 4, 4: 2}


def test_vocabulary_is_never_left_out_silently(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(1, "a b-c"), (2, " "), (3, "a longer text, of some words")], "id long, t string")
    with pytest.raises(FileNotFoundError):
        P.token_counts(docs, "id", "t", str(tmp_path / "missing"))
    monkeypatch.setattr(Q, "PACKAGE", "no_such_package")
    with pytest.raises(LookupError):
        Q.vocabulary(spark)
    spark.conf.set(Q.VOCABULARY, "none")
    assert Q.vocabulary(spark) is None
    spark.conf.unset(Q.VOCABULARY)
    ranks = tmp_path / "ranks"  # single bytes only: a token per byte
    ranks.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % b for b in range(256)))
    assert {r.doc: r.size for r in P.token_counts(docs, "id", "t", str(ranks)).collect()} == {1: 5, 3: 28}


def test_many_types_are_filled_as_well_as_few(spark):
    rnd = random.Random(7)
    sizes = [(i, min(250, max(1, int(rnd.lognormvariate(4, 0.8))))) for i in range(2000)]
    total = sum(s for _, s in sizes)
    for kinds in (1, 20):
        rows = run(spark, sizes, [(f"t{k}", 250) for k in range(kinds)], group=200)
        for k in range(kinds):
            assert len({r.container for r in rows if r.container_type == f"t{k}"}) <= 1.02 * total / 250 + 2
