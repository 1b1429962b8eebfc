from __future__ import annotations

import random
import re

from loomwork.llm import p8_leaks as L

V = [f"word{i}" for i in range(300)]


def words(t):
    return re.findall(r"[^\W_]+", re.sub(r"</?[a-z]+(?: [a-z]+=[^<>]*)?>|&\w+;", " ", t).lower())


def brute(docs, items, gap=2):
    out = set()
    for d, t in docs:
        w = words(t or "")
        for i, p in items:
            q = words(p or "")
            if not q:
                continue
            for off in range(-len(q), len(w)):
                hit = [k for k in range(len(q)) if 0 <= off + k < len(w) and w[off + k] == q[k]]
                start = prev = None
                for k in hit:
                    if prev is None or k - prev > gap:
                        start = k
                    prev = k
                    if 2 * (k - start + 1) >= len(q):
                        out.add((d, i))
    return out


def data():
    rnd = random.Random(8)
    some = lambda n: [rnd.choice(V) for _ in range(n)]
    items = [(i, " ".join(some(rnd.randint(8, 60)))) for i in range(25)] + [(90, None), (91, ""), (92, "too short")]
    docs = []
    for d in range(160):
        text = some(rnd.randint(0, 80))
        if d % 2:
            p = items[rnd.randrange(25)][1].split()
            n = rnd.choice([len(p), len(p) * 3 // 4, len(p) // 2, len(p) // 2 - 1, len(p) // 3])
            a = rnd.randint(0, len(p) - n)
            part = p[a : a + n]
            for k in range(1, len(part) - 1, rnd.choice([2, 3, 7, 99])):
                if rnd.random() < 0.7:
                    part[k] = rnd.choice(["zzz", "Other"])
            part = [x.upper() if rnd.random() < 0.1 else x for x in part]
            text = text[:10] + [rnd.choice(["<b>", "\n> ", " -- "])] + part + text[10:]
        docs.append((d, rnd.choice([" ", "\n", ", "]).join(text)))
    return docs + [(900, None), (901, ""), (902, "<p></p>")], items


def test_against_brute_force(spark):
    docs, items = data()
    ddf = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS term", "1 AS item")
    idf = spark.createDataFrame(items, "item_id long, passage string").selectExpr("*", "2 AS doc")
    index = L.PositionalIndex.build(ddf, "doc_id", "text")
    for gap in (2, 1):
        got = {(r.doc, r.item) for r in L.matches(index, idf, "item_id", "passage", gap).collect()}
        want = brute(docs, items, gap)
        assert got == want and len(want) > 10


def test_empty(spark):
    docs, items = spark.createDataFrame([], "d long, t string"), spark.createDataFrame([(1, " ".join(V[:20]))], "i long, p string")
    assert L.matches(L.PositionalIndex.build(docs, "d", "t"), items, "i", "p").count() == 0
    one = spark.createDataFrame([(1, " ".join(V[:20]))], "d long, t string")
    assert L.matches(L.PositionalIndex.build(one, "d", "t"), items.limit(0), "i", "p").count() == 0
    assert [(r.words, r.of) for r in L.matches(L.PositionalIndex.build(one, "d", "t"), items, "i", "p").collect()] == [(20, 20)]


def test_items_of_any_length(spark, monkeypatch):
    rnd = random.Random(9)
    items = [(i, " ".join(rnd.choice(V[:40]) for _ in range(1 + i % 14))) for i in range(42)]
    docs = [(d, " ".join(rnd.choice(V[:50]) for _ in range(rnd.randint(0, 30)))) for d in range(60)]
    for i, p in items:  # whole, and with every second word replaced
        docs += [(100 + i, f"zzz {p} zzz"), (200 + i, " ".join("zzz" if k % 2 else x for k, x in enumerate(p.split())))]
    monkeypatch.setattr(L, "BLOCK", 7)  # many blocks of query terms
    want = {gap: brute(docs, items, gap) for gap in (2, 1)}
    index = L.PositionalIndex.build(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    for gap in (2, 1):
        got = L.matches(index, spark.createDataFrame(items, "item_id long, passage string"), "item_id", "passage", gap).collect()
        assert {(r.doc, r.item) for r in got} == want[gap]
        assert {i for d, i in want[gap] if d == 100 + i} == set(range(42))


def test_markup_of_any_length(spark):
    long_tag = '<a href="https://example.org/' + "x/" * 400 + '" title="some words">'
    p = " ".join(V[:20])
    texts = [p.replace(V[9], f"{long_tag}{V[9]}</a>"), p.replace(V[9], f"{V[9]}&CounterClockwiseContourIntegral;<br/>"), f"if a <b and {p} ... c> d", f"x < {p} > y", p.replace(V[5], f"<!-- {'note ' * 90}-->{V[5]}")]
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, t string")
    items = spark.createDataFrame([(1, p)], "i long, p string")
    got = {r.doc: r.words for r in L.matches(L.PositionalIndex.build(docs, "d", "t"), items, "i", "p").collect()}
    assert got == dict.fromkeys(range(5), 20)
