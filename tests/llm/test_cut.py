from __future__ import annotations

import random

from loomwork.llm import p9_cut

SUBJECTS = ["the table", "our cluster", "a query", "this column", "the old job"]
VERBS = ["reads every partition", "drops null keys", "returns duplicate rows", "runs out of memory", "loses its lock"]
TAILS = ["after the upgrade", "at month end", "on the test system", "all night", "again"]


def text(rnd):
    return " ".join(f"{rnd.choice(SUBJECTS).capitalize()} {rnd.choice(VERBS)} {rnd.choice(TAILS)}." for _ in range(rnd.randint(2, 5)))


def test_held_out_accuracy(spark):
    rnd, rows = random.Random(6), []
    for i in range(1500):
        t, whole = text(rnd), True
        if i % 10 == 0:
            stop = rnd.randrange(len(t) // 2, len(t) - 2)
            piece = t[:stop].rstrip()
            whole = piece.endswith(".") or any(piece.endswith(x) for x in TAILS)
            t = piece
        elif i % 7 == 0:
            t = rnd.choice([t[:-1], t + "\n\nThanks in advance", t + "\n\nNo idea why...", t + "\n\n```sql\nselect 1 from t\n```"])
        rows.append((i, t, f"s{i % 3}", whole))
    rows += [(9001, None, "s0", True), (9002, " \n", None, True), (9003, "", "s0", True)]
    df = spark.createDataFrame([(*r[:3], "x") for r in rows], "id long, text string, source string, words string")
    got = {r.id: r.cut for r in p9_cut.judged(df, "id", "text", "source").collect()}
    assert set(got) == {r[0] for r in rows[:-3]}
    cut = {r[0] for r in rows if not r[3]}
    hit = {i for i, c in got.items() if c}
    assert len(hit & cut) >= 0.9 * len(cut) and len(hit & cut) >= 0.95 * len(hit)


def test_open_fence_long_text_and_rates(spark):
    rows = [(1, "Look:\n```sql\nselect a", "s"), (2, "word " * 50_000 + "end.", "s"), (3, "x" * 200_000, None), (4, "!!!", "s")]
    df = spark.createDataFrame(rows, "id long, text string, source string")
    j = p9_cut.judged(df, "id", "text", "source")
    got = {r.id: r.cut for r in j.collect()}
    assert got[1] and not got[2] and not got[3] and 4 not in got
    assert {(r.source, r.texts, r.cut_texts) for r in p9_cut.rates(j).collect()} == {("s", 2, 1), (None, 1, 0)}
    assert p9_cut.judged(df.limit(0), "id", "text", "source").count() == 0


def test_open_code_long_tags_and_long_words(spark):
    rnd = random.Random(8)
    code = lambda n: "```sql\n" + "\n".join(f"select c{rnd.randrange(9)} from t{rnd.randrange(9)};" for _ in range(n))
    rows = [(i, f"{text(rnd)}\n\n{code(3)}\n```\n{rnd.choice(['', text(rnd)])}") for i in range(80)]
    rows += [(100 + i, f"{text(rnd)}\n\n{code(2)}") for i in range(4)]  # ends within the code
    rows += [(200, f"{text(rnd)}\n```"), (201, f"{text(rnd)} <a href='{'x/' * 300}' title='t'>{text(rnd)}</a>")]
    long = "y" * 300
    rows += [(300 + i, f"We call it {long}abc every night.") for i in range(30)] + [(400, f"We call it {long}"), (401, f"We call it {long}abc")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "id long, text string, source string")
    cut = {r.id for r in p9_cut.judged(df, "id", "text", "source").collect() if r.cut}
    assert cut == {*range(100, 104), 200, 400, 401}
