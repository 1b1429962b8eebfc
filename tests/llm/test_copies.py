from __future__ import annotations

import pytest
from loomwork.llm import p4_copies as C

SAME = [
    ("select a, b from t", "SELECT  b ,a\nFROM T ;"),
    ("select `a` from `d`.`t`", "select a from d.t"),
    ("select a, count(*) from t group by x, y", "select count( * ), a from t group by y,x"),
    ("select * from (select b, a from t) q where a='X y'", "select * from (select a,b from t) q where a = 'X y'"),
    ("select case when a in (1, 2) then 'p' else 'q' end as c, d from t", "select d, case when a in (1,2) then 'p' else 'q' end as c from t"),
    ("-- it's a Note\nselect a from t", "--  it's a note\n select a from t;"),
    ("with x as (select a, b from t) select 1, 2 from x", "WITH x AS (select b,a from t) select 2,1 from x"),
]
OTHER = [
    ("select a from t where x = 1 and y = 2", "select a from t where y = 2 and x = 1"),
    ("select a from t where x = 'a'", "select a from t where x = 'A'"),
    ("select a from t where x = 'a b'", "select a from t where x = 'a  b'"),
    ("select a from t where x < 1", "select a from t where x <= 1"),
    ("select a from t limit 1", "select a from t limit 2"),
    ("select a from t order by x, y", "select a from t order by y, x"),
    ("select f(a, b) from t", "select f(b, a) from t"),
    ("select a from t -- one", "select a from t -- two"),
    ("select ab from t", "select a b from t"),
]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert C.canonical(a) == C.canonical(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other(a, b):
    assert C.canonical(a) != C.canonical(b)


@pytest.mark.parametrize("odd", ["", "   ", "(((", ")))", "'open", "/* open", "`open", "select", "select from", ";;;", "select " + "(" * 100_000 + ")" * 100_000, "(" * 100_000, "(select b, a " * 20_000, ")" * 1000])
def test_odd_texts(odd):
    assert isinstance(C.canonical(odd), str)


def test_hot_and_other_keys_alike(spark):
    rows = [(i, "select a, b from hot") for i in range(200)] + [(i, f"select b,a from t{i // 2}") for i in range(200, 260)] + [(900, None), (901, " ")]
    df = spark.createDataFrame(rows, "id long, t string").withColumnRenamed("t", "sql")
    for skew in ({"hot_rows": 10}, {"hot_rows": 10_000}):
        got = {(r.keep_id, r.copy_id) for r in C.copies(df, "id", "sql", **skew).collect()}
        assert got == {(0, i) for i in range(1, 200)} | {(i, i + 1) for i in range(200, 260, 2)}
    kept = {r.keep_id: r.copies for r in C.statements(df, "id", "sql").collect()}
    assert kept[0] == 200 and kept[200] == 2 and len(kept) == 31 and sum(kept.values()) == 260
    assert C.copies(df.limit(0), "id", "sql").count() == 0


def test_deep_and_long_texts_keep_their_rules():
    deep = lambda a, b: "(" * 5000 + f"select {a}, {b} from t" + ")" * 5000
    assert C.canonical(deep("x", "y")) == C.canonical(deep("y", "x")) != C.canonical(deep("y", "z"))
    assert C.canonical("select (a from t") != C.canonical("select (a) from t")
    many = [f"col_{i} + {i}" for i in range(3000)]
    assert C.canonical(f"select {', '.join(many)} from t") == C.canonical(f"SELECT {', '.join(many[::-1])} FROM t")


def test_rows_of_hot_keys_are_not_shuffled_to_one_task(spark):
    df = spark.createDataFrame([(i, "select a from hot" if i % 3 else f"select {i}") for i in range(90)], "id long, sql string")
    keys = C.stage(C.keyed(df, "id", "sql"))
    hot, rest, names = C.collapse(keys)
    assert len(names) == 1 and hot.count() == 1 and rest.count() == 30 and rest.filter("copies > 1").count() == 0
