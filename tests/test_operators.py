from __future__ import annotations

import random

import pytest
from loomwork.operators import backfill, classify, components, extract, facts, generate, inventory, lineage, profile, rewrite, validate
from pyspark.sql import functions as F


def test_profile_of_empty_null_and_blank(spark):
    df = spark.createDataFrame([(1, "a", None), (2, " ", None), (2, None, None)], "n int, `s t` string, z double")
    got = {r.column_name: r for r in profile.profile(df).collect()}
    assert (got["n"].distinct_count, got["n"].unique_count, got["n"].dup_count, got["n"].avg_number) == (2, 1, 1, 5 / 3)
    assert (got["s t"].null_count, got["s t"].blank_count, got["s t"].max_len) == (1, 1, 1)
    assert got["z"].null_rate == 1.0 and got["z"].distinct_count == 0
    empty = profile.profile(df.limit(0)).collect()
    assert {r.row_count for r in empty} == {0} and {r.null_rate for r in empty} == {None}


def test_top_values_ties_and_null(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", None, "b", "a", "c"]], "v string")
    assert [(r.value, r.cnt) for r in profile.top_values(df, n=3).orderBy("rank").collect()] == [("a", 2), ("b", 2), (None, 1)]


@pytest.mark.parametrize(("name", "kind"), [("VARCHAR(20)", "string"), ("clob", "clob"), ("bigint", "numeric"), ("timestamp", "date"), ("double", "default"), ("interval", "numeric")])
def test_type_names(name, kind):
    assert profile.classify_type(name) == kind


def test_wildcards_and_describe(spark):
    work = spark.createDataFrame([("s", "*"), ("s", "t9")], "schema_name string, table_name string")
    cat = spark.createDataFrame([("s", "t1"), ("s", "t2"), ("o", "t3")], "schema_name string, table_name string")
    assert sorted(r.table_name for r in profile.expand_tables(work, cat).collect()) == ["t1", "t2", "t9"]
    rows = spark.createDataFrame([(1, "a", "int", None), (2, "", "", ""), (3, "# Partition", "", ""), (4, "b", "string", "x")], "i int, col_name string, data_type string, comment string")
    assert [(r.ordinal_position, r.column_name) for r in profile.parse_describe(rows, "i").orderBy("ordinal_position").collect()] == [(1, "a"), (2, "b")]


def test_statements_have_their_own_lines():
    same = "INSERT INTO db.target_table_with_a_long_name SELECT a_column FROM db.t WHERE dt = "
    sql = f"-- one\n{same}1;\n\n{same}2\n;\n/* a\n;b */ SELECT /* x\ny */ col\nFROM db.u -- c\n;;\n  -- last\nSELECT col -- d\n  , e FROM db.v"
    got = extract.statements_of(sql, "sql")
    assert [(s[1], s[2]) for s in got] == [(2, 2), (4, 4), (7, 9), (12, 13)]


def test_statements_are_split_outside_quotes():
    assert extract.split_statements("select ';' ; insert into t values (\"a;b\");x\;y") == ["select ';'", 'insert into t values ("a;b")', "x\;y"]


def test_extraction_by_language():
    py = 'q = 1\nmy_sql = """SELECT a\nFROM db.t"""\ncur.execute("INSERT INTO db.u VALUES (1)")\nx = "no statement"\n'
    assert [(s[0], s[1], s[2], s[4]) for s in extract.statements_of(py, "py")] == [("SELECT a\nFROM db.t", 2, 3, "my_sql"), ("INSERT INTO db.u VALUES (1)", 4, 4, "")]
    sh = "hive -e 'MSCK REPAIR TABLE db.t'\nbeeline -u x <<EOF\nSELECT 1\nEOF\nhive <<EOF\nSELECT col FROM db.v\nEOF\n"
    assert [s[0] for s in extract.statements_of(sh, "sh")] == ["MSCK REPAIR TABLE db.t", "SELECT col FROM db.v"]
    assert [s[3] for s in extract.statements_of("REFRESH db.t1;\nEXPLAIN CACHE TABLE db.t; SELECT a FROM b", "sql")] == ["impala", "spark", "generic"]
    assert extract.statements_of("", "sql") == [] and extract.statements_of("short", "sql") == []


def test_long_literal_does_not_break_extraction():
    assert len(extract.statements_of('sql = "SELECT ' + "a, " * 200_000 + '1"', "py")) == 1


def test_lineage(spark):
    rows = [
        (1, "WITH a AS (SELECT 1 FROM db.s), b AS (SELECT 2) INSERT OVERWRITE TABLE `db`.`t` SELECT * FROM a JOIN ${env}.x ON 1=1 LEFT OUTER JOIN db.y"),
        (2, "-- FROM db.no\nSHOW CREATE TABLE db.z"),
        (3, None),
        (4, "select * from plain"),
    ]
    got = {tuple(r) for r in lineage.tables(spark.createDataFrame(rows, "i int, q string"), "i", "q").collect()}
    assert got == {(1, "select_from", "db.s"), (1, "insert", "db.t"), (1, "join", "${env}.x"), (1, "join", "db.y"), (2, "show_table", "db.z"), (2, "create", "db.z")}
    bare = {tuple(r) for r in lineage.tables(spark.createDataFrame(rows, "i int, q string"), "i", "q", require_schema=False).collect()}
    assert (4, "select_from", "plain") in bare and (1, "select_from", "a") not in bare


def test_variables(spark):
    df = spark.createDataFrame([("T=abc\nT='x.y'\nU=$(date)\n", "from ${T}, $T and {T}, $TT {no}")], "d string, q string")
    got = df.select(lineage.definitions(F.col("d"), "sh").alias("m"), "q").select("m", lineage.substitute(F.col("q"), F.col("m")).alias("r")).first()
    assert got.m == {"T": "x.y"} and got.r == "from x.y, x.y and x.y, $TT {no}"


def test_ctes(spark):
    assert lineage.cte_names("with recursive r as (select (1)), s AS (with t as (select 2) select * from t) select") == ["r", "s", "t"]
    assert lineage.cte_names("select 1") == []


def test_classify(spark):
    df = spark.createDataFrame([(1, "from pyspark.sql import SparkSession"), (2, "hello"), (3, None), (4, "FROM pyflink import x")], "i int, t string")
    assert {r.i: r.family for r in classify.best(df, "i", "t").collect()} == {1: "spark", 2: "unknown", 3: "unknown", 4: "flink"}
    ev = classify.scores(df, "i", "t", [("a", "py(spark)", 5), ("a", "py(spark", 9), ("a", "\\bSpark\\w+", 3)], evidence=True).collect()
    assert [(r.score, r.evidence) for r in ev] == [(8, "spark (+5); SparkSession (+3)")]


def test_inventory(spark):
    old = spark.createDataFrame([("a", "已有", "1", "d0", "t"), ("b", "已有", "2", "d0", "t"), ("c", "删除", "3", "d0", "t")], "k string, status string, digest string, updated string, tag string")
    new = spark.createDataFrame([("a", "1"), ("c", "3"), ("n", "9")], "k string, digest string")
    got = {r.k: (r.status, r.updated, r.tag) for r in inventory.merge_snapshot(old, new, "k", ["tag"], F.lit("d1")).collect()}
    assert got == {"a": ("已有", "d0", "t"), "b": ("删除", "d1", "t"), "c": ("新增", "d1", "t"), "n": ("新增", "d1", None)}
    assert inventory.merge_snapshot(old, new.limit(0), "k", ["tag"], F.lit("d1")).filter("status = '删除'").count() == 3


def test_globs(spark):
    df = spark.createDataFrame([("a/test_x.py",), ("b/__pycache__/x.py",), ("b/x.py",), ("x.sql",)], "p string")
    assert [r.p for r in inventory.select_files(df, "p", "*.py", "test_*; __pycache__/").collect()] == ["b/x.py"]


def test_backfill(spark):
    df = spark.createDataFrame([(1, "20240228", "20240301"), (2, "20240301", "20240228"), (3, "20231231", "20231231"), (4, None, "20240101")], "i int, b string, e string")
    got = [(r.i, str(r.day)) for r in backfill.days(df, "b", "e").orderBy("i", "day").collect()]
    assert got == [(1, "2024-02-28"), (1, "2024-02-29"), (1, "2024-03-01"), (3, "2023-12-31")]


def test_placeholders(spark):
    df = spark.createDataFrame([("<a>/<b>/<zz>", "x", None)], "t string, a string, b string")
    v = {"a": F.col("a"), "b": F.col("b")}
    assert df.select(generate.substitute(F.col("t"), v)).first()[0] == "x//"
    assert df.select(generate.substitute(F.col("t"), v, unknown=None)).first()[0] == "x//<zz>"


def test_row_ids_are_consecutive(spark):
    got = [r.id for r in generate.row_ids(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), "k", 5).orderBy("k").collect()]
    assert got == list(range(5, 1005))


def test_deep_merge():
    assert generate.deep_merge({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "c": [1]}) == {"a": {"x": 1, "y": 3}, "b": 1, "c": [1]}


def test_rewrites(spark):
    code = "from pyspark.sql import SQLContext\ndf.registerTempTable('a')\ndf.unionAll(x).unionAll(y)\ndf.rdd.map(f)\n"
    r = rewrite.fold(spark.createDataFrame([(code,), ("x = 1",), (None,)], "t string"), "t").collect()
    assert "createOrReplaceTempView" in r[0].rewritten and ".union(x).union(y)" in r[0].rewritten and ".rdd.map(" in r[0].rewritten
    assert {(c.rule, c.hits) for c in r[0].changes} >= {("union_all_deprecated", 2)} and [w.rule for w in r[0].warnings] == ["rdd_map_warning"]
    assert r[1].rewritten == "x = 1" and r[1].changes == [] and r[2].rewritten is None


def test_flow_rewrites(spark):
    code = "from airflow.operators.dummy_operator import DummyOperator\nimport airflow.operators.subdag_operator\nDAG('a', schedule_interval=None, max_concurrency=1)\nDummyOperator(task_id='x', provide_context=True)\n"
    got = rewrite.upgrade_flows(spark.createDataFrame([(code,)], "t string"), "t").first().rewritten
    assert "from airflow.operators.empty import EmptyOperator" in got and "# REMOVED: import airflow" in got
    assert "schedule=None, max_concurrency=1" in got and "provide_context" not in got


def test_scores_stop_at_their_ends(spark):
    per = spark.createDataFrame([(1, 9, 9, 9), (2, 0, 0, 0), (3, 0, 2, 3)], "k int, errors int, warnings int, infos int")
    assert [r.grade for r in validate.flow_score(per).orderBy("k").collect()] == ["F", "A", "B"]
    assert [round(r.score, 2) for r in validate.spark_score(per).orderBy("k").collect()] == [0.0, 1.0, 0.74]


def test_lint_lines(spark):
    df = spark.createDataFrame([("a/b.py:3:1: E501 line too long",), ("noise",)], "l string")
    assert [tuple(r) for r in validate.lint_rows(df, "l").collect()] == [("a/b.py", 3, 1, "E501", "line too long", "error")]


FLOW = """
from airflow import DAG
NAME = "load"
dag = DAG(dag_id=f"{NAME}_{{x}}")
with dag:
    a = BashOperator(task_id="a" + "1", bash_command="cd /opt/jobs && sh run_%s.sh" % NAME)
    b = PythonOperator(task_id="b", python_callable=go)
    c = EmptyOperator(task_id="c")
    d = EmptyOperator(task_id="d")
    a >> [b, c] >> d
    d << a
    c.set_upstream(b)
"""


def test_flow():
    dags, tasks, edges = facts.flow(FLOW)
    assert dags == ["load_{x}"] and [t[0] for t in tasks] == ["a1", "b", "c", "d"]
    assert {e[:2] for e in edges} == {("a1", "b"), ("a1", "c"), ("b", "d"), ("c", "d"), ("a1", "d"), ("b", "c")}
    assert facts.flow("def broken(:") == ([], [], [])


def test_tasks_and_closure(spark):
    df = spark.createDataFrame([("/d/x.py", FLOW), ("/d/y.py", None)], "p string, t string")
    t = {r.task_id: r for r in facts.tasks(df, "p", "t").collect()}
    assert (t["a1"].command_dir, t["a1"].command_file, t["a1"].kind, t["a1"].dag_file) == ("/opt/jobs", "run_load.sh", "bash", "x.py")
    e = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c"), ("g", "c", "a"), ("h", "a", "z")], "dag_path string, upstream string, downstream string")
    got = {tuple(r) for r in facts.closure(e).collect()}
    assert got == {("g", x, y) for x in "abc" for y in "abc"} | {("h", "a", "z")}


def test_components_match_a_simple_search(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for x in root}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
