from __future__ import annotations

import json

from loomwork import cli
from loomwork.operators import catalog
from loomwork.sources import files
from loomwork.streaming import windows
from pyspark.sql import functions as F


def test_code_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "sub" / "b.sql").write_bytes("select '数据'".encode("gbk"))
    (tmp_path / "sub" / "test_c.py").write_text("")
    got = {r.path: r.raw_code for r in files.code_files(spark, str(tmp_path), "*.py;*.sql", "test_*").collect()}
    assert got == {"a.py": "x = 1\n", "sub/b.sql": "select '数据'"}


def test_extensions():
    assert files.extensions_of(["*.py", "x/*.hql", "*"]) == [".hql", ".py"]
    assert files.extensions_of(["*"]) == sorted(files.EXTENSIONS)


def test_written_statements(spark, tmp_path):
    df = spark.createDataFrame([("a/b.py", 3, 4, "select 2"), ("a/b.py", 1, 2, "select 1")], "source_file string, line_start int, line_end int, sql string")
    files.write_statements(df, str(tmp_path / "o"), "sql")
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").rglob("*.txt")))
    assert text.index("select 1;") < text.index("select 2;")


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "a.sql").write_text("insert overwrite table d.t select * from d.s")
    assert cli.main(["lineage", str(tmp_path)]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert {(r["stmt_type"], r["table_name"]) for r in rows} == {("insert", "d.t"), ("select_from", "d.s")}
    for c in ("classify", "extract", "ctes", "inventory", "tasks", "edges", "facts", "lint", "score", "preview", "preview-flows"):
        assert cli.main([c, str(tmp_path)]) == 0


def test_catalog(spark):
    assert catalog.changes(spark, "syntax", fixable=False).count() > 0
    assert catalog.changes(spark, upto="2.4").count() == 0 and catalog.changes(spark, upto="3.10").count() == catalog.changes(spark).count()
    df = spark.createDataFrame([("from airflow.operators.subdag_operator import x",), ("from os import y",)], "l string")
    got = [r[0] for r in df.select(catalog.new_import(F.col("l"))).collect()]
    assert got == ["# REMOVED: from airflow.operators.subdag_operator import x", "from os import y"]


def test_stream_drops_late_rows_and_keeps_state(spark, tmp_path):
    schema = "k string, value double, ts timestamp"
    src = str(tmp_path / "in")
    spark.sql("select 'a' k, 1.0d value, timestamp'2024-01-01 00:00:00' ts").write.parquet(src)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: windows.drain(windows.tumbling(spark.readStream.schema(schema).parquet(src), "ts", "10 minutes", ["k"], "10 minutes"), out, state)
    run()
    spark.sql("select 'a' k, 2.0d value, timestamp'2024-01-01 05:00:00' ts").write.mode("append").parquet(src)
    run()
    spark.sql("select 'a' k, 4.0d value, timestamp'2024-01-01 00:05:00' ts union all select 'a', 8.0d, timestamp'2024-01-01 09:00:00'").write.mode("append").parquet(src)
    got = {(str(r.window_start), r.total) for r in run().collect()}
    assert ("2024-01-01 00:00:00", 1.0) in got and not any(t == 5.0 or t == 4.0 for _, t in got)


def test_keyed_reduce(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "k string, value double").coalesce(1).write.parquet(src)
    stream = windows.running_totals(spark.readStream.schema("k string, value double").parquet(src), "k", "value")
    q = stream.writeStream.outputMode("update").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.k, r.n, r.total) for r in spark.table("totals").collect()} == {("a", 2, 4.0), ("b", 1, 2.0)}
