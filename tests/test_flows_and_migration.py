from __future__ import annotations

import json

import pytest
from loomwork.functions import settings
from loomwork.operators import facts, flows, lineage, migrate
from loomwork.plans import workflows as W
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def results(spark):
    df = spark.createDataFrame([*W.SPARK, ("/k/none.py", None)], "path string, text string").withColumn("status", F.lit("x"))
    return migrate.migrate(df, "path", "text", at=F.lit("2025-03-04 05:06:07").cast("timestamp")).cache()


def test_outcomes_and_totals(results):
    assert {r.path.rsplit("/", 1)[1]: r.status for r in results.collect()} == {"old_job.py": "success", "plain.py": "skipped", "new_job.py": "skipped", "broken.py": "failed", "a.sql": "failed", "none.py": "failed"}
    assert migrate.totals(results).first().asDict() == {"total": 6, "succeeded": 1, "skipped": 2, "failed": 3, "success_rate": 25.0}
    assert migrate.totals(results.limit(0)).first()["success_rate"] == 0.0


def test_backups_are_verified_and_restored(spark, results, tmp_path):
    into = str(tmp_path / "out")
    migrate.apply(results, into)
    texts = spark.read.parquet(f"{into}/backup")
    assert spark.read.parquet(f"{into}/new").first()["text"].startswith("from pyspark.sql import SparkSession")
    kept = migrate.manifest(results)
    assert migrate.verified(kept, texts).first()["is_intact"]
    assert [r.text for r in migrate.restored(kept, texts).collect()] == [W.OLD_SPARK]
    spoilt = texts.withColumn("text", F.concat("text", F.lit(" ")))
    assert not migrate.verified(kept, spoilt).first()["is_intact"] and migrate.restored(kept, spoilt).count() == 0
    assert not migrate.verified(kept, texts.limit(0)).first()["is_intact"]


def test_rollback_quotes_names(spark, results, tmp_path):
    odd = results.filter("status = 'success'").withColumn("path", F.lit("/a b/it's.py"))
    assert migrate.rollback_lines(odd).first()["line"].endswith(" '/a b/it'\\''s.py'")
    migrate.write_rollback(results, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).first()[0].startswith("set -e; cp '")


def test_reports(results):
    assert "| failed | 3 |" in migrate.report(results)
    assert "<td>3</td>" in migrate.report(results, "html")
    told = json.loads(migrate.report(results, "json"))
    assert told["totals"]["failed"] == 3 and {"kind": "failed", "files": 3} in told["recommendations"] and len(told["failed"]) == 3


def test_variables_inside_strings():
    import ast

    names = facts._assigned(ast.parse("a = 'x/{b}'\nb = '$c'\nc = '${c}-1'\nd = a + '/{{ ds }}'\n"))
    assert facts.expand("{a} $a ${d} {unknown} {{a}}", names) == "x/${c}-1 x/${c}-1 x/${c}-1/{{ ds }} {unknown} {{a}}"


def test_versions_and_empty_texts(spark):
    v = lambda t: [n for k, n, *_ in flows.structure(t) if k == "version"]
    assert v("from airflow.decorators import task\n@task\ndef f(): pass\n") == ["2.0+"] and v("import x\n") == ["2.x"] and v("(") == []
    df = spark.createDataFrame([(1, None), (2, "")], "id long, t string")
    assert [r.code for r in flows.checked(df, "id", "t").collect()] == ["dag_definition"]
    assert flows.structures(df.limit(0), "id", "t").count() == 0
    assert [r.requirement for r in flows.requirements(spark.createDataFrame([("airflow.providers.http.x",), ("os",), (None,)], "m string"), "m").collect()] == ["apache-airflow>=2.7.0", "apache-airflow-providers-http"]


def test_quotes_hide_parentheses_and_remarks(spark):
    assert lineage.cte_names("with a as (select ')' x, '--' y from t), b as (select 1) -- , c as (select 1)\nselect 1") == ["a", "b"]
    df = spark.createDataFrame([(1, "select '-- from x.y' from a.b -- from c.d\nwhere q = '/*' and r in (select 1 from e.f) /* from g.h */")], "id long, t string")
    assert {r.table_name for r in lineage.tables(df, "id", "t").collect()} == {"x.y", "a.b", "e.f"}


def test_settings_files(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    settings.save({"rules": {"x": [{"pattern": "q", "score": 2}], "y": [{"pattern": "z"}]}}, tmp_path / "loomwork.json")
    found = settings.find_upwards("loomwork.json", tmp_path / "a" / "b")
    assert settings.engine_rules(found) == [("x", "q", 2), ("y", "z", 1)] and settings.find_upwards("no such file", tmp_path) is None
    settings.save({"rules": [{"name": "n", "pattern": "p", "replacement": "r"}]}, tmp_path / "r.json")
    assert settings.rewrite_rules(tmp_path / "r.json") == [("n", "p", "r", 0, "3.0", True, True)]
