"""Queries on workflow definitions and migrations, over the code files together with a few definitions given here, with their SQL.

The tables hold no workflow definitions, so that these give the rows on which
the operators act; what is expected of them is written out in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts, flows, migrate, rewrite, validate
from ..session import spread, table
from .code import _lit

OLD_FLOW = """from airflow import DAG
from airflow.operators.python_operator import PythonOperator
from airflow.operators.dummy_operator import DummyOperator
from airflow.contrib.operators.ssh_operator import SSHOperator
from airflow.models import Variable

BASE = '/opt/jobs'
SCRIPT = '{BASE}/load.sh'
owner = Variable.get('team_owner')
dag = DAG(dag_id='1_nightly', schedule_interval='@daily', concurrency=4)
start = DummyOperator(task_id='start', dag=dag)
load = SSHOperator(task_id='load', command='cd ${BASE} && sh $SCRIPT', ssh_conn_id='edge', dag=dag)
check = PythonOperator(task_id='check_%s' % 'all', python_callable=run_check, provide_context=True, dag=dag)
orphan = PythonOperator(python_callable=run_check)
start >> load >> check
orphan.set_upstream(check)
"""
NEW_FLOW = """import pendulum
from airflow.decorators import dag, task
from airflow.providers.ssh.hooks.ssh import SSHHook
from airflow.sensors.filesystem import FileSensor

@dag(dag_id='weekly', schedule='@weekly', catchup=False, tags=['a', 'b'])
def weekly():
    wait = FileSensor(task_id='wait', filepath='/in/x', fs_conn_id='files')

    @task
    def pull(ti=None):
        SSHHook(ssh_conn_id='edge')
        return ti.xcom_pull(task_ids='wait'), '{{ execution_date }}'

    wait >> pull()

weekly()
"""
BROKEN_FLOW = "from airflow import DAG\ndag = DAG(dag_id='x'\n"
NO_FLOW = "def f(x):\n    return x + 1\n"
FLOWS = [("/known/old_flow.py", OLD_FLOW), ("/known/new_flow.py", NEW_FLOW), ("/known/broken_flow.py", BROKEN_FLOW), ("/known/no_flow.py", NO_FLOW), ("/known/notes.txt", "DAG(")]

OLD_SPARK = """from pyspark.sql import SQLContext
from pyspark import SparkContext
sc = SparkContext()
df = sqlContext.read.parquet('x')
df.unionAll(df).registerTempTable('t')
df.rdd.map(f).collect()
"""
SPARK = [("/known/old_job.py", OLD_SPARK), ("/known/plain.py", NO_FLOW), ("/known/new_job.py", "from pyspark.sql import SparkSession\nspark = SparkSession.builder.getOrCreate()\n"), ("/known/broken.py", "import pyspark\nx = (\n"), ("/known/a.sql", "select 1")]


def _with(spark: SparkSession, d: str, known: list[tuple[str, str]]) -> DataFrame:
    """path, text: all code files and the known ones."""
    files = table(spark, d, "code_file").select(F.col("file_path").alias("path"), F.col("raw_code").alias("text"))
    return spread(files.union(spark.createDataFrame(known, "path string, text string")))


def _flows(spark: SparkSession, d: str) -> DataFrame:
    return _with(spark, d, FLOWS).filter("path like '%.py' and text rlike 'DAG\\\\(|@dag|airflow'")


def flow_tasks(spark: SparkSession, d: str) -> DataFrame:
    return facts.tasks(_flows(spark, d), "path", "text").select("dag_file", "dag_id", "task_id", "operator", "kind", "command", "command_dir", "command_file", "line_no")


def flow_edges(spark: SparkSession, d: str) -> DataFrame:
    return facts.edges(_flows(spark, d), "path", "text")


def flow_reach(spark: SparkSession, d: str) -> DataFrame:
    """All tasks that come after a task, directly or through others."""
    return facts.closure(flow_edges(spark, d))


def flow_structure(spark: SparkSession, d: str) -> DataFrame:
    return flows.structures(_flows(spark, d), "path", "text").filter("kind not in ('import', 'edge')")


def flow_imports(spark: SparkSession, d: str) -> DataFrame:
    return flows.structures(_flows(spark, d), "path", "text").filter("kind = 'import'").select("path", F.col("name").alias("module"), F.col("detail").alias("imported"), "line_no")


def flow_issues(spark: SparkSession, d: str) -> DataFrame:
    return flows.checked(_flows(spark, d), "path", "text")


def flow_grades(spark: SparkSession, d: str) -> DataFrame:
    return validate.flow_score(validate.tally(flow_issues(spark, d), "path"))


def flow_warnings(spark: SparkSession, d: str) -> DataFrame:
    return flows.warned(_flows(spark, d), "path", "text")


def flow_rewrites(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the rewritten definitions that differ from the line that stood there."""
    new = rewrite.upgrade_flows(_flows(spark, d), "text").filter("path like '/known/%flow.py'")
    lines = new.select("path", F.posexplode(F.arrays_zip(F.split("rewritten", "\n").alias("line"), F.split("text", "\n").alias("old"))).alias("i", "l"))
    return lines.filter("coalesce(l.line, '') <> coalesce(l.old, '')").select("path", (F.col("i") + 1).alias("line_no"), "l.line")


def flow_migration(spark: SparkSession, d: str) -> DataFrame:
    got = migrate.migrate_flows(_with(spark, d, FLOWS).filter("path like '/known/%' or text rlike 'airflow'"), "path", "text", at=F.lit("2025-03-04 05:06:07").cast("timestamp"))
    return got.select("path", "status", "source_version", "grade", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "backup_path")


def flow_requirements(spark: SparkSession, d: str) -> DataFrame:
    mods = flows.structures(_flows(spark, d), "path", "text").filter("kind = 'import'")
    return flows.requirements(rewrite.moved(mods, "name").select(F.coalesce("new_module", "name").alias("module")), "module")


def _migrated(spark: SparkSession, d: str) -> DataFrame:
    return migrate.migrate(_with(spark, d, SPARK), "path", "text", at=F.lit("2025-03-04 05:06:07").cast("timestamp"))


def migrations(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of the known files; all code files are migrated with them."""
    got = _migrated(spark, d).filter("path like '/known/%'")
    return got.select("path", "status", F.array_join("changes", ",").alias("changes"), F.array_join("warnings", ",").alias("warnings"), F.array_join("errors", ",").alias("errors"), F.round("score", 6).alias("score"), "backup_path")


def migration_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals over the known files and the code files that are no Python."""
    return migrate.totals(_migrated(spark, d).filter("path like '/known/%' or not path like '%.py'"))


def rollback_script(spark: SparkSession, d: str) -> DataFrame:
    return migrate.rollback_lines(_migrated(spark, d).filter("path like '/known/%'"))


def migration_advice(spark: SparkSession, d: str) -> DataFrame:
    return migrate.recommendations(_migrated(spark, d).filter("path like '/known/%'"))


def intact_backups(spark: SparkSession, d: str) -> DataFrame:
    """Backups of all statements' texts checked against texts of which some were changed or lost since."""
    src = table(spark, d, "extracted_sql").filter("sql is not null").select(F.concat(F.lit("/b/"), F.col("sql_id").cast("string")).alias("path"), F.col("sql").alias("text"), "sql_id")
    made = src.select(F.col("path").alias("original_path"), F.col("path").alias("backup_path"), F.sha2("text", 256).alias("file_hash"), F.octet_length("text").alias("size"))
    now = src.filter("sql_id % 5 <> 0").withColumn("text", F.when(F.col("sql_id") % 7 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    return migrate.verified(made, now.select("path", "text")).groupBy("is_intact").agg(F.count("*").alias("backups"))


def restored_texts(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "extracted_sql").filter("sql is not null").select(F.concat(F.lit("/b/"), F.col("sql_id").cast("string")).alias("path"), F.col("sql").alias("text"), "sql_id")
    made = src.select(F.concat(F.lit("/o"), "path").alias("original_path"), F.col("path").alias("backup_path"), F.sha2("text", 256).alias("file_hash"))
    return migrate.restored(made, src.filter("sql_id % 5 <> 0").select("path", "text")).select("path", F.length("text").alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (
        flow_tasks, flow_edges, flow_reach, flow_structure, flow_imports, flow_issues, flow_grades, flow_warnings, flow_rewrites, flow_migration, flow_requirements,
        migrations, migration_totals, rollback_script, migration_advice, intact_backups, restored_texts,
    )
}


def _values(columns: str, rows: list[tuple]) -> str:
    """A table of literals."""
    show = lambda v: "NULL" if v is None else _lit(v) if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({columns})"


_OLD, _NEW, _BROKEN, _NO = "/known/old_flow.py", "/known/new_flow.py", "/known/broken_flow.py", "/known/no_flow.py"
_EDGES = _values("dag_path, upstream, downstream, line_no", [(_OLD, "start", "load", 15), (_OLD, "load", "check_all", 15), (_OLD, "check_all", "orphan", 16), (_NEW, "wait", "pull", 15)])
_TALLIES = [(_OLD, 4, 8, 1, 0, "F", False), (_NEW, 0, 1, 2, 93, "A", True), (_BROKEN, 1, 0, 0, 80, "B", False)]
SQL = {
    "flow_tasks": _values(
        "dag_file, dag_id, task_id, operator, kind, command, command_dir, command_file, line_no",
        [
            ("old_flow.py", "1_nightly", "start", "DummyOperator", "empty", "", "", "", 11),
            ("old_flow.py", "1_nightly", "load", "SSHOperator", "other", "cd /opt/jobs && sh /opt/jobs/load.sh", "/opt/jobs", "/opt/jobs/load.sh", 12),
            ("old_flow.py", "1_nightly", "check_all", "PythonOperator", "python", "{run_check}", "", "", 13),
            ("new_flow.py", "unknown", "wait", "FileSensor", "sensor", "", "", "", 8),
        ],
    ),
    "flow_edges": _EDGES,
    "flow_reach": f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT dag_path, upstream, downstream FROM e UNION SELECT r.dag_path, r.upstream, e.downstream FROM r JOIN e ON r.dag_path = e.dag_path AND r.downstream = e.upstream) SELECT * FROM r",
    "flow_structure": _values(
        "path, kind, name, detail, line_no",
        [
            (_OLD, "version", "2.x (deprecated imports)", "", 0), (_OLD, "variable", "team_owner", "", 9), (_OLD, "config", "concurrency", "4", 10),
            (_OLD, "config", "dag_id", "1_nightly", 10), (_OLD, "config", "schedule_interval", "@daily", 10), (_OLD, "operator", "DummyOperator", "start", 11),
            (_OLD, "connection", "edge", "", 12), (_OLD, "operator", "SSHOperator", "load", 12), (_OLD, "operator", "PythonOperator", "check_all", 13),
            (_OLD, "operator", "PythonOperator", "", 14), (_NEW, "version", "2.4+", "", 0), (_NEW, "config", "catchup", "False", 6),
            (_NEW, "config", "dag_id", "weekly", 6), (_NEW, "config", "schedule", "@weekly", 6), (_NEW, "config", "tags", "['a', 'b']", 6),
            (_NEW, "decorator", "dag", "", 6), (_NEW, "connection", "files", "", 8), (_NEW, "sensor", "FileSensor", "wait", 8),
            (_NEW, "decorator", "task", "", 10), (_NEW, "connection", "edge", "", 12), (_NEW, "hook", "SSHHook", "", 12), (_BROKEN, "syntax_error", "", "", 0),
        ],
    ),
    "flow_imports": _values(
        "path, module, imported, line_no",
        [
            (_OLD, "airflow", "DAG", 1), (_OLD, "airflow.operators.python_operator", "PythonOperator", 2), (_OLD, "airflow.operators.dummy_operator", "DummyOperator", 3),
            (_OLD, "airflow.contrib.operators.ssh_operator", "SSHOperator", 4), (_OLD, "airflow.models", "Variable", 5), (_NEW, "pendulum", "", 1),
            (_NEW, "airflow.decorators", "dag", 2), (_NEW, "airflow.decorators", "task", 2), (_NEW, "airflow.providers.ssh.hooks.ssh", "SSHHook", 3),
            (_NEW, "airflow.sensors.filesystem", "FileSensor", 4),
        ],
    ),
    "flow_issues": _values(
        "path, severity, code, detail, line_no",
        [
            (_OLD, "warning", "deprecated_operator", "DummyOperator", 0),
            *((_OLD, "warning", "deprecated_import", f"airflow.operators.{m}", n) for n, m in ((2, "python_operator"), (2, "python_operator.PythonOperator"), (3, "dummy_operator"), (3, "dummy_operator.DummyOperator"))),
            *((_OLD, "error", c, f"airflow.contrib.operators.ssh_operator{x}", 4) for c in ("contrib_import", "removed_import") for x in ("", ".SSHOperator")),
            (_OLD, "warning", "dag_id_naming", "1_nightly", 10), (_OLD, "warning", "deprecated_param", "schedule_interval", 10), (_OLD, "info", "unnecessary_param", "provide_context", 13),
            (_OLD, "warning", "missing_task_id", "PythonOperator", 14), (_NEW, "warning", "jinja_template", "execution_date", 0), (_NEW, "info", "timezone", "", 0),
            (_NEW, "info", "xcom_style", "", 0), (_BROKEN, "error", "syntax", "", 0),
        ],
    ),
    "flow_grades": _values("path, errors, warnings, infos, score, grade, is_compatible", _TALLIES),
    "flow_warnings": _values("path, severity, code, detail, line_no", [(_OLD, "info", "variable", "", 0), (_NEW, "warning", "execution_date", "", 0), (_NEW, "info", "xcom", "", 0)]),
    "flow_rewrites": _values(
        "path, line_no, line",
        [
            (_OLD, 2, "from airflow.operators.python import PythonOperator"), (_OLD, 3, "from airflow.operators.empty import EmptyOperator"), (_OLD, 4, "from airflow.providers.ssh.operators.ssh import SSHOperator"),
            (_OLD, 10, "dag = DAG(dag_id='1_nightly', schedule='@daily', max_active_tasks=4)"), (_OLD, 11, "start = EmptyOperator(task_id='start', dag=dag)"),
            (_OLD, 13, "check = PythonOperator(task_id='check_%s' % 'all', python_callable=run_check, dag=dag)"),
        ],
    ),
    "flow_migration": _values(
        "path, status, source_version, grade, errors, warnings, backup_path",
        [
            (_OLD, "success", "2.x (deprecated imports)", "A", "", "dag_id_naming,missing_task_id", "/known/old_flow_20250304_050607.py"),
            (_NEW, "success", "2.4+", "A", "", "jinja_template", "/known/new_flow_20250304_050607.py"), (_BROKEN, "failed", None, "B", "syntax", "", None),
            (_NO, "skipped", "2.x", "A", "", "dag_definition", None), ("/known/notes.txt", "failed", None, "B", "syntax", "", None),
        ],
    ),
    "flow_requirements": _values("requirement, part", [("apache-airflow>=2.7.0", 0), ("apache-airflow-providers-ssh", 1)]),
    "migrations": _values(
        "path, status, changes, warnings, errors, score, backup_path",
        [
            ("/known/old_job.py", "success", "import_spark_context_deprecated,import_sql_context_deprecated,spark_context_to_session,register_temp_table,union_all_deprecated", "rdd_map_warning", "", 0.98, "/known/old_job_20250304_050607.py"),
            ("/known/plain.py", "skipped", "", "no Spark code", "", 0.0, None), ("/known/new_job.py", "skipped", "", "", "", 1.0, None),
            ("/known/broken.py", "failed", "", "", "does not parse", 0.0, None), ("/known/a.sql", "failed", "", "", "not a Python file", 0.0, None),
        ],
    ),
    "migration_totals": "SELECT 5 + n AS total, 1 AS succeeded, 2 AS skipped, 2 + n AS failed, round(100.0 / (3 + n), 2) AS success_rate FROM (SELECT count(*) AS n FROM code_file WHERE file_path NOT LIKE '%.py')",
    "rollback_script": _values("path, line", [("/known/old_job.py", "cp '/known/old_job_20250304_050607.py' '/known/old_job.py'")]),
    "migration_advice": _values("kind, files", [("failed", 2), ("warnings", 2)]),
    "intact_backups": "SELECT sql_id % 5 <> 0 AND sql_id % 7 <> 0 AS is_intact, count(*) AS backups FROM extracted_sql WHERE sql IS NOT NULL GROUP BY 1",
    "restored_texts": "SELECT '/o/b/' || sql_id AS path, length(sql) AS chars FROM extracted_sql WHERE sql IS NOT NULL AND sql_id % 5 <> 0",
}
