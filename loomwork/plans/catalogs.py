"""Queries on the catalogs of changes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalogs as C
from ..operators import catalog
from ..session import table


def catalog_changes(spark: SparkSession, d: str) -> DataFrame:
    return catalog.changes(spark)


def catalog_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.changes(spark).groupBy("kind", "version").agg(F.count("*").alias("n"), F.count_if("auto_fixable").alias("fixable"))


def catalog_renames(spark: SparkSession, d: str) -> DataFrame:
    return catalog.renames(spark).groupBy("kind", "change").agg(F.count("*").alias("n"))


def deprecated_hits(spark: SparkSession, d: str) -> DataFrame:
    return catalog.deprecated_hits(table(spark, d, "code_file").filter("file_path like '%.py'"), "file_id", "raw_code")


#: Import lines of old workflow definitions.
_OLD_LINES = [
    "from airflow.operators.bash_operator import BashOperator", "from airflow.operators.subdag_operator import SubDagOperator", "import airflow.operators.python_operator as p",
    "from airflow.models import DAG", "import airflow",
]


def new_imports(spark: SparkSession, d: str) -> DataFrame:
    """Every import line of the Python files and of a few old ones given here, with modules of the catalog moved."""
    lines = table(spark, d, "code_file").filter("file_path like '%.py'").select(F.explode(F.split("raw_code", "\n")).alias("line"))
    lines = lines.union(spark.createDataFrame([(x,) for x in _OLD_LINES], "line string"))
    return lines.filter(F.col("line").rlike("^(from|import) ")).groupBy(catalog.new_import(F.col("line")).alias("line")).agg(F.count("*").alias("uses"))


def new_params(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.create_map(F.lit("schedule_interval"), "event_type", F.lit("made_up"), "event_type", F.lit("orientation"), F.lit("LR")).alias("p"))
    m = catalog.new_params(F.col("p"))
    return e.select("event_id", F.element_at(m, "schedule").alias("schedule"), F.size(m).alias("n"))


def new_templates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("{{execution_date}} {{ next_ds }} {{ ds }} "), "event_type").alias("t"))
    return e.select("event_id", catalog.new_templates(F.col("t")).alias("t"))


def _lit(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


_N = {"api": len(C.API_CHANGES), "config": len(C.CONFIG_CHANGES), "deprecation": len(C.DEPRECATIONS), "syntax": len(C.SYNTAX_CHANGES)}
QUERIES = {f.__name__: f for f in (catalog_changes, catalog_counts, catalog_renames, deprecated_hits, new_imports, new_params, new_templates)}
SQL = {
    "deprecated_hits": " UNION ALL ".join(
        f"SELECT file_id, {_lit(p)} AS pattern, {_lit(s)} AS severity, len(regexp_extract_all(raw_code, {_lit(p)}))::INT AS hits FROM code_file WHERE file_path LIKE '%.py' AND regexp_matches(raw_code, {_lit(p)})"
        for _, p, _, _, s in C.DEPRECATIONS
    ),
    "new_imports": f"""WITH mv(old, new) AS (VALUES {", ".join(f"({_lit(a)}, {_lit(b)})" for a, b in C.MODULES)}),
l AS (SELECT unnest(string_split(raw_code, chr(10))) AS line FROM code_file WHERE file_path LIKE '%.py' UNION ALL SELECT unnest([{", ".join(map(_lit, _OLD_LINES))}])),
m AS (SELECT line, coalesce(nullif(regexp_extract(line, '^\\s*from\\s+([\\w.]+)\\s+import\\b', 1), ''), regexp_extract(line, '^\\s*import\\s+([\\w.]+)', 1)) AS module FROM l WHERE regexp_matches(line, '^(from|import) '))
SELECT CASE WHEN old IS NULL THEN line WHEN new IS NULL THEN '# REMOVED: ' || line ELSE replace(line, module, new) END AS line, count(*) AS uses FROM m LEFT JOIN mv ON module = old GROUP BY 1""".replace("\\\\", "\\"),
    "new_params": "SELECT event_id, event_type AS schedule, 2 AS n FROM events",
    "new_templates": "SELECT event_id, '{{ logical_date }} {{ data_interval_end | ds }} {{ ds }} ' || event_type AS t FROM events",
}
