"""Queries on small texts given here, what is expected of which is written out in the SQL; and results that another engine can compute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalogs as C
from ..operators import classify, extract, facts, generate, inventory, lineage, profile, rewrite, validate
from ..session import spread, table, work_path
from ..sources import files as sources
from .code import _TABLES, folded
from .workflows import _values

PYTHON = '''import os
from pyspark.sql import SparkSession as S, functions as F
spark = S.builder.getOrCreate()
load_sql = """
SELECT a, b  FROM db.t
WHERE a > 1
"""
spark.conf.set("spark.sql.shuffle.partitions", 8)
df = spark.sql("insert into db.u select * from db.t")
df.unionAll(df).filter("a > 1").rdd.map(f).collect()
print(",".join(names))
note = "not a statement"
'''
SHELL = """#!/bin/bash
# from nowhere.at_all
day=20250101
db="sales"
hive -e "INSERT OVERWRITE TABLE ${db}.daily PARTITION (dt='$day')
SELECT * FROM ${db}.${kind}"
beeline <<EOF
select count(*) from $db.daily;
EOF
"""
SCRIPT = """-- first; not the end
select 'a;b' as x, "c;d" from db.one; /* two
lines */ update db.two set a = 1 where b = '--';
x;
with c as (select ')' y from db.three), d as (select 1), e as (select * from c) select * from c join e on 1 = 1
"""
BROKEN = "def f(:\n"
TEXTS = [(1, "/k/a.py", PYTHON), (2, "/k/b.sh", SHELL), (3, "/k/c.sql", SCRIPT), (4, "/k/d.py", BROKEN), (5, "/k/e.sql", None), (6, "/k/f.sql", "")]


def _known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXTS, "id long, path string, text string")


def known_statements(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract(_known(spark), "path", "text").select("source_file", "ordinal", "sql", "line_start", "line_end", "sql_type", "context")


def known_summary(spark: SparkSession, d: str) -> DataFrame:
    files = _known(spark).filter("text is not null")
    return extract.summary(files, extract.extract(files, "path", "text"), "path")


def known_facts(spark: SparkSession, d: str) -> DataFrame:
    return facts.facts(_known(spark).filter("path like '%.py'"), "id", "text").filter("kind <> 'call'")


def known_evidence(spark: SparkSession, d: str) -> DataFrame:
    return classify.scores(_known(spark).filter("id <= 2"), "id", "text", evidence=True).select("id", "family", "score", "evidence")


def known_variables(spark: SparkSession, d: str) -> DataFrame:
    return lineage.resolved(_known(spark).filter("id = 2"), "path", "text").select("id", F.array_sort(F.map_keys("values")).alias("names"), F.split("clean", "\n")[4].alias("line_5"), F.split("clean", "\n")[5].alias("line_6"))


def known_tables(spark: SparkSession, d: str) -> DataFrame:
    got = lineage.analysis(_known(spark), "id", "path", "text")
    return got.select("id", F.array_join("all_tables", " ").alias("all_tables"), F.array_join(F.transform(F.map_entries("variable_tables"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+"))), " ").alias("variables"))


def known_listing(spark: SparkSession, d: str) -> DataFrame:
    return lineage.listing(lineage.analysis(_known(spark), "id", "path", "text").filter("id = 3"), "id")


def known_ctes(spark: SparkSession, d: str) -> DataFrame:
    return lineage.ctes(_known(spark), "id", "text").select("id", F.array_join("cte_names", " ").alias("names"), "total", "is_recursive", "is_multiple")


def file_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Tables of every SQL file: how many, and how many names have open variables."""
    files = spread(table(spark, d, "code_file").filter("file_path rlike '\\\\.(sql|hql)$'").select("file_id", "file_path", "raw_code"))
    got = lineage.analysis(files, "file_id", "file_path", "raw_code")
    return got.select("file_id", F.size("all_tables").alias("tables"), F.size("variable_tables").alias("open_names"))


def rewritten_files(spark: SparkSession, d: str) -> DataFrame:
    """All rules over all Python files: digest of the new text, rules that changed it and that only warn, in order."""
    src = spread(table(spark, d, "code_file").filter("file_path like '%.py' and raw_code is not null").select("file_id", "raw_code"))
    names = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["rule"], F.lit("="), x["hits"].cast("string"))), " ")
    return rewrite.fold(src, "raw_code").select("file_id", F.md5("rewritten").alias("digest"), names("changes").alias("changes"), names("warnings").alias("warnings"))


def star_imports(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "code_file").filter("file_path like '%.py'").select("file_id", "raw_code")
    known = spark.createDataFrame([(-1, "from a.b import *\nfrom c import d\n    from e import  * # x")], "file_id long, raw_code string")
    return validate.star_imports(files.union(known), "file_id", "raw_code")


def value_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of the kinds of events of each user."""
    return profile.entropy(table(spark, d, "events"), ["user_id"], "event_type").withColumn("entropy", F.round("entropy", 6))


def extract_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Files by what became of them; the known files, and as many that hold no SQL as there are JSON files."""
    files = table(spark, d, "code_file").filter("file_path like '%.json'").select(F.col("file_path").alias("path"), F.col("raw_code").alias("text"))
    return extract.outcomes(files.union(_known(spark).select("path", "text")), "path", "text")


def escaped_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Script documents whose content is escaped twice, read back once."""
    files = table(spark, d, "code_file").filter("file_path like '%.sql' and raw_code is not null")
    got = generate.scripts(files, "file_path", "raw_code", "/srv/git", {"owner": "etl"}, twice=True)
    return got.select("file_path", F.md5(F.get_json_object("document", "$.content")).alias("digest"))


def mirrored_files(spark: SparkSession, d: str) -> DataFrame:
    """JSON and shell files written as a mirrored tree under another suffix, and read back."""
    path = work_path(spark, "mirror")
    sources.write_mirrored(table(spark, d, "code_file").filter("file_path rlike '\\\\.(json|sh)$'"), "file_path", "raw_code", "/srv/git", path, ".script")
    return sources.read_mirrored(spark, path).select("folder", "name", F.md5("text").alias("digest"))


def dated_attributes(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "code_file").filter("raw_code is not null and read_at is not null")
    got = inventory.attributes(files, "file_path", "raw_code", modified="read_at")
    return got.select("directory", "name", "modified")


def size_texts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("doc_id is not null").select("doc_id", (F.col("n_chars") * F.pow(F.lit(10), F.col("doc_id") % 8)).cast("long").alias("size"))
    return t.select("doc_id", inventory.size_text(F.col("size")).alias("size"))


QUERIES = {
    f.__name__: f
    for f in (
        known_statements, known_summary, known_facts, known_evidence, known_variables, known_tables, known_listing, known_ctes, file_lineage, rewritten_files, star_imports,
        value_entropy, extract_outcomes, escaped_scripts, mirrored_files, dated_attributes, size_texts,
    )
}
_C_CASE = "with c as (select ')' y from db.three), d as (select 1), e as (select * from c) select * from c join e on 1 = 1"
_CHANGES = [
    *(("api", c, o, n, v, None, False, True) for c, o, n, v in C.API_CHANGES),
    *(("config", c, o, n, v, None, False, f) for c, o, n, v, _, f in C.CONFIG_CHANGES),
    *(("deprecation", c, o, n, v, s, True, False) for c, o, n, v, s in C.DEPRECATIONS),
    *(("syntax", c, o, n, v, None, r, f) for c, o, n, v, r, f in C.SYNTAX_CHANGES),
]
_CATALOG = _values('kind, category, "old", "new", version, severity, is_regex, auto_fixable', _CHANGES)
_RENAMES = [
    *(("module", *r) for r in C.MODULES), *(("class", *r) for r in C.CLASSES), *(("operator", *r) for r in C.OPERATORS), *(("dag_param", *r) for r in C.DAG_PARAMS),
    *(("operator_param", *r) for r in C.OPERATOR_PARAMS), *(("context", *r) for r in C.CONTEXT), *(("template", *r) for r in C.TEMPLATES), *(("connection", *r) for r in C.CONNECTIONS),
    *((f"section {s}", o, n) for s, o, n in C.SECTIONS),
]
SQL = {
    "known_statements": _values(
        "source_file, ordinal, sql, line_start, line_end, sql_type, context",
        [
            ("/k/a.py", 1, "SELECT a, b FROM db.t\nWHERE a > 1", 4, 7, "generic", "load_sql"), ("/k/a.py", 2, "insert into db.u select * from db.t", 9, 9, "generic", ""),
            ("/k/b.sh", 1, "INSERT OVERWRITE TABLE ${db}.daily PARTITION (dt='$day')\nSELECT * FROM ${db}.${kind}", 5, 6, "generic", ""),
            ("/k/b.sh", 2, "select count(*) from $db.daily;", 7, 9, "generic", ""), ("/k/c.sql", 1, "select 'a;b' as x, \"c;d\" from db.one", 2, 2, "generic", "stmt"),
            ("/k/c.sql", 2, "update db.two set a = 1 where b = '--'", 3, 3, "generic", "stmt"), ("/k/c.sql", 3, _C_CASE, 5, 5, "generic", "stmt"),
        ],
    ),
    "known_summary": _values("files, with_sql, without_sql, statements", [(5, 3, 2, 7)]),
    "star_imports": r"""SELECT file_id, line_no::INT AS line_no, module FROM (SELECT file_id, line_no, regexp_extract(l, '^\s*from\s+([\w.]+)\s+import\s+\*', 1) AS module FROM (
SELECT file_id, unnest(string_split(raw_code, chr(10))) AS l, generate_subscripts(string_split(raw_code, chr(10)), 1) AS line_no FROM code_file WHERE file_path LIKE '%.py')) WHERE module <> ''
UNION ALL SELECT -1, 1, 'a.b' UNION ALL SELECT -1, 3, 'e'""",
    "value_entropy": "SELECT user_id, round(entropy(event_type), 6) AS entropy FROM events GROUP BY user_id",
    "extract_outcomes": "SELECT n + 6 AS files, 3 AS with_sql, 2 AS without_sql, n AS skipped, 1 AS errors, 7 AS statements FROM (SELECT count(*) AS n FROM code_file WHERE file_path LIKE '%.json')",
    "escaped_scripts": r"""SELECT file_path, md5(replace(replace(replace(replace(replace(raw_code, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), ''), chr(9), '\t')) AS digest
FROM code_file WHERE file_path LIKE '%.sql' AND raw_code IS NOT NULL""",
    "mirrored_files": r"""SELECT coalesce(nullif(regexp_replace(p, '/?[^/]*$', ''), ''), '.') AS folder, regexp_replace(regexp_extract(p, '[^/]*$'), '\.[^.]*$', '') || '.script' AS name, md5(raw_code) AS digest
FROM (SELECT regexp_replace(file_path, '^/srv/git/?', '') AS p, raw_code FROM code_file WHERE regexp_matches(file_path, '\.(json|sh)$') AND trim(raw_code) <> '')""",
    "dated_attributes": r"""SELECT regexp_replace(file_path, '/[^/]*$', '') AS directory, regexp_extract(file_path, '[^/]*$') AS name, strftime(read_at, '%Y-%m-%d %H:%M:%S') AS modified
FROM code_file WHERE raw_code IS NOT NULL AND read_at IS NOT NULL""",
    "size_texts": """SELECT doc_id, CASE WHEN s >= 1073741824 THEN printf('%.1f GB', floor(s * 10 / 1073741824 + 0.5) / 10) WHEN s >= 1048576 THEN printf('%.1f MB', floor(s * 10 / 1048576 + 0.5) / 10) WHEN s >= 1024 THEN printf('%.1f KB', floor(s * 10 / 1024 + 0.5) / 10) ELSE s || ' B' END AS size
FROM (SELECT doc_id, (n_chars * power(10, doc_id % 8))::BIGINT AS s FROM documents WHERE doc_id IS NOT NULL)""",
    "known_facts": _values(
        '"key", kind, name, detail, line_no',
        [
            (1, "import", "os", "", 1), (1, "import", "pyspark.sql", "SparkSession", 2), (1, "import", "pyspark.sql", "functions", 2), (1, "config", "spark.sql.shuffle.partitions", "", 8),
            (1, "deprecated", "unionAll", "union", 10), (1, "frame_op", "collect", "", 10), (1, "frame_op", "filter", "", 10), (1, "rdd_op", "collect", "", 10),
            (1, "rdd_op", "map", "", 10), (1, "frame_op", "join", "low", 11), (4, "syntax_error", "", "", 0),
        ],
    ),
    "known_evidence": _values("id, family, score, evidence", [(1, "spark", 70, "SparkSession (+20); spark.sql( (+15); from pyspark (+20); pyspark.sql (+15)"), (2, "hive", 15, 'hive -e " (+15)')]),
    "known_variables": "SELECT 2 AS id, ['day', 'db'] AS names, 'hive -e \"INSERT OVERWRITE TABLE sales.daily PARTITION (dt=''20250101'')' AS line_5, 'SELECT * FROM sales.${kind}\"' AS line_6",
    "known_tables": _values("id, all_tables, variables", [(1, "db.t db.u", ""), (2, "sales.${kind} sales.daily", "sales.${kind}=kind"), (3, "db.one db.three db.two", "")]),
    "known_listing": _values("id, text", [(3, "tables: 3\nselect_from (2): db.one, db.three\nupdate (1): db.two")]),
    "known_ctes": _values("id, names, total, is_recursive, is_multiple", [(3, "c d e", 3, False, True)]),
    "file_lineage": f"""WITH x AS (SELECT DISTINCT sql_id AS file_id, table_name FROM ({_TABLES.replace("FROM extracted_sql WHERE sql IS NOT NULL", "FROM (SELECT file_id AS sql_id, raw_code AS sql FROM code_file WHERE regexp_matches(file_path, '[.](sql|hql)$') AND raw_code IS NOT NULL)")}))
SELECT file_id, count(*)::INT AS tables, count_if(regexp_matches(table_name, '[$]|[{{]'))::INT AS open_names FROM x GROUP BY file_id""",
    "rewritten_files": f"SELECT file_id, md5(t) AS digest, changes, warnings FROM ({folded()})",
    "catalog_changes": _CATALOG,
    "catalog_counts": f"SELECT kind, version, count(*) AS n, count_if(auto_fixable) AS fixable FROM ({_CATALOG}) GROUP BY kind, version",
    "catalog_renames": f"""SELECT kind, CASE WHEN "new" IS NULL THEN 'removed' WHEN "old" = "new" THEN 'same' ELSE 'renamed' END AS change, count(*) AS n
FROM ({_values('kind, "old", "new"', _RENAMES)}) GROUP BY 1, 2""",
    "stream_tumble": """SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS events, round(sum(value), 2) AS total
FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM events) GROUP BY w, event_type HAVING w + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
}
