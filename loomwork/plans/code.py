"""Queries on code files and statements, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import DIALECTS, ENGINE_RULES, MODULE_MOVES, NAME_PART, PROVIDERS, SPARK_CHECKS, SQL_INSIDE, SQL_STARTS, SQL_WORDS, STATEMENTS
from ..operators import classify, extract, facts, lineage, rewrite, validate
from ..session import spread, table


def _code(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_file")


def _sql(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_sql")


def _wide(spark: SparkSession, d: str, name: str, columns: str) -> DataFrame:
    return spread(table(spark, d, name).select(*columns.split(", ")))


def classify_scores(spark: SparkSession, d: str) -> DataFrame:
    return classify.scores(_wide(spark, d, "code_file", "file_id, file_path, raw_code"), "file_id", "raw_code").select("file_id", "family", "score")


def classify_best(spark: SparkSession, d: str) -> DataFrame:
    return classify.best(_wide(spark, d, "code_file", "file_id, file_path, raw_code"), "file_id", "raw_code")


def classify_evidence(spark: SparkSession, d: str) -> DataFrame:
    return classify.scores(_wide(spark, d, "code_file", "file_id, file_path, raw_code"), "file_id", "raw_code", evidence=True).select("file_id", "family", F.size(F.split("evidence", "; ")).alias("pieces"))


def extracted_statements(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract(_wide(spark, d, "code_file", "file_id, file_path, raw_code"), "file_path", "raw_code")


def statement_types(spark: SparkSession, d: str) -> DataFrame:
    t = _sql(spark, d).filter("sql is not null")
    return t.groupBy(extract.dialect(F.col("sql")).alias("dialect"), extract.valid(F.col("sql")).alias("valid")).agg(F.count("*").alias("statements"))


def statements_by_file(spark: SparkSession, d: str) -> DataFrame:
    t = _sql(spark, d).filter("sql is not null")
    return t.groupBy("source_file").agg(F.count("*").alias("statements"), F.min("line_start").alias("first_line"), F.max("line_end").alias("last_line"))


def table_lineage(spark: SparkSession, d: str) -> DataFrame:
    return lineage.tables(_wide(spark, d, "extracted_sql", "sql_id, sql"), "sql_id", "sql")


def lineage_counts(spark: SparkSession, d: str) -> DataFrame:
    return table_lineage(spark, d).groupBy("stmt_type").agg(F.count("*").alias("names"), F.count_distinct("table_name").alias("tables"))


def table_variables(spark: SparkSession, d: str) -> DataFrame:
    """Variables in all code files and statements."""
    texts = _code(spark, d).select("file_id", F.col("raw_code").alias("t")).union(_sql(spark, d).select(-F.col("sql_id"), "sql"))
    t = texts.filter("t is not null").select("file_id", F.inline(lineage.variables(F.col("t"))))
    return t.groupBy("file_id", "kind", "name").agg(F.count("*").alias("uses"))


def ctes(spark: SparkSession, d: str) -> DataFrame:
    return lineage.ctes(_sql(spark, d), "sql_id", "sql")


def cte_counts(spark: SparkSession, d: str) -> DataFrame:
    """Statements by their first CTE and how many they have."""
    return ctes(spark, d).select("sql_id", "total", F.col("cte_names")[0].alias("cte_name"))


def line_issues(spark: SparkSession, d: str) -> DataFrame:
    return validate.issues(_wide(spark, d, "code_file", "file_id, file_path, raw_code").filter("file_path like '%.py'"), "file_id", "raw_code")


def spark_scores(spark: SparkSession, d: str) -> DataFrame:
    return validate.spark_score(validate.tally(line_issues(spark, d), "file_id")).withColumn("score", F.round("score", 6))


def migration_summary(spark: SparkSession, d: str) -> DataFrame:
    return validate.summary(table(spark, d, "migration_result"), "success", "compatibility_score").withColumns({c: F.round(c, 6) for c in ("success_rate", "avg_score")})


def issue_codes(spark: SparkSession, d: str) -> DataFrame:
    return validate.per_code(line_issues(spark, d), "code")


def rewrite_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hits of every rule that changed a text, over all Python files."""
    got = rewrite.fold(_wide(spark, d, "code_file", "file_id, file_path, raw_code").filter("file_path like '%.py'").select("file_id", "raw_code"), "raw_code")
    return got.select(F.inline("changes")).groupBy("rule").agg(F.sum("hits").alias("hits"))


#: Modules of old workflow definitions: moved, moved to a provider, gone, unknown.
_OLD_MODULES = ["airflow.operators.bash_operator", "airflow.contrib.operators.ssh_operator", "airflow.operators.subdag_operator", "airflow.made_up"]


def module_moves(spark: SparkSession, d: str) -> DataFrame:
    """Modules that code imports: moved, removed or unknown, with the package that brings the new one."""
    known = spark.createDataFrame([(m,) for m in _OLD_MODULES], "module string")
    mods = _code(spark, d).select(F.explode("imports.module").alias("module")).union(known).groupBy("module").agg(F.count("*").alias("uses"))
    return rewrite.providers(rewrite.moved(mods, "module"), "new_module")


def import_facts(spark: SparkSession, d: str) -> DataFrame:
    """Imported modules of files that parse, against the delivered imports column."""
    return facts.facts(_wide(spark, d, "code_file", "file_id, file_path, raw_code").filter("file_path like '%.py'"), "file_id", "raw_code").filter("kind = 'import'").groupBy("name").agg(F.count("*").alias("uses"))


def code_facts(spark: SparkSession, d: str) -> DataFrame:
    return facts.facts(_wide(spark, d, "code_file", "file_id, file_path, raw_code").filter("file_path like '%.py'"), "file_id", "raw_code")


def deprecated_uses(spark: SparkSession, d: str) -> DataFrame:
    return _code(spark, d).select(F.explode("deprecated_apis.api").alias("api")).groupBy("api").agg(F.count("*").alias("uses"))


def table_reach(spark: SparkSession, d: str) -> DataFrame:
    """All tables that data of a table can reach within a source file: insert targets from their sources, closed."""
    t = lineage.tables(_sql(spark, d), "sql_id", "sql").join(_sql(spark, d).select("sql_id", "source_file"), "sql_id")
    into = t.filter("stmt_type in ('insert', 'create')").select("sql_id", F.col("source_file").alias("g"), F.lower("table_name").alias("b"))
    out = t.filter("stmt_type in ('select_from', 'join')").select("sql_id", F.lower("table_name").alias("a"))
    e = into.join(out, "sql_id").filter("a <> b").select("g", "a", "b")
    return facts.closure(e, "a", "b", "g").select(F.col("g").alias("source_file"), F.col("a").alias("from_table"), F.col("b").alias("to_table"))


def command_parts(spark: SparkSession, d: str) -> DataFrame:
    feed = table(spark, d, "events").select("event_id", F.concat(F.lit("cd /opt/"), "event_type", F.lit(" && python job_"), F.col("user_id").cast("string"), F.lit(".py --day 1")).alias("command"))
    return facts.with_command(feed, "command").select("event_id", "command_dir", "command_file")


def operator_kinds(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.concat(F.initcap("event_type"), F.when(F.col("event_id") % 3 == 0, "PythonOperator").when(F.col("event_id") % 3 == 1, "Sensor").otherwise("BranchBashOperator")).alias("operator"))
    return e.select("event_id", facts.operator_kind("operator").alias("kind"))


def lint_report(spark: SparkSession, d: str) -> DataFrame:
    """The delivered deprecated uses as a lint report, read back and counted."""
    uses = _code(spark, d).select("file_path", F.inline("deprecated_apis"))
    lines = uses.select(F.concat("file_path", F.lit(":"), F.col("line").cast("string"), F.lit(":1: W6"), F.lpad(F.length("api").cast("string"), 2, "0"), F.lit(" "), "api").alias("line"))
    return validate.lint_rows(lines, "line").groupBy("code", "category").agg(F.count("*").alias("hits"))


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_FAMILIES = list(dict.fromkeys(r[0] for r in ENGINE_RULES))
_SCORE = {f: " + ".join(f"CASE WHEN regexp_matches(t, {_lit(p)}, 'i') THEN {s} ELSE 0 END" for g, p, s in ENGINE_RULES if g == f) for f in _FAMILIES}
_HITS = {f: " + ".join(f"CASE WHEN regexp_matches(t, {_lit(p)}, 'i') THEN 1 ELSE 0 END" for g, p, _ in ENGINE_RULES if g == f) for f in _FAMILIES}
_TEXT = "(SELECT file_id, coalesce(raw_code, '') AS t FROM code_file)"
_ALL_SCORES = " UNION ALL ".join(f"SELECT file_id, '{f}' AS family, {i} AS o, ({_SCORE[f]})::BIGINT AS score FROM {_TEXT}" for i, f in enumerate(_FAMILIES))
_DIALECT = "CASE " + " ".join(f"WHEN regexp_matches(upper(sql), {_lit('|'.join(w))}) THEN '{d}'" for d, w in DIALECTS) + " ELSE 'generic' END"
_VALID = f"(length(trim(sql)) >= 10 AND (regexp_matches(upper(trim(sql)), '^(?:{'|'.join(SQL_STARTS)})') OR regexp_matches(upper(sql), '{'|'.join(SQL_INSIDE)}')))"
_CLEAN = r"""regexp_replace(sql, '(''(?:[^''\x5C]|\x5C.|'''')*''|"(?:[^"\x5C]|\x5C.|"")*")|--[^\n]*|/\*(?s:.)*?\*/', '\1', 'g')"""
_PART2 = rf"{NAME_PART}(?:\.{NAME_PART})"
_TABLES = f"""
WITH c AS (SELECT sql_id, {_CLEAN} AS t FROM extracted_sql WHERE sql IS NOT NULL),
n AS ({" UNION ALL ".join(f"SELECT sql_id, '{k}' AS stmt_type, unnest(regexp_extract_all(t, {_lit('(?i)' + b + '(' + _PART2 + ')')}, 1)) AS raw FROM c" for k, b in STATEMENTS)}),
x AS (SELECT DISTINCT sql_id, stmt_type, replace(replace(raw, '`', ''), '"', '') AS table_name FROM n)
SELECT sql_id, stmt_type, table_name FROM x
WHERE regexp_matches(table_name, '\\$\\{{[A-Za-z_]\\w*\\}}|\\$[A-Za-z_]\\w*|\\{{[A-Za-z_]\\w*\\}}')
   OR (regexp_matches(string_split(table_name, '.')[-1], '^[A-Za-z_]\\w*$') AND upper(string_split(table_name, '.')[-1]) NOT IN ({", ".join(_lit(w) for w in SQL_WORDS)}))""".replace("\\\\", "\\")
_LINES = "(SELECT file_id, unnest(string_split(raw_code, chr(10))) AS l, generate_subscripts(string_split(raw_code, chr(10)), 1) AS line_no FROM code_file WHERE file_path LIKE '%.py')"
_ISSUES = " UNION ALL ".join(f"SELECT file_id, line_no::INT AS line_no, instr(l, {_lit(p)})::INT AS col_no, '{s}' AS severity, {_lit(p)} AS code FROM {_LINES} WHERE contains(l, {_lit(p)})" for p, s in SPARK_CHECKS)
_TALLY = f"SELECT file_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM ({_ISSUES}) GROUP BY file_id"


def folded() -> str:
    """SQL of all rules one after another over the Python files: file_id, t (the new text), changes and warnings (rule=hits, in order)."""
    step, changes, warnings, rules = "SELECT file_id, raw_code AS t0 FROM code_file WHERE file_path LIKE '%.py' AND raw_code IS NOT NULL", [], [], rewrite.ordered()
    for i, (name, pattern, new, _, _, is_regex, may) in enumerate(rules):
        hits = f"len(regexp_extract_all(t{i}, {_lit(pattern)}))" if is_regex else f"(length(t{i}) - length(replace(t{i}, {_lit(pattern)}, ''))) // {len(pattern)}"
        put = f"regexp_replace(t{i}, {_lit(pattern)}, {_lit(new)}, 'g')" if is_regex else f"replace(t{i}, {_lit(pattern)}, {_lit(new)})"
        step = f"SELECT *, {hits} AS n{i}, {put if may else f't{i}'} AS t{i + 1} FROM ({step})"
        (changes if may else warnings).append(f"CASE WHEN n{i} > 0 THEN '{name}=' || n{i} END")
    told = lambda x: f"concat_ws(' ', {', '.join(x)})"
    return f"SELECT file_id, t{len(rules)} AS t, {told(changes)} AS changes, {told(warnings)} AS warnings FROM ({step})"


_REACH = f"""
WITH RECURSIVE t AS (SELECT x.*, e.source_file FROM ({_TABLES}) x JOIN extracted_sql e USING (sql_id)),
e AS (SELECT DISTINCT i.source_file AS g, lower(o.table_name) AS a, lower(i.table_name) AS b FROM t i JOIN t o USING (sql_id)
      WHERE i.stmt_type IN ('insert', 'create') AND o.stmt_type IN ('select_from', 'join') AND lower(o.table_name) <> lower(i.table_name)),
r AS (SELECT g, a, b FROM e UNION SELECT r.g, r.a, e.b FROM r JOIN e ON r.g = e.g AND r.b = e.a)
SELECT g AS source_file, a AS from_table, b AS to_table FROM r"""

#: Heads of CTEs by pattern; good for texts whose values hold none.
_CTES = rf"""SELECT sql_id, regexp_extract_all({_CLEAN}, '(?i)(?:\bWITH\s+(?:RECURSIVE\s+)?|\)\s*,\s*)([A-Za-z_]\w*)\s+AS\s*\(', 1) AS names,
regexp_matches(sql, '(?i)\bWITH\s+RECURSIVE\b') AS is_recursive FROM extracted_sql WHERE sql IS NOT NULL"""
QUERIES = {
    f.__name__: f
    for f in (
        classify_scores, classify_best, classify_evidence, extracted_statements, statement_types, statements_by_file, table_lineage,
        lineage_counts, table_variables, ctes, cte_counts, line_issues, spark_scores, migration_summary, issue_codes,
        rewrite_counts, module_moves, import_facts, code_facts, deprecated_uses, table_reach, command_parts,
        operator_kinds, lint_report,
    )
}
_VAR = r"\$\{[A-Za-z_]\w*\}|\$[A-Za-z_]\w*|\{[A-Za-z_]\w*\}"
SQL = {
    "classify_scores": f"SELECT file_id, family, score FROM ({_ALL_SCORES}) WHERE score > 0",
    "classify_best": f"""SELECT file_id, CASE WHEN score > 0 THEN family ELSE 'unknown' END AS family, score FROM ({_ALL_SCORES})
QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY score DESC, o) = 1""",
    "classify_evidence": " UNION ALL ".join(f"SELECT file_id, '{f}' AS family, least(8, n)::INT AS pieces FROM (SELECT file_id, {_HITS[f]} AS n FROM {_TEXT}) WHERE n > 0" for f in _FAMILIES),
    "statement_types": f"SELECT {_DIALECT} AS dialect, {_VALID} AS valid, count(*) AS statements FROM extracted_sql WHERE sql IS NOT NULL GROUP BY 1, 2",
    "statements_by_file": "SELECT source_file, count(*) AS statements, min(line_start) AS first_line, max(line_end) AS last_line FROM extracted_sql WHERE sql IS NOT NULL GROUP BY source_file",
    "table_lineage": _TABLES,
    "lineage_counts": f"SELECT stmt_type, count(*) AS names, count(DISTINCT table_name) AS tables FROM ({_TABLES}) GROUP BY stmt_type",
    "table_variables": f"""SELECT file_id, CASE WHEN starts_with(v, '{{') THEN 'python' ELSE 'shell' END AS kind, regexp_replace(v, '[${{}}]', '', 'g') AS name, count(*) AS uses
FROM (SELECT file_id, unnest(regexp_extract_all(t, {_lit(_VAR)})) AS v FROM (SELECT file_id, raw_code AS t FROM code_file UNION ALL SELECT -sql_id, sql FROM extracted_sql)) GROUP BY 1, 2, 3""",
    "cte_counts": f"SELECT sql_id, len(names)::INT AS total, names[1] AS cte_name FROM ({_CTES}) WHERE len(names) > 0",
    "ctes": f"SELECT sql_id, names AS cte_names, len(names)::INT AS total, list_sort(list_distinct(names)) AS unique_names, is_recursive, len(names) > 1 AS is_multiple FROM ({_CTES}) WHERE len(names) > 0",
    "line_issues": _ISSUES,
    "spark_scores": f"SELECT *, round(greatest(0.0, least(1.0, 1 - errors * 0.3::DOUBLE - warnings * 0.1::DOUBLE - infos * 0.02::DOUBLE)), 6) AS score FROM ({_TALLY})",
    "migration_summary": """SELECT count(*) AS total, count(*) FILTER (success) AS succeeded, count(*) - count(*) FILTER (success) AS failed,
round(count(*) FILTER (success) / count(*), 6) AS success_rate, round(avg(CASE WHEN compatibility_score > 0 THEN compatibility_score END), 6) AS avg_score FROM migration_result""",
    "issue_codes": f"SELECT code, count(*) AS hits FROM ({_ISSUES}) GROUP BY code",
    "rewrite_counts": f"SELECT split_part(c, '=', 1) AS rule, sum(split_part(c, '=', 2)::BIGINT)::BIGINT AS hits FROM (SELECT unnest(string_split(changes, ' ')) AS c FROM ({folded()}) WHERE changes <> '') GROUP BY 1",
    "module_moves": f"""WITH m AS (SELECT module, count(*) AS uses FROM (SELECT unnest(imports).module AS module FROM code_file UNION ALL SELECT unnest([{", ".join(map(_lit, _OLD_MODULES))}])) GROUP BY module),
mv(old, new_module) AS (VALUES {", ".join(f"({_lit(a)}, {_lit(b) if b else 'NULL'})" for a, b in MODULE_MOVES)}),
pr(prefix, provider, o) AS (VALUES {", ".join(f"({_lit(a)}, {_lit(b)}, {i})" for i, (a, b) in enumerate(PROVIDERS))})
SELECT m.module, uses, new_module, CASE WHEN old IS NULL THEN 'unknown' WHEN new_module IS NULL THEN 'removed' ELSE 'moved' END AS kind,
  (SELECT arg_min(provider, o) FROM pr WHERE starts_with(new_module, prefix)) AS provider FROM m LEFT JOIN mv ON m.module = mv.old""",
    "deprecated_uses": "SELECT api, count(*) AS uses FROM (SELECT unnest(deprecated_apis).api AS api FROM code_file) GROUP BY api",
    "table_reach": _REACH,
    "command_parts": "SELECT event_id, '/opt/' || event_type AS command_dir, 'job_' || user_id || '.py' AS command_file FROM events",
    "operator_kinds": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'sensor' ELSE 'bash' END AS kind FROM events",
    "lint_report": """SELECT 'W6' || lpad(length(api)::VARCHAR, 2, '0') AS code, 'warning' AS category, count(*) AS hits
FROM (SELECT file_path, unnest(deprecated_apis).api AS api FROM code_file) WHERE file_path IS NOT NULL GROUP BY 1""",
}
