"""Queries on inventories, backups, generation and backfills, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import file_key
from ..operators import backfill, generate, inventory
from ..session import stage, table, work_path
from ..sources import files as sources


def file_attributes(spark: SparkSession, d: str) -> DataFrame:
    return inventory.attributes(table(spark, d, "code_file").filter("raw_code is not null"), "file_path", "raw_code")


def duplicate_files(spark: SparkSession, d: str) -> DataFrame:
    got = inventory.duplicate_counts(table(spark, d, "file_list").select("list_id", F.lower("文件md5").alias("digest")), "digest")
    return got.select("list_id", "digest", "dup_count")


def selected_files(spark: SparkSession, d: str) -> DataFrame:
    """Lines of Python and SQL files, without copies and without anything below a dags directory."""
    t = table(spark, d, "file_list").withColumn("path", file_key(F.col("文件目录"), F.col("文件名")))
    return inventory.select_files(t, "path", "*.py; *.sql", "*copy*; dags/").select("list_id", "path")


def merged_inventory(spark: SparkSession, d: str) -> DataFrame:
    """The inventory after the scans of all snapshots in order, as delivered; a file is one of a repository."""
    path = file_key(F.col("文件目录"), F.col("文件名"))
    t = table(spark, d, "file_list").select("snapshot_no", F.concat_ws(":", F.col("repo_id").cast("string"), path).alias("file_key"), F.lower("文件md5").alias("digest"), "list_id")
    held = stage(t.groupBy("snapshot_no", "file_key").agg(F.max_by("digest", "list_id").alias("digest")), "snapshots")
    numbers = sorted(r[0] for r in held.select("snapshot_no").distinct().collect())  # eight
    scans = [(held.filter(F.col("snapshot_no") == n).withColumn("tag", F.substring("digest", 1, 2)), F.lit(f"scan {n}")) for n in numbers]
    return inventory.fold_snapshots(scans, "file_key", ["tag"])


def inventory_status(spark: SparkSession, d: str) -> DataFrame:
    return merged_inventory(spark, d).groupBy("status").agg(F.count("*").alias("files"), F.count("tag").alias("tagged"))


def kept_backups(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "migration_result").filter("backup_path is not null")
    return inventory.keep_latest(t, "file_path", "run_at", "result_id", 2).select("result_id", "file_path")


def latest_backups(spark: SparkSession, d: str) -> DataFrame:
    return inventory.latest(table(spark, d, "migration_result").filter("backup_path is not null and file_path is not null"), "file_path", "run_at", "result_id")


def old_backups(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "migration_result")
    return inventory.older_than(t, "run_at", 30, F.to_timestamp_ntz(F.lit("2025-05-01 00:00:00"))).select("result_id")


def backup_stats(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "migration_result").filter("backup_path is not null").withColumn("size", F.length("backup_path").cast("long"))
    return inventory.backup_stats(t, "file_path", "size", "run_at")


def original_names(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.concat("event_type", F.date_format("ts", "_yyyyMMdd_HHmmss"), F.when(F.col("event_id") % 2 == 0, ".py").otherwise("")).alias("backup"))
    return e.select("event_id", inventory.original_name(F.col("backup")).alias("original"))


def verified(spark: SparkSession, d: str) -> DataFrame:
    """Contents against the digests of what was backed up: in every third file a blank was added since."""
    t = table(spark, d, "code_file").filter("raw_code is not null").select("file_id", "raw_code", F.upper(F.sha2(F.when(F.col("file_id") % 3 == 0, F.concat("raw_code", F.lit(" "))).otherwise(F.col("raw_code")), 256)).alias("digest"))
    return inventory.verify(t, "raw_code", "digest").groupBy("intact").agg(F.count("*").alias("files"))


_TEMPLATES = [
    {"title": "<index> load <s_name>", "steps": "run {s_suppkey} of <s_nationkey>", "expected": "<missing>ok"},
    {"title": "<index> check <s_name>", "steps": "compare <s_acctbal>", "expected": "no <nothing>"},
]


def cases(spark: SparkSession, d: str) -> DataFrame:
    tasks = generate.fill_empty(table(spark, d, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("s_suppkey"), "s_name", "s_nationkey", F.col("s_acctbal").cast("int").alias("s_acctbal")))
    return generate.cases(tasks, "s_suppkey", _TEMPLATES)


def scripts(spark: SparkSession, d: str) -> DataFrame:
    code = table(spark, d, "code_file").filter("file_path like '%.sql' and raw_code is not null")
    got = generate.scripts(code, "file_path", "raw_code", "/srv/git", {"owner": "etl", "type": "HiveSql"})
    doc = F.from_json("document", "content string, directory string, name string, owner string, type string")
    return got.select(F.col("file_path"), doc.alias("d")).select("file_path", "d.content", "d.directory", "d.name", "d.owner", "d.type")


_JOB = '{"id": <id>, "name": "<jobName>", "dir": "<directory>", "owner": "<owner>", "keep": "<other>"}'


def jobs(spark: SparkSession, d: str) -> DataFrame:
    code = table(spark, d, "code_file").filter("file_path like '%.sql' and raw_code is not null")
    docs = generate.scripts(code, "file_path", "raw_code", "/srv/git", {"owner": "etl"})
    return generate.jobs(docs, "file_path", "document", _JOB, ["name", "directory", "owner"], {}, {"jobName": "name"}, 1000)


def backfill_days(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "snapshot_log").select("repo_id", "snapshot_no", F.date_format("taken_at", "yyyyMMdd").alias("b"), F.date_format(F.col("taken_at") + F.expr("make_dt_interval(snapshot_no - 3)"), "yyyyMMdd").alias("e"))
    return backfill.days(t, "b", "e").select("repo_id", "snapshot_no", "day")


def month_ends(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", backfill.previous_month_end(day).alias("month_end"), backfill.days_before(day, 3).alias("before"))


def restart(spark: SparkSession, d: str) -> DataFrame:
    return backfill.from_step(table(spark, d, "scan_run"), "run_no", 40).select("run_no")


_INI = ["[hive]", "url = jdbc:hive2://h:1/x=y", "# remark", "", "username=etl", "[spark]", "master = yarn"]


def ini_values(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.createDataFrame(list(enumerate(_INI)), "n int, line string")
    return backfill.ini(lines, "n", "line")


def written_and_read(spark: SparkSession, d: str) -> DataFrame:
    """Statements written as JSON by file and read back."""
    path = work_path(spark, "statements")
    t = table(spark, d, "extracted_sql").filter("sql is not null and source_file is not null").select("sql_id", "sql", F.element_at(F.split("source_file", r"\."), -1).alias("source_file"), "line_start")
    sources.write_statements(t, path)
    return spark.read.json(path).select("sql_id", "sql", "source_file", F.col("line_start").cast("int").alias("line_start"))


_DIR = """regexp_replace(file_path, '/[^/]*$', '')"""
_NAME = """regexp_extract(file_path, '[^/]*$')"""
_KEY = r"""regexp_replace(translate(coalesce("文件目录", '') || '/' || "文件名", '\', '/'), '/+', '/', 'g')"""
_MERGED = rf"""WITH p AS (SELECT snapshot_no AS n, repo_id || ':' || {_KEY} AS file_key, arg_max(lower("文件md5"), list_id) AS digest FROM file_list GROUP BY 1, 2),
i AS (SELECT *, n - row_number() OVER (PARTITION BY file_key ORDER BY n) AS island, max(n) OVER () AS m, max(n) OVER (PARTITION BY file_key) AS last FROM p),
s AS (SELECT *, min(n) OVER (PARTITION BY file_key, island) AS start FROM i)
SELECT file_key, CASE WHEN last < m THEN '删除' WHEN last_start = m THEN '新增' ELSE '已有' END AS status, digest, 'scan ' || CASE WHEN last < m THEN m ELSE last_start END AS updated, left(tag, 2) AS tag
FROM (SELECT file_key, any_value(m) AS m, any_value(last) AS last, max(start) AS last_start, arg_max(digest, n) AS digest, arg_min(digest, n) AS tag FROM s GROUP BY file_key)"""
_SCRIPT = f"""SELECT file_path, raw_code AS content, '/' || regexp_replace({_DIR}, '^/srv/git/?', '') AS directory, regexp_replace({_NAME}, '\\.[^.]*$', '') AS name
FROM code_file WHERE file_path LIKE '%.sql' AND raw_code IS NOT NULL"""

QUERIES = {
    f.__name__: f
    for f in (
        file_attributes, duplicate_files, selected_files, merged_inventory, inventory_status, kept_backups, latest_backups, old_backups, backup_stats,
        original_names, verified, cases, scripts, jobs, backfill_days, month_ends, restart, ini_values, written_and_read,
    )
}
SQL = {
    "file_attributes": rf"""SELECT {_DIR} AS directory, {_NAME} AS name, regexp_extract({_NAME}, '\.([^.]*)$', 1) AS extension,
round(octet_length(raw_code::BLOB) / 1048576.0, 2)::DOUBLE AS size_mb, md5(raw_code) AS md5 FROM code_file WHERE raw_code IS NOT NULL""".replace("raw_code::BLOB", "encode(raw_code)"),
    "duplicate_files": """SELECT list_id, digest, CASE WHEN digest IS NOT NULL THEN count(*) OVER (PARTITION BY digest) END AS dup_count FROM (SELECT list_id, lower("文件md5") AS digest FROM file_list)""",
    "selected_files": rf"""SELECT list_id, path FROM (SELECT list_id, {_KEY} AS path FROM file_list) WHERE regexp_matches(path, '(?:^|/)[^/]*\.(?:py|sql)$')
AND NOT regexp_matches(path, '(?:^|/)[^/]*copy[^/]*$') AND NOT regexp_matches(path, '(?:^|/)dags/')""",
    "merged_inventory": _MERGED,
    "inventory_status": f"SELECT status, count(*) AS files, count(tag) AS tagged FROM ({_MERGED}) GROUP BY status",
    "kept_backups": "SELECT result_id, file_path FROM migration_result WHERE backup_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY run_at DESC, result_id DESC) <= 2",
    "latest_backups": "SELECT file_path, result_id, run_at FROM migration_result WHERE backup_path IS NOT NULL AND file_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY run_at DESC, result_id DESC) = 1",
    "old_backups": "SELECT result_id FROM migration_result WHERE run_at < TIMESTAMP '2025-04-01 00:00:00'",
    "backup_stats": "SELECT count(*) AS backups, sum(length(backup_path))::BIGINT AS total_size, min(run_at) AS oldest, max(run_at) AS newest, count(DISTINCT file_path) AS files FROM migration_result WHERE backup_path IS NOT NULL",
    "original_names": "SELECT event_id, event_type || CASE WHEN event_id % 2 = 0 THEN '.py' ELSE '' END AS original FROM events",
    "verified": "SELECT file_id % 3 <> 0 AS intact, count(*) AS files FROM code_file WHERE raw_code IS NOT NULL GROUP BY 1",
    "cases": """WITH t AS (SELECT *, lpad(s_suppkey::VARCHAR, 9, '0') AS k, row_number() OVER (ORDER BY lpad(s_suppkey::VARCHAR, 9, '0')) AS task_index, trunc(s_acctbal)::INT AS b FROM supplier)
SELECT task_index * 2 - 1 AS index, task_index, (task_index * 2 - 1) || ' load ' || s_name AS title, 'run ' || k || ' of ' || s_nationkey AS steps, 'ok' AS expected FROM t UNION ALL
SELECT task_index * 2, task_index, (task_index * 2) || ' check ' || s_name, 'compare ' || b, 'no ' FROM t""",
    "scripts": f"SELECT *, 'etl' AS owner, 'HiveSql' AS type FROM ({_SCRIPT})",
    "jobs": f"""SELECT id, file_path, '{{"id": ' || id || ', "name": "' || name || '", "dir": "' || directory || '", "owner": "etl", "keep": "<other>"}}' AS job, true AS is_json
FROM (SELECT *, row_number() OVER (ORDER BY file_path COLLATE "C") + 999 AS id FROM ({_SCRIPT}))""".replace(' COLLATE "C"', ""),
    "backfill_days": "SELECT repo_id, snapshot_no, unnest(generate_series(taken_at::DATE, (taken_at + (snapshot_no - 3) * INTERVAL 1 DAY)::DATE, INTERVAL 1 DAY))::DATE AS day FROM snapshot_log WHERE snapshot_no >= 3",
    "month_ends": "SELECT o_orderkey, last_day((o_orderdate::DATE - INTERVAL 1 MONTH)::DATE) AS month_end, (o_orderdate::DATE - 3)::DATE AS before FROM orders",
    "restart": "SELECT run_no FROM scan_run WHERE run_no >= 40",
    "ini_values": "SELECT * FROM (VALUES ('hive', 'url', 'jdbc:hive2://h:1/x'), ('hive', 'username', 'etl'), ('spark', 'master', 'yarn')) v(section, key, value)",
    "written_and_read": "SELECT sql_id, sql, string_split(source_file, '.')[-1] AS source_file, line_start FROM extracted_sql WHERE sql IS NOT NULL AND source_file IS NOT NULL",
}
