"""Queries on changes of tables, interval joins, scripts, table functions, lint reports in JSON and settings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import settings
from ..operators import dml, ranges, scripts, validate
from ..session import table, work_path
from .code import _CTES
from .workflows import _values

_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(*_ORDERS)


def deleted_rows(spark: SparkSession, d: str) -> DataFrame:
    return dml.deleted(_orders(spark, d), "o_orderstatus = 'F' and nullif(o_custkey % 4, 0) <> 1")


def updated_rows(spark: SparkSession, d: str) -> DataFrame:
    """Both values see the old row."""
    return dml.updated(_orders(spark, d), {"o_orderstatus": "concat('was ', o_orderstatus)", "o_custkey": "case when o_orderstatus = 'F' then 0 else o_custkey end"}, "o_orderkey % 3 = 0")


def _source(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth order at half its price, and as many new ones."""
    t = _orders(spark, d).filter("o_orderkey % 5 = 0")
    half = t.withColumn("o_totalprice", F.col("o_totalprice") / 2)
    return half.union(half.withColumn("o_orderkey", -F.col("o_orderkey") - 1))


def merged_rows(spark: SparkSession, d: str) -> DataFrame:
    return dml.merged(_orders(spark, d), _source(spark, d), ["o_orderkey"], update={"o_totalprice": "s_o_totalprice + 1"}, delete="s_o_orderstatus = 'P'")


def table_versions(spark: SparkSession, d: str) -> DataFrame:
    """A table through create, insert, update, delete, merge and overwrite of a partition: rows and sum after each version."""
    t = dml.Table.create_as(_orders(spark, d).filter("o_orderstatus <> 'P'"), work_path(spark, "orders"))
    t.insert(_orders(spark, d).filter("o_orderstatus = 'P'"))
    t.update({"o_totalprice": "0"}, "o_orderkey % 2 = 0")
    t.delete("o_orderkey % 7 = 0")
    t.merge(_source(spark, d), ["o_orderkey"])
    t.overwrite_partitions(_orders(spark, d).filter("o_orderstatus = 'F' and o_orderkey % 10 = 1"), "o_orderstatus")
    versions = [t.as_of(n).agg(F.lit(n).alias("version"), F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total")) for n in range(1, 7)]
    out = versions[0]
    for v in versions[1:]:
        out = out.union(v)
    return out


def runs_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the feed that arrived while a run went on, per run."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    lines = table(spark, d, "file_list_feed").select("feed_id", "arrived_at")
    runs = table(spark, d, "scan_run").filter("finished_at is not null").select("run_no", "started_at", "finished_at")
    got = ranges.interval_join(lines, seconds("arrived_at"), runs, seconds("started_at"), seconds("finished_at"), 600.0)
    return got.groupBy("run_no").agg(F.count("*").alias("lines"))


def price_bands(spark: SparkSession, d: str) -> DataFrame:
    """Orders that lie in the price band of an order ten orders before, of the same status: bands of very different widths."""
    t = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    bands = t.filter("o_orderkey % 50 = 1").select(F.col("o_orderkey").alias("band"), "o_orderstatus", F.col("o_totalprice").alias("low"), (F.col("o_totalprice") * F.when(F.col("o_orderkey") % 100 == 1, 1.001).otherwise(2.0)).alias("high"))
    got = ranges.interval_join(t, F.col("o_totalprice"), bands, F.col("low"), F.col("high"), 100.0, ["o_orderstatus"])
    return got.groupBy("band").agg(F.count("*").alias("orders"), F.min("o_orderkey").alias("first_order"))


def last_purchase(spark: SparkSession, d: str) -> DataFrame:
    """Every event with the value of its user's newest purchase not after it."""
    e = table(spark, d, "events")
    marks = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", "value").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("purchase"))
    got = ranges.nearest_before(e.select("event_id", "user_id", "ts"), "ts", marks, "ts", ["user_id"])
    return got.select("event_id", F.col("mark.purchase").alias("purchase"))


def cte_function(spark: SparkSession, d: str) -> DataFrame:
    """The table function for CTE names, called from SQL."""
    scripts.register(spark)
    table(spark, d, "extracted_sql").select("sql_id", "sql").createOrReplaceTempView("loomwork_statements")
    return spark.sql("SELECT s.sql_id, c.ordinal, c.name FROM loomwork_statements s, LATERAL cte_names(s.sql) c")


def script_result(spark: SparkSession, d: str) -> DataFrame:
    """The result of a script's last statement."""
    _orders(spark, d).createOrReplaceTempView("loomwork_orders")
    script = """-- big; orders
CREATE OR REPLACE TEMPORARY VIEW loomwork_big AS SELECT * FROM loomwork_orders WHERE o_totalprice > ${least} AND o_orderstatus <> ';';
CREATE OR REPLACE TEMPORARY VIEW loomwork_few AS SELECT o_orderstatus, count(*) AS orders FROM loomwork_big GROUP BY o_orderstatus;
SELECT * FROM loomwork_few /* the end; */ ;"""
    return scripts.run_script(spark, script, {"least": "100000"})


def sample_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Sample queries in the words of each engine."""
    rows = [(k, scripts.limited(k, "*", "a.b", 5), scripts.limited(k, "c", "a.b", 5, "c > 1")) for k in scripts.LIMITS]
    return spark.createDataFrame(rows, "dialect string, plain string, filtered string")


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """The delivered deprecated uses as one JSON report a file, and reports that are none."""
    uses = table(spark, d, "code_file").select("file_path", F.inline("deprecated_apis"))
    finding = F.struct(
        F.col("file_path").alias("filename"), F.concat(F.when(F.length("api") % 2 == 0, "E").otherwise("UP"), F.length("api").cast("string")).alias("code"), F.col("api").alias("message"),
        F.struct(F.col("line").alias("row"), F.lit(1).alias("column")).alias("location"), F.when(F.col("line") % 2 == 0, F.struct(F.lit("safe").alias("applicability"))).alias("fix"),
    )
    reports = uses.groupBy("file_path").agg(F.to_json(F.collect_list(finding)).alias("report"))
    return reports.select("report").union(spark.createDataFrame([("[]",), ("no json",), (None,)], "report string"))


def lint_json(spark: SparkSession, d: str) -> DataFrame:
    return validate.lint_json(_reports(spark, d), "report").groupBy("code", "severity").agg(F.count("*").alias("findings"), F.count_if("fixable").alias("fixable"))


def lint_files(spark: SparkSession, d: str) -> DataFrame:
    return validate.lint_summary(validate.lint_json(_reports(spark, d), "report")).select("path", "findings", "errors", "infos", "fixable", F.array_join("codes", ",").alias("codes"), "score", "grade")


def lint_texts(spark: SparkSession, d: str) -> DataFrame:
    return validate.lint_text(validate.lint_json(_reports(spark, d), "report")).select("path", F.size(F.split("text", "\n")).alias("lines"))


def layered_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings over each other, looked up."""
    s = settings.merge({"a": {"b": 1, "c": [1]}, "d": "x", "e": 5}, {"a": {"c": [2, 3]}, "d": None}, {"a": {"b": 4}, "f": {"g": True}})
    s = settings.put(s, "f.h.i", "new")
    looked = ["a.b", "a.c", "d", "e", "f.g", "f.h.i", "f.none", "a.b.c"]
    return spark.createDataFrame([(k, str(settings.get(s, k, "-"))) for k in looked], T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))


QUERIES = {
    f.__name__: f
    for f in (
        deleted_rows, updated_rows, merged_rows, table_versions, runs_of_lines, price_bands, last_purchase, cte_function, script_result, sample_scripts, lint_json, lint_files,
        lint_texts, layered_settings,
    )
}
_O = f"SELECT {', '.join(_ORDERS)} FROM orders"
_S = "SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_totalprice / 2 AS p FROM orders WHERE o_orderkey % 5 = 0"
_USES = "(SELECT file_path, unnest(deprecated_apis).api AS api, unnest(deprecated_apis).line AS line FROM code_file)"
_CODE = "CASE WHEN length(api) % 2 = 0 THEN 'E' ELSE 'UP' END || length(api)"
_SEVERITY = "CASE WHEN length(api) % 2 = 0 THEN 'error' ELSE 'info' END"
SQL = {
    "deleted_rows": f"{_O} WHERE NOT coalesce(o_orderstatus = 'F' AND nullif(o_custkey % 4, 0) <> 1, false)",
    "updated_rows": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'F' THEN 0 ELSE o_custkey END AS o_custkey,
CASE WHEN o_orderkey % 3 = 0 THEN 'was ' || o_orderstatus ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders""",
    "merged_rows": f"""{_O} WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice / 2 + 1 FROM orders WHERE o_orderkey % 5 = 0 AND o_orderstatus <> 'P'
UNION ALL SELECT -k - 1, c, s, p FROM ({_S})""",
    "table_versions": f"""WITH v1 AS ({_O} WHERE o_orderstatus <> 'P'), v2 AS ({_O}), v3 AS (SELECT * REPLACE (CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_totalprice END AS o_totalprice) FROM v2),
v4 AS (SELECT * FROM v3 WHERE o_orderkey % 7 <> 0), v5 AS (SELECT * FROM v4 WHERE o_orderkey % 5 <> 0 UNION ALL SELECT * FROM ({_S}) UNION ALL SELECT -k - 1, c, s, p FROM ({_S})),
v6 AS (SELECT * FROM v5 WHERE o_orderstatus <> 'F' UNION ALL {_O} WHERE o_orderstatus = 'F' AND o_orderkey % 10 = 1)
{" UNION ALL ".join(f"SELECT {n} AS version, count(*) AS rows, round(sum(o_totalprice), 2) AS total FROM v{n}" for n in range(1, 7))}""",
    "runs_of_lines": "SELECT run_no, count(*) AS lines FROM scan_run JOIN file_list_feed ON arrived_at >= started_at AND arrived_at < finished_at GROUP BY run_no",
    "price_bands": """WITH b AS (SELECT o_orderkey AS band, o_orderstatus AS s, o_totalprice AS low, o_totalprice * CASE WHEN o_orderkey % 100 = 1 THEN 1.001::DOUBLE ELSE 2.0::DOUBLE END AS high FROM orders WHERE o_orderkey % 50 = 1)
SELECT band, count(*) AS orders, min(o_orderkey) AS first_order FROM b JOIN orders ON o_orderstatus = s AND o_totalprice >= low AND o_totalprice < high GROUP BY band""",
    "last_purchase": """WITH m AS (SELECT user_id, ts, max(event_id) AS purchase FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.event_id, m.purchase FROM events e ASOF LEFT JOIN m ON e.user_id = m.user_id AND e.ts >= m.ts""",
    "cte_function": f"SELECT sql_id, o::INT AS ordinal, names[o] AS name FROM (SELECT sql_id, names, unnest(generate_series(1, len(names))) AS o FROM ({_CTES}))",
    "script_result": "SELECT o_orderstatus, count(*) AS orders FROM orders WHERE o_totalprice > 100000 GROUP BY 1",
    "sample_scripts": _values(
        "dialect, plain, filtered",
        [
            *((k, "SELECT * FROM a.b LIMIT 5", "SELECT c FROM a.b WHERE c > 1 LIMIT 5") for k in ("hive", "impala", "mysql")),
            ("oracle", "SELECT * FROM a.b WHERE ROWNUM <= 5", "SELECT c FROM a.b WHERE (c > 1) AND ROWNUM <= 5"), ("sqlserver", "SELECT TOP 5 * FROM a.b", "SELECT TOP 5 c FROM a.b WHERE c > 1"),
        ],
    ),
    "lint_json": f"SELECT {_CODE} AS code, {_SEVERITY} AS severity, count(*) AS findings, count_if(line % 2 = 0) AS fixable FROM {_USES} GROUP BY 1, 2",
    "lint_files": f"""SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM (
SELECT file_path AS path, count(*) AS findings, count_if({_SEVERITY} = 'error') AS errors, count_if({_SEVERITY} = 'info') AS infos, count_if(line % 2 = 0) AS fixable,
  string_agg(DISTINCT {_CODE}, ',' ORDER BY {_CODE}) AS codes, greatest(0, 100 - 10 * count_if({_SEVERITY} = 'error') - count_if({_SEVERITY} = 'info')) AS score FROM {_USES} GROUP BY 1)""",
    "lint_texts": f"SELECT file_path AS path, (count(*) + 1)::INT AS lines FROM {_USES} GROUP BY 1",
    "layered_settings": _values("name, value", [("a.b", "4"), ("a.c", "[2, 3]"), ("d", "x"), ("e", "5"), ("f.g", "True"), ("f.h.i", "new"), ("f.none", "-"), ("a.b.c", "-")]),
}
