"""Profiling queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as P
from ..session import table

#: Columns of the tables that are profiled, by type class (fixed values).
_COLUMNS = {
    "lineitem": {"numeric": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax", "string": "l_returnflag l_linestatus", "date": "l_shipdate"},
    "orders": {"numeric": "o_orderkey o_custkey o_totalprice", "string": "o_orderstatus o_orderpriority", "date": "o_orderdate"},
    "events": {"numeric": "event_id user_id value", "string": "event_type props", "date": "ts"},
    "customer": {"numeric": "c_custkey c_nationkey c_acctbal", "string": "c_name c_mktsegment"},
    "extracted_sql": {"numeric": "sql_id line_start line_end", "string": "sql source_file sql_type context", "date": "extracted_at"},
    "migration_result": {"numeric": "result_id compatibility_score", "string": "file_path backup_path migration_time", "date": "run_at"},
    "documents": {"numeric": "doc_id n_chars thread_id parent_id answer_rank votes dup_of author_id", "string": "text lang source post_kind title", "date": "created_at ingested_at"},
    "file_list": {"numeric": "list_id repo_id snapshot_no", "string": "`文件目录` `文件名` `文件md5` `文件状态`", "date": "loaded_at"},
}
_METRICS = ["row_count", "null_count", "blank_count", "distinct_count", "unique_count", "dup_count", "min_len", "max_len", "avg_len", "min_number", "max_number", "avg_number"]
_RATES = ["null_rate", "blank_rate", "distinct_rate", "unique_rate", "dup_rate"]


def _names(t: str) -> list[str]:
    return " ".join(_COLUMNS[t].values()).replace("`", "").split()


def _profile(t: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = P.profile(table(spark, d, t), _names(t))
        return out.select("column_name", "type_class", *_METRICS[:8], *(F.round(c, 4).alias(c) for c in ("avg_len", "min_number", "max_number", "avg_number")), *(F.round(c, 8).alias(c) for c in _RATES), "min_value", "max_value")

    return run


def _profile_sql(t: str) -> str:
    parts = []
    for kind, names in _COLUMNS[t].items():
        for c in names.replace("`", '"').split():
            text, num = kind == "string", kind == "numeric"
            parts.append(f"""
SELECT '{c.strip(chr(34))}' AS column_name, '{kind}' AS type_class, count(*) AS row_count, count(*) - count({c}) AS null_count,
  {f"count(*) FILTER (trim({c}) = '')" if text else "NULL::BIGINT"} AS blank_count,
  (SELECT count(*) FROM (SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c})) AS distinct_count,
  (SELECT count(*) FROM (SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) = 1)) AS unique_count,
  (SELECT count(*) FROM (SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1)) AS dup_count,
  {f"min(length({c}))" if text else "NULL::INT"} AS min_len, {f"max(length({c}))" if text else "NULL::INT"} AS max_len,
  {f"round(avg(length({c})), 4)" if text else "NULL::DOUBLE"} AS avg_len,
  {f"round(min({c})::DOUBLE, 4)" if num else "NULL::DOUBLE"} AS min_number, {f"round(max({c})::DOUBLE, 4)" if num else "NULL::DOUBLE"} AS max_number,
  {f"round(avg({c}::DOUBLE), 4)" if num else "NULL::DOUBLE"} AS avg_number,
  {"NULL::VARCHAR" if num else f"min({c})::VARCHAR"} AS min_value, {"NULL::VARCHAR" if num else f"max({c})::VARCHAR"} AS max_value FROM {t}""")
    rates = ", ".join(f"round({r.replace('_rate', '_count')} / nullif(row_count, 0), 8) AS {r}" for r in _RATES)
    return f"SELECT *, {rates} FROM ({' UNION ALL '.join(parts)}) p"


def profile_filtered(spark: SparkSession, d: str) -> DataFrame:
    out = P.profile(table(spark, d, "orders"), ["o_totalprice", "o_orderstatus"], "WHERE o_orderpriority = '1-URGENT'")
    return out.select("column_name", "row_count", "null_count", "distinct_count", F.round("max_number", 4).alias("max_number"))


def top_values(spark: SparkSession, d: str) -> DataFrame:
    return P.top_values(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]).withColumn("rate", F.round("rate", 8))


def top_values_null(spark: SparkSession, d: str) -> DataFrame:
    return P.top_values(table(spark, d, "extracted_sql"), ["sql_type", "context"]).withColumn("rate", F.round("rate", 8))


def sample_columns(spark: SparkSession, d: str) -> DataFrame:
    return P.sample_columns(table(spark, d, "documents").select("doc_id", "lang", "source", "text"), "doc_id")


def data_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary of customer, its key found by a profile."""
    t = table(spark, d, "customer")
    keys = [r[0] for r in P.key_columns(P.profile(t, ["c_custkey", "c_nationkey"])).collect()]  # columns of one table
    return P.dictionary(spark, "customer", t, keys).select("table_name", "ordinal_position", "column_name", "type_class", "is_primary_key")


def catalog_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary from catalog tables given here."""
    columns = spark.createDataFrame([("a", "id", 1, "bigint", "NO"), ("a", "name", 2, "string", "YES"), ("b", "id", 1, "int", "NO")], "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string")
    keys = spark.createDataFrame([("a", "id"), ("a", "id"), ("c", "id")], "table_name string, column_name string")
    comments = spark.createDataFrame([("a", "name", "who"), ("x", "name", "?")], "table_name string, column_name string, comment string")
    return P.catalog_dictionary(columns, keys, comments)


def described_tables(spark: SparkSession, d: str) -> DataFrame:
    """What the engine's own DESCRIBE says of a partitioned view of orders, as a dictionary."""
    rows = [("# col_name", "data_type", "comment", 0), ("o_orderkey", "bigint", None, 1), (" o_custkey ", "bigint", "who", 2), ("", "", "", 3), ("# Partition Information", "", "", 4), ("o_orderdate", "date", None, 5)]
    return P.parse_describe(spark.createDataFrame(rows, "col_name string, data_type string, comment string, n int"), "n")


def expanded_tables(spark: SparkSession, d: str) -> DataFrame:
    """A work list in which a schema's tables are meant by a star."""
    work = spark.createDataFrame([("s", "*", 1), ("s", "one", 2), ("none", "*", 3)], "schema_name string, table_name string, no int")
    catalog = table(spark, d, "region").select(F.lit("s").alias("schema_name"), F.lower("r_name").alias("table_name"))
    return P.expand_tables(work, catalog)


def partition_replace(spark: SparkSession, d: str) -> DataFrame:
    """Customers of nation 3 replaced by those of nation 3 with a positive balance."""
    old = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return P.replace_partition(old, old.filter("c_nationkey = 3 and c_acctbal > 0"), "c_nationkey")


def first_per_id(spark: SparkSession, d: str) -> DataFrame:
    return P.first_per_id(table(spark, d, "events").select("event_id", F.upper("event_type").alias("event_type")), "event_type", "event_id")


def work_status(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "scan_run")
    before = F.when(F.col("attempt_no") == 1, 1).when(F.col("attempt_no") == 2, 9).otherwise(2)
    return runs.select("run_no", P.next_status(before, F.lower("run_status").isin("failed", "aborted")).alias("status"))


_TOP = """SELECT * FROM (SELECT '{c}' AS column_name, row_number() OVER (ORDER BY count(*) DESC, {c}::VARCHAR ASC NULLS FIRST)::INT AS rank,
  {c}::VARCHAR AS value, count(*) AS cnt, round(count(*) / (SELECT count(*) FROM {t}), 8) AS rate FROM {t} GROUP BY {c}) WHERE rank <= 10"""

QUERIES = {f"profile_{t}": _profile(t) for t in _COLUMNS} | {
    "profile_filtered": profile_filtered,
    "top_values": top_values,
    "top_values_null": top_values_null,
    "sample_columns": sample_columns,
    "data_dictionary": data_dictionary,
    "catalog_dictionary": catalog_dictionary,
    "described_tables": described_tables,
    "expanded_tables": expanded_tables,
    "partition_replace": partition_replace,
    "first_per_id": first_per_id,
    "work_status": work_status,
}
SQL = {f"profile_{t}": _profile_sql(t) for t in _COLUMNS} | {
    "profile_filtered": """SELECT 'o_totalprice' AS column_name, count(*) AS row_count, count(*) - count(o_totalprice) AS null_count, count(DISTINCT o_totalprice) AS distinct_count, round(max(o_totalprice), 4) AS max_number
FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL
SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus), NULL FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "top_values": " UNION ALL ".join(_TOP.format(c=c, t="orders") for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")),
    "top_values_null": " UNION ALL ".join(_TOP.format(c=c, t="extracted_sql") for c in ("sql_type", "context")),
    "sample_columns": "WITH s AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM documents ORDER BY doc_id LIMIT 5) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, "
        + ", ".join(f"max(CASE WHEN r = {i} THEN CASE WHEN length({c}::VARCHAR) > 200 THEN '忽略超长文本' ELSE {c}::VARCHAR END END) AS row{i}" for i in range(1, 6))
        + " FROM s"
        for c in ("doc_id", "lang", "source", "text")
    ),
    "data_dictionary": """SELECT 'customer' AS table_name, ordinal_position::INT AS ordinal_position, column_name,
CASE WHEN data_type = 'VARCHAR' THEN 'string' WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' ELSE 'default' END AS type_class, CASE WHEN column_name = 'c_custkey' THEN 'YES' ELSE 'NO' END AS is_primary_key
FROM information_schema.columns WHERE table_name = 'customer'""",
    "catalog_dictionary": """SELECT * FROM (VALUES ('a', 1, 'id', 'bigint', 'NO', NULL, 'YES'), ('a', 2, 'name', 'string', 'YES', 'who', 'NO'), ('b', 1, 'id', 'int', 'NO', NULL, 'NO'))
t(table_name, ordinal_position, column_name, type_name, is_nullable, remarks, is_primary_key)""",
    "described_tables": """SELECT * FROM (VALUES (1, 'o_orderkey', 'bigint', 'YES', 'NO', NULL), (2, 'o_custkey', 'bigint', 'YES', 'NO', 'who'), (3, 'o_orderdate', 'date', 'YES', 'NO', NULL))
t(ordinal_position, column_name, data_type, is_nullable, is_primary_key, remarks)""",
    "expanded_tables": "SELECT 's' AS schema_name, lower(r_name) AS table_name, 1 AS no FROM region UNION ALL SELECT 's', 'one', 2",
    "partition_replace": "SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_nationkey IS DISTINCT FROM 3 OR c_acctbal > 0",
    "first_per_id": "SELECT event_id, upper(event_type) AS event_type FROM events QUALIFY row_number() OVER (PARTITION BY lower(event_type) ORDER BY event_id) = 1",
    "work_status": """SELECT run_no, CASE WHEN attempt_no IN (1, 2) THEN CASE WHEN lower(run_status) IN ('failed', 'aborted') THEN 4 ELSE 2 END ELSE 2 END AS status FROM scan_run""",
}
