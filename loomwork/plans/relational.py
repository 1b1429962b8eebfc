"""The SQL surface that warehouse code uses: joins, aggregates, windows, sets, nested data, time windows, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table, work_path
from ..streaming import windows


def _same(sql: str):
    """A query that both engines read alike: views over the tables it names, then Spark SQL."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "code_file", "extracted_sql", "migration_result", "repo", "documents"):
            if t in sql:
                table(spark, d, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    return run


# queries that both engines take word for word
_BOTH = {
    "join_inner": "SELECT n_name, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "join_right": "SELECT r_name, count(n_nationkey) AS nations FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "join_full": "SELECT c.file_path AS code_path, m.file_path AS result_path, count(*) AS n FROM code_file c FULL JOIN migration_result m ON c.file_path = m.file_path GROUP BY c.file_path, m.file_path",
    "join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "join_theta": "SELECT a.r_name AS low, b.r_name AS high FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey",
    "join_multiway": """SELECT r_name, o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, o_orderpriority""",
    "aggregate_having": "SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "pricing_summary": """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
        round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rollup": "SELECT r_name, n_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "window_running": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders",
    "window_lag_lead": """SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before,
        lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after FROM orders""",
    "window_rank": """SELECT o_custkey, o_orderkey, rk, drk FROM (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rk,
        dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS drk FROM orders) t WHERE rk <= 3""",
    "top_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_union_all": "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) t GROUP BY k",
    "set_intersect": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
    "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "subquery_in": "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)",
    "subquery_scalar": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) * 1.5 FROM customer)",
    "cte_chain": "WITH t AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), u AS (SELECT o_custkey FROM t WHERE s > 1000000) SELECT count(*) AS n FROM u",
    "cte_recursive": "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 50) SELECT n, n * n AS sq FROM r",
    "case_and_cast": """SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal BETWEEN 0 AND 5000 THEN 'mid' ELSE 'high' END AS band, coalesce(c_mktsegment, 'none') AS segment,
        count(*) AS n, CAST(sum(CASE WHEN c_name LIKE '%7' THEN 1 ELSE 0 END) AS BIGINT) AS sevens FROM customer GROUP BY 1, 2""",
    "string_functions": "SELECT c_custkey, upper(trim(c_name)) AS up, lower(c_mktsegment) AS low, length(c_name) AS len, replace(c_name, '#', '-') AS dashed, substr(c_name, 1, 8) AS head, concat(c_name, '/', c_mktsegment) AS both_names FROM customer",
    "date_functions": "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start FROM orders",
    "math_functions": "SELECT p_partkey, round(p_retailprice / 7, 4) AS r, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, abs(p_size - 25) AS a, p_size % 7 AS m FROM part",
}
# Spark's wording, DuckDB's wording
_PAIRS = {
    "json_values": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    ),
    "exploded_tags": (
        "SELECT tag, count(*) AS n FROM documents LATERAL VIEW explode(tags) x AS tag GROUP BY tag",
        "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM documents) GROUP BY tag",
    ),
    "positioned_imports": (
        "SELECT file_id, pos, i.module AS module FROM code_file LATERAL VIEW posexplode(imports) x AS pos, i",
        "SELECT file_id, CAST(generate_subscripts(imports, 1) - 1 AS INT) AS pos, unnest(imports).module AS module FROM code_file",
    ),
    "collected_sets": (
        "SELECT user_id, concat_ws(',', array_sort(collect_set(event_type))) AS kinds FROM events GROUP BY user_id",
        "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events GROUP BY user_id",
    ),
    "maps": (
        "SELECT event_id, element_at(str_to_map(concat('a:', event_type, ',b:', user_id), ',', ':'), 'b') AS b FROM events",
        "SELECT event_id, CAST(user_id AS VARCHAR) AS b FROM events",
    ),
    "asof_join": (
        """SELECT m.result_id, max(c.read_at) AS read_at FROM migration_result m JOIN code_file c ON m.file_path = c.file_path AND c.read_at <= m.run_at GROUP BY m.result_id""",
        """SELECT m.result_id, max(c.read_at) AS read_at FROM migration_result m JOIN code_file c ON m.file_path = c.file_path AND c.read_at <= m.run_at GROUP BY m.result_id""",
    ),
}


def tumble(spark: SparkSession, d: str) -> DataFrame:
    return windows.tumbling(table(spark, d, "events"), "ts", "5 minutes", ["event_type"])


def hop(spark: SparkSession, d: str) -> DataFrame:
    return windows.hopping(table(spark, d, "events"), "ts", "10 minutes", "5 minutes", ["event_type"])


def session(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(table(spark, d, "events"), "ts", "30 minutes", ["user_id"])


def side_output(spark: SparkSession, d: str) -> DataFrame:
    main, side = windows.split_side(table(spark, d, "events"), "event_type = 'error'")
    return main.selectExpr("event_id", "'main' AS part").union(side.selectExpr("event_id", "'side' AS part"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    folder = work_path(spark, "arriving")
    spark.read.parquet(f"{d}/events.parquet").write.parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1000").parquet(folder)


def stream_tumble(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a drained stream, in append mode: the last windows stay open behind the watermark."""
    out = windows.tumbling(_stream(spark, d), "ts", "1 hour", ["event_type"], "1 hour")
    return windows.drain(out, work_path(spark, "out"), work_path(spark, "state"))


def stream_filter(spark: SparkSession, d: str) -> DataFrame:
    out = _stream(spark, d).filter("event_type = 'purchase'").select("event_id", "user_id", "value")
    return windows.drain(out, work_path(spark, "out"), work_path(spark, "state"))


_AGG = "count(*) AS events, round(sum(value), 2) AS total"
QUERIES = {k: _same(s) for k, s in _BOTH.items()} | {k: _same(s) for k, (s, _) in _PAIRS.items()} | {f.__name__: f for f in (tumble, hop, session, side_output, stream_tumble, stream_filter)}
SQL = dict(_BOTH) | {k: s for k, (_, s) in _PAIRS.items()} | {
    "tumble": f"SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end, event_type, {_AGG} FROM events GROUP BY 1, 2, 3",
    "hop": f"""SELECT w AS window_start, w + INTERVAL 10 MINUTE AS window_end, event_type, {_AGG} FROM (
SELECT *, unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE]) AS w FROM events) GROUP BY 1, 2, 3""",
    "session": f"""WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp FROM s)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, {_AGG} FROM g GROUP BY user_id, grp""",
    "side_output": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'main' ELSE 'side' END AS part FROM events",
    "stream_filter": "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'",
}
