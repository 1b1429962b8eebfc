"""Values that results depend on: patterns, word lists and tables, in their natural order."""

from __future__ import annotations

# --- fixed values: engine, pattern (letter case aside), score of a hit ---
ENGINE_RULES = [
    ("hive", r"\bPARTITIONED\s+BY\b", 10),
    ("hive", r"\bSTORED\s+AS\s+(ORC|PARQUET|TEXTFILE|AVRO|SEQUENCEFILE)\b", 10),
    ("hive", r"\bLOCATION\s+['\"]hdfs://", 8),
    ("hive", r"\bMSCK\s+REPAIR\s+TABLE\b", 15),
    ("hive", r"\bLOAD\s+DATA\s+(LOCAL\s+)?INPATH\b", 10),
    ("hive", r"\bSET\s+hive\.\w+", 15),
    ("hive", r"\bget_json_object\s*\(", 10),
    ("hive", r"\blateral\s+view\s+explode\b", 12),
    ("hive", r"\bcollect_set\s*\(", 8),
    ("hive", r"\bcollect_list\s*\(", 8),
    ("hive", r"\bposexplode\s*\(", 10),
    ("hive", r"HiveContext", 15),
    ("hive", r"hiveql", 12),
    ("hive", r"beeline\s+-e", 15),
    ("hive", r"hive\s+-e\s+['\"]", 15),
    ("hive", r"execute_hive_query", 12),
    ("hive", r"run_hive_sql", 12),
    ("hive", r"HiveServer2", 15),
    ("hive", r"pyhive\.hive", 15),
    ("hive", r"from\s+pyhive\s+import\s+hive", 15),
    ("hive", r"impyla.*connect", 10),
    ("spark", r"\bSparkSession\b", 20),
    ("spark", r"\bSparkContext\b", 20),
    ("spark", r"\bSparkConf\b", 15),
    ("spark", r"spark\s*=\s*SparkSession", 20),
    ("spark", r"sc\s*=\s*SparkContext", 20),
    ("spark", r"\.createDataFrame\s*\(", 15),
    ("spark", r"\.read\s*\.\s*(csv|json|parquet|orc|jdbc|format)\s*\(", 12),
    ("spark", r"\.write\s*\.\s*(csv|json|parquet|orc|jdbc|format|mode)\s*\(", 12),
    ("spark", r"\.withColumn\s*\(", 10),
    ("spark", r"\.dropDuplicates\s*\(", 8),
    ("spark", r"\.repartition\s*\(", 8),
    ("spark", r"\.coalesce\s*\(", 8),
    ("spark", r"\.cache\s*\(", 8),
    ("spark", r"\.persist\s*\(", 8),
    ("spark", r"\.parallelize\s*\(", 12),
    ("spark", r"\.reduceByKey\s*\(", 12),
    ("spark", r"\.groupByKey\s*\(", 10),
    ("spark", r"\.sortByKey\s*\(", 10),
    ("spark", r"\.saveAsTextFile\s*\(", 10),
    ("spark", r"spark\.sql\s*\(", 15),
    ("spark", r"\.createOrReplaceTempView\s*\(", 12),
    ("spark", r"\.createTempView\s*\(", 10),
    ("spark", r"\.registerTempTable\s*\(", 10),
    ("spark", r"from\s+pyspark\b", 20),
    ("spark", r"import\s+pyspark\b", 20),
    ("spark", r"pyspark\.sql", 15),
    ("spark", r"pyspark\.ml", 15),
    ("spark", r"pyspark\.mllib", 15),
    ("spark", r"pyspark\.streaming", 15),
    ("spark", r"spark-submit", 20),
    ("spark", r"spark2-submit", 20),
    ("spark", r"SparkSubmit", 15),
    ("spark", r"spark\.jars", 10),
    ("spark", r"spark\.executor", 12),
    ("spark", r"spark\.driver", 12),
    ("spark", r"--master\s+(yarn|local|spark://|mesos://|k8s://)", 15),
    ("spark", r"findspark\.init", 15),
    ("flink", r"\bStreamExecutionEnvironment\b", 25),
    ("flink", r"\bExecutionEnvironment\b", 20),
    ("flink", r"\bTableEnvironment\b", 20),
    ("flink", r"\bStreamTableEnvironment\b", 25),
    ("flink", r"\bBatchTableEnvironment\b", 20),
    ("flink", r"\.getExecutionEnvironment\s*\(", 20),
    ("flink", r"\.createLocalEnvironment\s*\(", 15),
    ("flink", r"\.addSource\s*\(", 15),
    ("flink", r"\.addSink\s*\(", 15),
    ("flink", r"\.keyBy\s*\(", 12),
    ("flink", r"\.timeWindow\s*\(", 15),
    ("flink", r"\.countWindow\s*\(", 15),
    ("flink", r"\.assignTimestampsAndWatermarks\s*\(", 18),
    ("flink", r"\.getSideOutput\s*\(", 12),
    ("flink", r"\.executeSql\s*\(", 15),
    ("flink", r"\.sqlQuery\s*\(", 12),
    ("flink", r"\.createTemporaryView\s*\(", 10),
    ("flink", r"'connector'\s*=", 15),
    ("flink", r"'format'\s*=", 10),
    ("flink", r"WATERMARK\s+FOR\b", 20),
    ("flink", r"TUMBLE\s*\(", 18),
    ("flink", r"HOP\s*\(", 18),
    ("flink", r"SESSION\s*\(", 18),
    ("flink", r"MATCH_RECOGNIZE\b", 20),
    ("flink", r"org\.apache\.flink\b", 25),
    ("flink", r"from\s+pyflink\b", 25),
    ("flink", r"import\s+pyflink\b", 25),
    ("flink", r"pyflink\.datastream", 20),
    ("flink", r"pyflink\.table", 20),
    ("flink", r"FlinkKafkaConsumer", 20),
    ("flink", r"FlinkKafkaProducer", 20),
    ("flink", r"JdbcSink", 15),
    ("flink", r"FileSink", 12),
    ("flink", r"FileSource", 12),
    ("flink", r"flink\s+run\b", 20),
    ("flink", r"flink-run", 15),
    ("flink", r"FlinkRunner", 15),
    ("flink", r"flink\.execution", 12),
    ("flink", r"flink\.parallelism", 12),
    ("flink", r"flink\.checkpointing", 15),
    ("flink", r"state\.backend", 12),
    ("flink", r"checkpoint\.interval", 12),
    ("presto", r"\bpresto\b.*\bquery\b", 15),
    ("presto", r"presto://", 20),
    ("presto", r"prestodb", 20),
    ("presto", r"from\s+prestodb\b", 20),
    ("presto", r"PrestoClient", 20),
    ("presto", r"presto-cli", 15),
    ("presto", r"--catalog\s+\w+\s+--schema", 10),
    ("trino", r"\btrino\b.*\bquery\b", 15),
    ("trino", r"trino://", 20),
    ("trino", r"from\s+trino\b", 20),
    ("trino", r"TrinoClient", 20),
    ("trino", r"trino-cli", 15),
    ("kafka", r"from\s+kafka\b", 20),
    ("kafka", r"kafka-python", 15),
    ("kafka", r"kafka://", 15),
    ("kafka", r"confluent_kafka", 20),
]

# --- fixed values: rewrite rules for Spark code: name, pattern, replacement, priority, version, is a regular expression, may be applied ---
SPARK_REWRITES = [
    ("import_functions_alias", "from pyspark.sql.functions import *", "from pyspark.sql import functions as F", 100, "3.0", False, True),
    ("import_spark_context_deprecated", "from pyspark import SparkContext", "from pyspark.sql import SparkSession", 100, "3.0", False, True),
    ("import_sql_context_deprecated", "from pyspark.sql import SQLContext", "from pyspark.sql import SparkSession", 100, "3.0", False, True),
    ("import_hive_context_deprecated", "from pyspark.sql import HiveContext", "from pyspark.sql import SparkSession", 100, "3.0", False, True),
    ("spark_context_to_session", r"sc\s*=\s*SparkContext\(\)", "spark = SparkSession.builder.getOrCreate()\nsc = spark.sparkContext", 90, "3.0", True, True),
    ("sql_context_to_session", r"SQLContext\(sc\)", "SparkSession.builder.getOrCreate()", 90, "3.0", True, True),
    ("hive_context_to_session", r"HiveContext\(sc\)", "SparkSession.builder.enableHiveSupport().getOrCreate()", 90, "3.0", True, True),
    ("register_temp_table", ".registerTempTable(", ".createOrReplaceTempView(", 80, "3.0", False, True),
    ("union_all_deprecated", ".unionAll(", ".union(", 80, "3.0", False, True),
    ("na_fill_to_fillna", ".na.fill(", ".fillna(", 70, "3.0", False, True),
    ("na_drop_to_dropna", ".na.drop(", ".dropna(", 70, "3.0", False, True),
    ("shuffle_partitions_aqe", r"\.conf\.set\(['\"]spark\.sql\.shuffle\.partitions['\"],\s*['\"]?\d+['\"]?\)", ".conf.set('spark.sql.adaptive.enabled', 'true')", 60, "3.0", True, False),
    ("pandas_arrow_config", "spark.conf.set('spark.sql.execution.arrow.enabled', 'true')", "spark.conf.set('spark.sql.execution.arrow.pyspark.enabled', 'true')", 60, "3.0", False, True),
    ("cast_string_type", r"\.cast\(['\"]string['\"]\)", ".cast(StringType())", 50, "3.0", True, False),
    ("cast_integer_type", r"\.cast\(['\"]int['\"]\)", ".cast(IntegerType())", 50, "3.0", True, False),
    ("udf_return_type", r"@udf\(\)", "@udf(returnType=StringType())", 40, "3.0", True, False),
    ("pandas_udf_type", "PandasUDFType.SCALAR", "'scalar'", 40, "3.0", False, True),
    ("pandas_udf_grouped_map", "PandasUDFType.GROUPED_MAP", "'grouped_map'", 40, "3.0", False, True),
    ("rdd_map_warning", r"\.rdd\.map\(", ".rdd.map(", 30, "3.0", True, False),
    ("rdd_flatmap_warning", r"\.rdd\.flatMap\(", ".rdd.flatMap(", 30, "3.0", True, False),
    ("aqe_recommendation", "spark.sql.adaptive.enabled", "spark.sql.adaptive.enabled", 20, "3.0", False, False),
]

# --- fixed values: checks of Spark code by line: text, severity ---
SPARK_CHECKS = [
    ("SparkContext()", "warning"),
    ("SQLContext", "warning"),
    ("HiveContext", "warning"),
    (".registerTempTable(", "warning"),
    (".unionAll(", "warning"),
    ("from pyspark.sql.functions import *", "info"),
    (".rdd.map(", "info"),
    (".rdd.flatMap(", "info"),
    (".toPandas()", "info"),
    ("PandasUDFType", "warning"),
]

# --- fixed values: modules of workflow definitions and where they went (None: gone) ---
MODULE_MOVES = [
    ("airflow.operators.python_operator", "airflow.operators.python"),
    ("airflow.operators.bash_operator", "airflow.operators.bash"),
    ("airflow.operators.dummy_operator", "airflow.operators.empty"),
    ("airflow.operators.dummy", "airflow.operators.empty"),
    ("airflow.operators.email_operator", "airflow.operators.email"),
    ("airflow.operators.subdag_operator", None),
    ("airflow.operators.latest_only_operator", "airflow.operators.latest_only"),
    ("airflow.sensors.base_sensor_operator", "airflow.sensors.base"),
    ("airflow.sensors.external_task_sensor", "airflow.sensors.external_task"),
    ("airflow.sensors.time_sensor", "airflow.sensors.time_sensor"),
    ("airflow.hooks.base_hook", "airflow.hooks.base"),
    ("airflow.hooks.dbapi_hook", "airflow.hooks.dbapi"),
    ("airflow.contrib.operators.bigquery_operator", "airflow.providers.google.cloud.operators.bigquery"),
    ("airflow.contrib.operators.gcs_to_bq", "airflow.providers.google.cloud.transfers.gcs_to_bigquery"),
    ("airflow.contrib.operators.dataproc_operator", "airflow.providers.google.cloud.operators.dataproc"),
    ("airflow.contrib.operators.slack_webhook_operator", "airflow.providers.slack.operators.slack_webhook"),
    ("airflow.contrib.operators.ssh_operator", "airflow.providers.ssh.operators.ssh"),
    ("airflow.contrib.operators.sftp_operator", "airflow.providers.sftp.operators.sftp"),
    ("airflow.contrib.hooks.bigquery_hook", "airflow.providers.google.cloud.hooks.bigquery"),
    ("airflow.contrib.hooks.gcs_hook", "airflow.providers.google.cloud.hooks.gcs"),
    ("airflow.contrib.hooks.slack_webhook_hook", "airflow.providers.slack.hooks.slack_webhook"),
    ("airflow.contrib.sensors.bigquery_sensor", "airflow.providers.google.cloud.sensors.bigquery"),
    ("airflow.contrib.operators.aws_athena_operator", "airflow.providers.amazon.aws.operators.athena"),
    ("airflow.contrib.operators.s3_to_redshift_operator", "airflow.providers.amazon.aws.transfers.s3_to_redshift"),
    ("airflow.contrib.hooks.aws_hook", "airflow.providers.amazon.aws.hooks.base_aws"),
    ("airflow.contrib.hooks.s3_hook", "airflow.providers.amazon.aws.hooks.s3"),
    ("airflow.contrib.sensors.s3_key_sensor", "airflow.providers.amazon.aws.sensors.s3"),
    ("airflow.operators.postgres_operator", "airflow.providers.postgres.operators.postgres"),
    ("airflow.operators.mysql_operator", "airflow.providers.mysql.operators.mysql"),
    ("airflow.operators.mssql_operator", "airflow.providers.microsoft.mssql.operators.mssql"),
    ("airflow.operators.oracle_operator", "airflow.providers.oracle.operators.oracle"),
    ("airflow.hooks.postgres_hook", "airflow.providers.postgres.hooks.postgres"),
    ("airflow.hooks.mysql_hook", "airflow.providers.mysql.hooks.mysql"),
    ("airflow.hooks.mssql_hook", "airflow.providers.microsoft.mssql.hooks.mssql"),
    ("airflow.hooks.oracle_hook", "airflow.providers.oracle.hooks.oracle"),
]

# --- fixed values: operator classes and their new names ---
CLASS_RENAMES = [
    ("DummyOperator", "EmptyOperator"),
    ("BigQueryOperator", "BigQueryInsertJobOperator"),
    ("DataProcPySparkOperator", "DataprocSubmitJobOperator"),
    ("DataProcSparkOperator", "DataprocSubmitJobOperator"),
    ("GoogleCloudStorageToBigQueryOperator", "GCSToBigQueryOperator"),
]

# --- fixed values: how SQL is found in code: statement words, words of each dialect in the order they are tried ---
SQL_STARTS = "SELECT INSERT UPDATE DELETE CREATE DROP ALTER TRUNCATE MERGE WITH EXPLAIN DESCRIBE DESC SHOW USE SET LOAD EXPORT IMPORT MSCK ANALYZE GRANT REVOKE REFRESH INVALIDATE COMPUTE".split()
SQL_INSIDE = "SELECT INSERT UPDATE DELETE CREATE".split()
DIALECTS = [
    ("impala", ["INVALIDATE METADATA", "REFRESH", "COMPUTE STATS", "COMPUTE INCREMENTAL STATS"]),
    ("spark", ["CACHE TABLE", "UNCACHE TABLE", "CLEAR CACHE", "REFRESH TABLE", "ADD JAR", "ADD FILE"]),
    ("hive", ["MSCK", "LOAD DATA", "EXPORT TABLE", "IMPORT TABLE", "CLUSTERED BY", "PARTITIONED BY", "STORED AS"]),
]
# --- fixed values: names that hold SQL, calls that take it, shell commands that run it ---
SQL_NAMES, SQL_CALLS = "sql|query|hql|statement|cmd", "sql|execute|executeQuery|executeUpdate"
SHELL_RUNNERS = [("hive", "-e"), ("beeline", "-e"), ("impala-shell", "-q"), ("spark-sql", "-e")]

# --- fixed values: a table name, and the statements that name one: kind, words before the name ---
NAME_PART = r"(?:`[^`]+`|\"[^\"]+\"|\w+|\{[A-Za-z_]\w*\}|\$\{[A-Za-z_]\w*\}|\$[A-Za-z_]\w*)"
STATEMENTS = [
    ("select_from", r"\bFROM\s+"),
    ("join", r"\b(?:INNER\s+JOIN|LEFT\s+JOIN|RIGHT\s+JOIN|FULL\s+JOIN|CROSS\s+JOIN|JOIN)\s+"),
    ("insert", r"\bINSERT\s+(?:INTO\s+(?:TABLE\s+)?|OVERWRITE\s+TABLE\s+)"),
    ("update", r"\bUPDATE\s+"),
    ("delete", r"\bDELETE\s+FROM\s+"),
    ("create", r"\bCREATE\s+(?:EXTERNAL\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?"),
    ("load_data", r"\bLOAD\s+DATA\s+(?:LOCAL\s+)?INPATH\s+[^\s]+\s+(?:OVERWRITE\s+)?INTO\s+TABLE\s+"),
    ("msck_repair", r"\bMSCK\s+(?:REPAIR\s+)?TABLE\s+"),
    ("export_table", r"\bEXPORT\s+TABLE\s+"),
    ("import_table", r"\bIMPORT\s+(?:EXTERNAL\s+)?TABLE\s+"),
    ("analyze", r"\bANALYZE\s+TABLE\s+"),
    ("describe", r"\b(?:DESCRIBE|DESC)\s+(?:EXTENDED\s+|FORMATTED\s+)?"),
    ("show_table", r"\bSHOW\s+(?:PARTITIONS|CREATE\s+TABLE|COLUMNS\s+(?:IN|FROM)|TBLPROPERTIES)\s+"),
    ("drop", r"\bDROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?"),
    ("alter", r"\bALTER\s+TABLE\s+"),
    ("truncate", r"\bTRUNCATE\s+(?:TABLE\s+)?"),
]
# --- fixed values: words that are no table name ---
SQL_WORDS = """SELECT FROM WHERE JOIN INNER LEFT RIGHT FULL CROSS ON AND OR NOT IN EXISTS BETWEEN LIKE INSERT INTO VALUES UPDATE SET DELETE CREATE DROP
ALTER TABLE INDEX VIEW DATABASE SCHEMA AS WITH UNION INTERSECT EXCEPT ORDER BY GROUP HAVING LIMIT OFFSET DISTINCT ALL ANY SOME CASE WHEN THEN ELSE END IF
NULL IS TRUE FALSE TRUNCATE ASC DESC PRIMARY KEY FOREIGN REFERENCES CONSTRAINT UNIQUE CHECK DEFAULT AUTO_INCREMENT CASCADE OVERWRITE DIRECTORY PARTITION
PARTITIONED CLUSTERED DISTRIBUTED SORTED ROW FORMAT DELIMITED FIELDS TERMINATED COLLECTION ITEMS MAP STORED TEXTFILE SEQUENCEFILE ORC PARQUET RCFILE
INPUTFORMAT OUTPUTFORMAT EXTERNAL LOCATION TBLPROPERTIES SERDEPROPERTIES SERDE LOAD DATA LOCAL INPATH MSCK REPAIR EXPORT IMPORT ANALYZE COMPUTE STATISTICS
DESCRIBE EXTENDED FORMATTED SHOW PARTITIONS COLUMNS LATERAL EXPLODE POSEXPLODE INLINE STACK BUCKETS SKEWED""".split()

# --- fixed values: methods of frames and of RDDs, Spark modules, deprecated names and what takes their place ---
FRAME_METHODS = """select filter where groupBy agg join union withColumn withColumnRenamed drop distinct orderBy sort limit show collect count first head take
toPandas createOrReplaceTempView write read cache persist unpersist repartition coalesce crossJoin alias toDF printSchema explain dropDuplicates fillna na
replace sample randomSplit subtract intersect exceptAll""".split()
RDD_METHODS = """map flatMap filter reduce reduceByKey groupByKey sortByKey join cogroup cartesian pipe coalesce repartition sample union intersection distinct
groupBy aggregate fold foreach foreachPartition collect count first take top takeOrdered saveAsTextFile saveAsSequenceFile saveAsObjectFile countByKey
countByValue collectAsMap lookup parallelize textFile wholeTextFiles""".split()
DEPRECATED = [
    ("SparkContext", "SparkSession.builder.getOrCreate()"),
    ("SQLContext", "SparkSession"),
    ("HiveContext", "SparkSession.builder.enableHiveSupport()"),
    ("registerTempTable", "createOrReplaceTempView"),
    ("unionAll", "union"),
    ("na.fill", "fillna"),
    ("na.drop", "dropna"),
    ("toPandas", "toPandas"),
]

# --- fixed values: prefixes of modules and the package that brings them; the first prefix that fits holds ---
PROVIDERS = [
    ("airflow.providers.google", "apache-airflow-providers-google"),
    ("airflow.providers.amazon", "apache-airflow-providers-amazon"),
    ("airflow.providers.microsoft.azure", "apache-airflow-providers-microsoft-azure"),
    ("airflow.providers.microsoft.mssql", "apache-airflow-providers-microsoft-mssql"),
    ("airflow.providers.postgres", "apache-airflow-providers-postgres"),
    ("airflow.providers.mysql", "apache-airflow-providers-mysql"),
    ("airflow.providers.oracle", "apache-airflow-providers-oracle"),
    ("airflow.providers.jdbc", "apache-airflow-providers-jdbc"),
    ("airflow.providers.sqlite", "apache-airflow-providers-common-sql"),
    ("airflow.providers.slack", "apache-airflow-providers-slack"),
    ("airflow.providers.ssh", "apache-airflow-providers-ssh"),
    ("airflow.providers.sftp", "apache-airflow-providers-sftp"),
    ("airflow.providers.apache.spark", "apache-airflow-providers-apache-spark"),
    ("airflow.providers.cncf.kubernetes", "apache-airflow-providers-cncf-kubernetes"),
    ("airflow.providers.docker", "apache-airflow-providers-docker"),
    ("airflow.providers.http", "apache-airflow-providers-http"),
]
# --- fixed values: parameters of workflows and operators: pattern, new text ---
PARAM_RENAMES = [
    (r"(?<![\w.])schedule_interval(?=\s*=)", "schedule"),
    (r"(?<![\w.])concurrency(?=\s*=)", "max_active_tasks"),
    (r"(?<![\w.])task_concurrency(?=\s*=)", "max_active_tis_per_dag"),
    (r",?\s*provide_context\s*=\s*(?:True|False)", ""),
]
# --- fixed values: weights and grades of scores ---
SPARK_WEIGHTS = {"error": 0.3, "warning": 0.1, "info": 0.02}
FLOW_WEIGHTS = {"error": 20, "warning": 5, "info": 1}
LINT_WEIGHTS = {"error": 10, "warning": 5, "info": 1}
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D"), (0, "F")]

# --- fixed values: checks of workflow definitions ---
REMOVED_MODULES = ["SubDagOperator", "airflow.operators.subdag_operator", "airflow.contrib"]
OLD_MODULES = [
    ("airflow.operators.python_operator", "airflow.operators.python"),
    ("airflow.operators.bash_operator", "airflow.operators.bash"),
    ("airflow.operators.dummy_operator", "airflow.operators.empty"),
]
OLD_PARAMS = [
    ("schedule_interval", "warning", "deprecated_param"),
    ("provide_context", "info", "unnecessary_param"),
    ("execution_date", "warning", "deprecated_param"),
]
OLD_CONTEXT = ["execution_date", "next_execution_date", "prev_execution_date"]
#: Modules that tell an old version when they are imported.
OLD_VERSION_MODULES = [
    "airflow.operators.python_operator", "airflow.operators.bash_operator", "airflow.operators.dummy_operator", "airflow.operators.email_operator",
    "airflow.operators.subdag_operator", "airflow.contrib.operators", "airflow.contrib.hooks", "airflow.contrib.sensors",
]
BASE_REQUIREMENT = "apache-airflow>=2.7.0"
