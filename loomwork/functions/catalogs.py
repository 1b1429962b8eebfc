"""Catalogs of changes between versions: what is called otherwise, deprecated or gone. Values only."""

from __future__ import annotations

# --- fixed values: changed calls: category, old, new, version ---
API_CHANGES = [
    ("session", "SparkContext()", "SparkSession.builder.getOrCreate().sparkContext", "3.0"),
    ("session", "SQLContext(sc)", "SparkSession.builder.getOrCreate()", "3.0"),
    ("session", "HiveContext(sc)", "SparkSession.builder.enableHiveSupport().getOrCreate()", "3.0"),
    ("dataframe", ".registerTempTable(", ".createOrReplaceTempView(", "3.0"),
    ("dataframe", ".unionAll(", ".union(", "3.0"),
    ("dataframe", ".na.fill(", ".fillna(", "3.0"),
    ("dataframe", ".na.drop(", ".dropna(", "3.0"),
    ("dataframe", ".toDF(*cols)", ".toDF(*cols)", "3.0"),
    ("import", "from pyspark.sql.functions import *", "from pyspark.sql import functions as F", "3.0"),
    ("types", "col('col').cast('string')", "col('col').cast(StringType())", "3.0"),
    ("types", "col('col').cast('int')", "col('col').cast(IntegerType())", "3.0"),
    ("types", "col('col').cast('double')", "col('col').cast(DoubleType())", "3.0"),
    ("udf", "@udf()", "@udf(returnType=StringType())", "3.0"),
    ("udf", "PandasUDFType.SCALAR", "'scalar'", "3.0"),
    ("udf", "PandasUDFType.GROUPED_MAP", "'grouped_map'", "3.0"),
    ("udf", "PandasUDFType.GROUPED_AGG", "'grouped_agg'", "3.0"),
    ("io", ".option('header', 'true')", ".option('header', True)", "3.0"),
    ("io", ".option('inferSchema', 'true')", ".option('inferSchema', True)", "3.0"),
    ("io", ".save(path)", ".save(path)", "3.0"),
    ("window", "Window.partitionBy(", "Window.partitionBy(", "3.0"),
]

# --- fixed values: settings: category, old (empty: a new one), new, version, default, may be applied ---
CONFIG_CHANGES = [
    ("sql", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "3.0", "true", False),
    ("sql", "spark.sql.execution.arrow.enabled", "spark.sql.execution.arrow.pyspark.enabled", "3.0", "true", True),
    ("sql", "spark.sql.execution.arrow.fallback.enabled", "spark.sql.execution.arrow.pyspark.fallback.enabled", "3.0", "true", True),
    ("sql", "spark.sql.hive.convertMetastoreParquet", "spark.sql.hive.convertMetastoreParquet", "3.0", None, False),
    ("performance", "spark.sql.adaptive.enabled", "spark.sql.adaptive.enabled", "3.0", "true", True),
    ("performance", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.adaptive.coalescePartitions.enabled", "3.0", "true", True),
    ("performance", "spark.sql.adaptive.skewJoin.enabled", "spark.sql.adaptive.skewJoin.enabled", "3.0", "true", True),
    ("performance", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.autoBroadcastJoinThreshold", "3.0", "10485760", False),
    ("memory", "spark.memory.fraction", "spark.memory.fraction", "3.0", "0.6", False),
    ("memory", "spark.memory.storageFraction", "spark.memory.storageFraction", "3.0", "0.5", False),
    ("serialization", "spark.serializer", "spark.serializer", "3.0", "org.apache.spark.serializer.KryoSerializer", False),
    ("serialization", "spark.kryo.unsafe", "spark.kryo.unsafe", "3.0", "false", False),
    ("deprecated", "spark.yarn.executor.memoryOverhead", "spark.executor.memoryOverhead", "3.0", None, True),
    ("deprecated", "spark.yarn.driver.memoryOverhead", "spark.driver.memoryOverhead", "3.0", None, True),
    ("deprecated", "spark.yarn.am.memoryOverhead", "spark.yarn.am.memoryOverhead", "3.0", None, False),
    ("new", "", "spark.sql.adaptive.enabled", "3.0", "true", False),
    ("new", "", "spark.sql.adaptive.coalescePartitions.enabled", "3.0", "true", False),
    ("new", "", "spark.sql.adaptive.skewJoin.enabled", "3.0", "true", False),
    ("new", "", "spark.sql.adaptive.localShuffleReader.enabled", "3.0", "true", False),
]

# --- fixed values: deprecated calls: category, pattern, replacement, version, severity ---
DEPRECATIONS = [
    ("context", r"SparkContext\(\)", "SparkSession.builder.getOrCreate()", "3.0", "warning"),
    ("context", r"SQLContext\(", "SparkSession.builder.getOrCreate()", "3.0", "warning"),
    ("context", r"HiveContext\(", "SparkSession.builder.enableHiveSupport().getOrCreate()", "3.0", "warning"),
    ("rdd", r"\.rdd\.map\(", ".select(F.expr(...))", "3.0", "info"),
    ("rdd", r"\.rdd\.flatMap\(", ".select(F.explode(...))", "3.0", "info"),
    ("rdd", r"\.rdd\.filter\(", ".filter(...)", "3.0", "info"),
    ("rdd", r"\.rdd\.reduce\(", ".agg(...)", "3.0", "info"),
    ("dataframe", r"\.registerTempTable\(", ".createOrReplaceTempView(", "3.0", "warning"),
    ("dataframe", r"\.unionAll\(", ".union(", "3.0", "warning"),
    ("dataframe", r"\.toPandas\(\)", ".toPandas()", "3.0", "info"),
    ("udf", r"PandasUDFType\.SCALAR", "'scalar'", "3.0", "warning"),
    ("udf", r"PandasUDFType\.GROUPED_MAP", "'grouped_map'", "3.0", "warning"),
    ("udf", r"PandasUDFType\.GROUPED_AGG", "'grouped_agg'", "3.0", "warning"),
    ("udf", r"@udf\(\s*\)", "@udf(returnType=...)", "3.0", "warning"),
    ("import", r"from pyspark\.sql\.functions import \*", "from pyspark.sql import functions as F", "3.0", "info"),
    ("import", "from pyspark import SparkContext", "from pyspark.sql import SparkSession", "3.0", "info"),
]

# --- fixed values: changed syntax: category, pattern, replacement, version, is a regular expression, may be applied ---
SYNTAX_CHANGES = [
    ("types", "\\.cast\\(['\\\"]string['\\\"]\\)", ".cast(StringType())", "3.0", True, False),
    ("types", "\\.cast\\(['\\\"]int['\\\"]\\)", ".cast(IntegerType())", "3.0", True, False),
    ("types", "\\.cast\\(['\\\"]integer['\\\"]\\)", ".cast(IntegerType())", "3.0", True, False),
    ("types", "\\.cast\\(['\\\"]long['\\\"]\\)", ".cast(LongType())", "3.0", True, False),
    ("types", "\\.cast\\(['\\\"]double['\\\"]\\)", ".cast(DoubleType())", "3.0", True, False),
    ("types", "\\.cast\\(['\\\"]float['\\\"]\\)", ".cast(FloatType())", "3.0", True, False),
    ("types", "\\.cast\\(['\\\"]boolean['\\\"]\\)", ".cast(BooleanType())", "3.0", True, False),
    ("types", "\\.cast\\(['\\\"]timestamp['\\\"]\\)", ".cast(TimestampType())", "3.0", True, False),
    ("types", "\\.cast\\(['\\\"]date['\\\"]\\)", ".cast(DateType())", "3.0", True, False),
    ("functions", "col(", "F.col(", "3.0", False, False),
    ("functions", "lit(", "F.lit(", "3.0", False, False),
    ("functions", "when(", "F.when(", "3.0", False, False),
    ("functions", "sum(", "F.sum(", "3.0", False, False),
    ("functions", "count(", "F.count(", "3.0", False, False),
    ("datetime", "from_unixtime(", "F.from_unixtime(", "3.0", False, False),
    ("datetime", "unix_timestamp(", "F.unix_timestamp(", "3.0", False, False),
    ("datetime", "to_date(", "F.to_date(", "3.0", False, False),
    ("datetime", "to_timestamp(", "F.to_timestamp(", "3.0", False, False),
    ("datetime", "date_format(", "F.date_format(", "3.0", False, False),
    ("string", "concat(", "F.concat(", "3.0", False, False),
    ("string", "concat_ws(", "F.concat_ws(", "3.0", False, False),
    ("string", "substring(", "F.substring(", "3.0", False, False),
    ("string", "trim(", "F.trim(", "3.0", False, False),
    ("string", "lower(", "F.lower(", "3.0", False, False),
    ("string", "upper(", "F.upper(", "3.0", False, False),
    ("aggregate", "avg(", "F.avg(", "3.0", False, False),
    ("aggregate", "max(", "F.max(", "3.0", False, False),
    ("aggregate", "min(", "F.min(", "3.0", False, False),
    ("aggregate", "first(", "F.first(", "3.0", False, False),
    ("aggregate", "last(", "F.last(", "3.0", False, False),
    ("window", "row_number(", "F.row_number(", "3.0", False, False),
    ("window", "rank(", "F.rank(", "3.0", False, False),
    ("window", "dense_rank(", "F.dense_rank(", "3.0", False, False),
    ("window", "lag(", "F.lag(", "3.0", False, False),
    ("window", "lead(", "F.lead(", "3.0", False, False),
]

# --- fixed values: modules and their new places (None: gone) ---
MODULES = [
    ("airflow.operators.python_operator", "airflow.operators.python"),
    ("airflow.operators.bash_operator", "airflow.operators.bash"),
    ("airflow.operators.dummy_operator", "airflow.operators.empty"),
    ("airflow.operators.dummy", "airflow.operators.empty"),
    ("airflow.operators.email_operator", "airflow.operators.email"),
    ("airflow.operators.subdag_operator", None),
    ("airflow.operators.latest_only_operator", "airflow.operators.latest_only"),
    ("airflow.operators.branch_operator", "airflow.operators.python"),
    ("airflow.sensors.base_sensor_operator", "airflow.sensors.base"),
    ("airflow.sensors.external_task_sensor", "airflow.sensors.external_task"),
    ("airflow.sensors.time_sensor", "airflow.sensors.time_sensor"),
    ("airflow.sensors.sql_sensor", "airflow.sensors.sql"),
    ("airflow.hooks.base_hook", "airflow.hooks.base"),
    ("airflow.hooks.dbapi_hook", "airflow.hooks.dbapi"),
    ("airflow.hooks.http_hook", "airflow.providers.http.hooks.http"),
    ("airflow.operators.postgres_operator", "airflow.providers.postgres.operators.postgres"),
    ("airflow.operators.mysql_operator", "airflow.providers.mysql.operators.mysql"),
    ("airflow.operators.mssql_operator", "airflow.providers.microsoft.mssql.operators.mssql"),
    ("airflow.operators.oracle_operator", "airflow.providers.oracle.operators.oracle"),
    ("airflow.operators.jdbc_operator", "airflow.providers.jdbc.operators.jdbc"),
    ("airflow.operators.sqlite_operator", "airflow.providers.sqlite.operators.sqlite"),
    ("airflow.hooks.postgres_hook", "airflow.providers.postgres.hooks.postgres"),
    ("airflow.hooks.mysql_hook", "airflow.providers.mysql.hooks.mysql"),
    ("airflow.hooks.mssql_hook", "airflow.providers.microsoft.mssql.hooks.mssql"),
    ("airflow.hooks.oracle_hook", "airflow.providers.oracle.hooks.oracle"),
    ("airflow.hooks.jdbc_hook", "airflow.providers.jdbc.hooks.jdbc"),
    ("airflow.hooks.sqlite_hook", "airflow.providers.sqlite.hooks.sqlite"),
    ("airflow.contrib.operators.bigquery_operator", "airflow.providers.google.cloud.operators.bigquery"),
    ("airflow.contrib.operators.bigquery_to_gcs", "airflow.providers.google.cloud.transfers.bigquery_to_gcs"),
    ("airflow.contrib.operators.bigquery_to_bigquery", "airflow.providers.google.cloud.transfers.bigquery_to_bigquery"),
    ("airflow.contrib.operators.gcs_to_bq", "airflow.providers.google.cloud.transfers.gcs_to_bigquery"),
    ("airflow.contrib.operators.gcs_to_gcs", "airflow.providers.google.cloud.transfers.gcs_to_gcs"),
    ("airflow.contrib.operators.gcs_operator", "airflow.providers.google.cloud.operators.gcs"),
    ("airflow.contrib.operators.dataproc_operator", "airflow.providers.google.cloud.operators.dataproc"),
    ("airflow.contrib.operators.dataflow_operator", "airflow.providers.google.cloud.operators.dataflow"),
    ("airflow.contrib.operators.pubsub_operator", "airflow.providers.google.cloud.operators.pubsub"),
    ("airflow.contrib.operators.gcp_sql_operator", "airflow.providers.google.cloud.operators.cloud_sql"),
    ("airflow.contrib.hooks.bigquery_hook", "airflow.providers.google.cloud.hooks.bigquery"),
    ("airflow.contrib.hooks.gcs_hook", "airflow.providers.google.cloud.hooks.gcs"),
    ("airflow.contrib.hooks.dataproc_hook", "airflow.providers.google.cloud.hooks.dataproc"),
    ("airflow.contrib.sensors.bigquery_sensor", "airflow.providers.google.cloud.sensors.bigquery"),
    ("airflow.contrib.sensors.gcs_sensor", "airflow.providers.google.cloud.sensors.gcs"),
    ("airflow.contrib.operators.aws_athena_operator", "airflow.providers.amazon.aws.operators.athena"),
    ("airflow.contrib.operators.s3_to_redshift_operator", "airflow.providers.amazon.aws.transfers.s3_to_redshift"),
    ("airflow.contrib.operators.redshift_to_s3_operator", "airflow.providers.amazon.aws.transfers.redshift_to_s3"),
    ("airflow.contrib.operators.s3_copy_object_operator", "airflow.providers.amazon.aws.operators.s3"),
    ("airflow.contrib.operators.s3_delete_objects_operator", "airflow.providers.amazon.aws.operators.s3"),
    ("airflow.contrib.operators.s3_list_operator", "airflow.providers.amazon.aws.operators.s3"),
    ("airflow.contrib.operators.emr_add_steps_operator", "airflow.providers.amazon.aws.operators.emr"),
    ("airflow.contrib.operators.emr_create_job_flow_operator", "airflow.providers.amazon.aws.operators.emr"),
    ("airflow.contrib.operators.emr_terminate_job_flow_operator", "airflow.providers.amazon.aws.operators.emr"),
    ("airflow.contrib.operators.ecs_operator", "airflow.providers.amazon.aws.operators.ecs"),
    ("airflow.contrib.operators.sagemaker_operator", "airflow.providers.amazon.aws.operators.sagemaker"),
    ("airflow.contrib.hooks.aws_hook", "airflow.providers.amazon.aws.hooks.base_aws"),
    ("airflow.contrib.hooks.s3_hook", "airflow.providers.amazon.aws.hooks.s3"),
    ("airflow.contrib.hooks.redshift_hook", "airflow.providers.amazon.aws.hooks.redshift_sql"),
    ("airflow.contrib.hooks.emr_hook", "airflow.providers.amazon.aws.hooks.emr"),
    ("airflow.contrib.sensors.s3_key_sensor", "airflow.providers.amazon.aws.sensors.s3"),
    ("airflow.contrib.sensors.s3_prefix_sensor", "airflow.providers.amazon.aws.sensors.s3"),
    ("airflow.contrib.sensors.emr_step_sensor", "airflow.providers.amazon.aws.sensors.emr"),
    ("airflow.contrib.operators.wasb_delete_blob_operator", "airflow.providers.microsoft.azure.operators.wasb_delete_blob"),
    ("airflow.contrib.operators.azure_container_instances_operator", "airflow.providers.microsoft.azure.operators.container_instances"),
    ("airflow.contrib.hooks.wasb_hook", "airflow.providers.microsoft.azure.hooks.wasb"),
    ("airflow.contrib.hooks.azure_data_lake_hook", "airflow.providers.microsoft.azure.hooks.data_lake"),
    ("airflow.contrib.operators.slack_webhook_operator", "airflow.providers.slack.operators.slack_webhook"),
    ("airflow.contrib.operators.ssh_operator", "airflow.providers.ssh.operators.ssh"),
    ("airflow.contrib.operators.sftp_operator", "airflow.providers.sftp.operators.sftp"),
    ("airflow.contrib.operators.spark_submit_operator", "airflow.providers.apache.spark.operators.spark_submit"),
    ("airflow.contrib.operators.spark_sql_operator", "airflow.providers.apache.spark.operators.spark_sql"),
    ("airflow.contrib.operators.kubernetes_pod_operator", "airflow.providers.cncf.kubernetes.operators.pod"),
    ("airflow.contrib.operators.docker_operator", "airflow.providers.docker.operators.docker"),
    ("airflow.contrib.hooks.slack_webhook_hook", "airflow.providers.slack.hooks.slack_webhook"),
    ("airflow.contrib.hooks.ssh_hook", "airflow.providers.ssh.hooks.ssh"),
    ("airflow.contrib.hooks.sftp_hook", "airflow.providers.sftp.hooks.sftp"),
    ("airflow.contrib.hooks.spark_submit_hook", "airflow.providers.apache.spark.hooks.spark_submit"),
]

# --- fixed values: classes within modules ---
CLASSES = [
    ("DummyOperator", "EmptyOperator"),
    ("BaseSensorOperator", "BaseSensor"),
    ("BigQueryOperator", "BigQueryInsertJobOperator"),
    ("GoogleCloudStorageToBigQueryOperator", "GCSToBigQueryOperator"),
    ("GoogleCloudStorageToGoogleCloudStorageOperator", "GCSToGCSOperator"),
    ("S3KeySensor", "S3KeySensor"),
]

# --- fixed values: operators and their new names ---
OPERATORS = [
    ("DummyOperator", "EmptyOperator"),
    ("BigQueryOperator", "BigQueryInsertJobOperator"),
    ("DataProcPySparkOperator", "DataprocSubmitJobOperator"),
    ("DataProcSparkOperator", "DataprocSubmitJobOperator"),
    ("DataProcHadoopOperator", "DataprocSubmitJobOperator"),
    ("DataProcHiveOperator", "DataprocSubmitJobOperator"),
    ("DataProcPigOperator", "DataprocSubmitJobOperator"),
    ("GoogleCloudStorageToBigQueryOperator", "GCSToBigQueryOperator"),
    ("GoogleCloudStorageToGoogleCloudStorageOperator", "GCSToGCSOperator"),
    ("FileToGoogleCloudStorageOperator", "LocalFilesystemToGCSOperator"),
    ("GoogleCloudStorageDownloadOperator", "GCSToLocalFilesystemOperator"),
    ("MySqlToGoogleCloudStorageOperator", "MySQLToGCSOperator"),
    ("S3ToRedshiftTransfer", "S3ToRedshiftOperator"),
    ("RedshiftToS3Transfer", "RedshiftToS3Operator"),
]

# --- fixed values: parameters of workflows ---
DAG_PARAMS = [
    ("schedule_interval", "schedule"),
    ("concurrency", "max_active_tasks"),
    ("max_active_runs", "max_active_runs"),
    ("dagrun_timeout", "dagrun_timeout"),
    ("sla_miss_callback", "sla_miss_callback"),
    ("default_view", "default_view"),
    ("orientation", "orientation"),
]

# --- fixed values: parameters of operators (None: gone) ---
OPERATOR_PARAMS = [
    ("task_concurrency", "max_active_tis_per_dag"),
    ("provide_context", None),
    ("resources", None),
]

# --- fixed values: context variables ---
CONTEXT = [
    ("execution_date", "logical_date"),
    ("next_execution_date", "data_interval_end"),
    ("prev_execution_date", "data_interval_start"),
    ("next_ds", "ds"),
    ("prev_ds", "ds"),
    ("tomorrow_ds", "ds"),
    ("yesterday_ds", "ds"),
]

# --- fixed values: template variables ---
TEMPLATES = [
    ("{{ execution_date }}", "{{ logical_date }}"),
    ("{{ next_execution_date }}", "{{ data_interval_end }}"),
    ("{{ prev_execution_date }}", "{{ data_interval_start }}"),
    ("{{ ds }}", "{{ ds }}"),
    ("{{ ts }}", "{{ ts }}"),
    ("{{ next_ds }}", "{{ data_interval_end | ds }}"),
    ("{{ prev_ds }}", "{{ data_interval_start | ds }}"),
]

# --- fixed values: types of connections ---
CONNECTIONS = [
    ("bigquery", "google_cloud_platform"),
    ("google_cloud_storage", "google_cloud_platform"),
    ("dataproc", "google_cloud_platform"),
    ("s3", "aws"),
    ("redshift", "redshift"),
    ("emr", "aws"),
]

# --- fixed values: settings by section: section, old, new (None: gone) ---
SECTIONS = [
    ("core", "executor", "executor"),
    ("core", "sql_alchemy_conn", "sql_alchemy_conn"),
    ("core", "parallelism", "parallelism"),
    ("core", "dag_concurrency", "max_active_tasks_per_dag"),
    ("core", "non_pooled_task_slot_count", None),
    ("core", "dag_file_processor_timeout", "dag_file_processor_timeout"),
    ("core", "min_file_process_interval", "min_file_process_interval"),
    ("scheduler", "job_heartbeat_sec", "job_heartbeat_sec"),
    ("scheduler", "scheduler_heartbeat_sec", "scheduler_heartbeat_sec"),
    ("scheduler", "num_runs", "num_runs"),
    ("scheduler", "processor_poll_interval", "processor_poll_interval"),
    ("scheduler", "min_file_parsing_loop_time", "min_file_parsing_loop_time"),
    ("scheduler", "statsd_on", None),
    ("webserver", "base_url", "base_url"),
    ("webserver", "web_server_host", "web_server_host"),
    ("webserver", "web_server_port", "web_server_port"),
    ("webserver", "authenticate", None),
    ("webserver", "filter_by_owner", None),
]
