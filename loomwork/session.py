"""Session settings and the shared folder every job writes its cut points to."""

from __future__ import annotations

import os
import sys
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The setting that has the shuffle files of a query deleted at its end.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of staged tables that this process made.
_MADE: list[str] = []


def local_session(app: str = "loomwork", cpus: str | int = 8, **conf: str) -> SparkSession:
    """A local session with the settings tests and the benchmark use."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset (tests on one machine) a folder of our own is made
    and set as the checkpoint folder.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return os.path.dirname(known.get().rstrip("/"))
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="loomwork-")
    sc.setCheckpointDir(own)
    return own


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder. What is written there is deleted when the application ends, or by ``release``."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    _MADE.append(path)
    return path


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def release(spark: SparkSession) -> int:
    """Delete all staged tables of this process now; results that still read them are lost. Their number is returned."""
    n = len(_MADE)
    while _MADE:
        fs, at = _file_system(spark, _MADE.pop())
        fs.delete(at, True)
    return n


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str = "stage", tidy: bool = False) -> DataFrame:
    """Cut the lineage with a table in the shared folder: columnar and compressed, unlike a checkpoint.

    ``tidy``: the shuffle files of the job are deleted as it ends. Else they stay until the driver collects its garbage.
    """
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    was = spark.conf.get(TIDY, None)
    try:
        if tidy:
            spark.conf.set(TIDY, "true")
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(TIDY) if was is None else spark.conf.set(TIDY, was)
    return spark.read.schema(df.schema).parquet(path)


def drop(staged: DataFrame) -> None:
    """Delete a staged table before the application ends. Whatever still reads it is lost."""
    folders = {f.rsplit("/", 2)[-2] for f in staged.inputFiles()}
    for path in [p for p in _MADE if p.rsplit("/", 1)[-1] in folders]:
        fs, at = _file_system(staged.sparkSession, path)
        fs.delete(at, True)
        _MADE.remove(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, for work that costs far more than moving the rows.

    Inputs with a partition per core or more, as all large ones, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(message: str) -> str:
    """Print a message with the time before it, and return the line."""
    line = f"{time.strftime('%Y-%m-%d %H:%M:%S')} {message}"
    print(line, file=sys.stderr)
    return line
