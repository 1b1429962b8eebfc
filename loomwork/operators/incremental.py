"""Processing only new or changed records: the target table is the state.

Every published row stores the source key and the version (content) it was made
from. A run anti-joins the source against the target's current versions, writes
the rows due into a fresh folder and publishes them as one new version of the
target, by creating the next numbered manifest, which must not exist. A run that
dies before that leaves nothing behind that a reader sees; run again, it finds
the same rows due.
"""

from __future__ import annotations

import json
import time
import uuid

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import content_id, file_key
from ..session import work_path
from .skew import MOST_ROWS, bounded

#: Rows of the target, whatever else a run computes from them.
TARGET = T.StructType(
    [
        T.StructField("run_no", T.IntegerType()),
        T.StructField("run_ix", T.LongType()),
        T.StructField("file_key", T.StringType()),
        T.StructField("version", T.StringType()),
    ]
)
#: Seconds after which a manifest that was not finished is taken for that of a dead run.
STALE = 600
#: A list of runs larger than this does not belong on the driver.
MOST_RUNS = 1_000_000


class Target:
    """A versioned table in a folder: data parts plus numbered manifests, the highest of which holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(f"{self.path}/manifest"))

    def _text(self, no: int) -> dict | None:
        """Manifest ``no``; None if it is not written to its end."""
        stream = self._fs.open(self._at(f"{self.path}/manifest/{no}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith("}\n") else None

    def manifest(self) -> dict:
        """The published state: version, data parts, last run taken in."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/manifest"))]
        for no in sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True):
            if (state := self._text(no)) is not None:
                return state
        return {"version": 0, "parts": [], "last_ix": -1}

    def publish(self, rows: DataFrame, last_ix: int, base: dict | None = None) -> dict:
        """Write ``rows`` and make them part of the table in one step.

        Raises if another run published since ``base`` was read; nothing of
        ``rows`` is then visible. A manifest that a dead run began and did not
        finish is removed once it is STALE seconds old; until then it counts as
        a run that publishes.
        """
        base = base or self.manifest()
        no = base["version"] + 1
        part = f"part-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.path}/data/{part}")
        new = {"version": no, "parts": [*base["parts"], part], "last_ix": last_ix}
        final = self._at(f"{self.path}/manifest/{no}.json")
        if self._fs.exists(final) and self._text(no) is None and time.time() - self._fs.getFileStatus(final).getModificationTime() / 1000 > STALE:
            self._fs.delete(final, False)
        try:
            out = self._fs.create(final, False)  # never overwrites: one of two runs gets the number
        except Py4JJavaError as e:
            raise RuntimeError(f"version {no} of {self.path} was published by another run") from e
        out.write((json.dumps(new) + "\n").encode())
        out.close()
        if self._text(no) != new:
            raise RuntimeError(f"version {no} of {self.path} was taken by another run")
        return new

    def read(self, state: dict | None = None) -> DataFrame:
        parts = (state or self.manifest())["parts"]
        if not parts:
            return self.spark.createDataFrame([], TARGET)
        return self.spark.read.schema(TARGET).parquet(*[f"{self.path}/data/{p}" for p in parts])

    def current(self, state: dict | None = None, keys: DataFrame | None = None) -> DataFrame:
        """Newest version of each key, or of the keys (column file_key) that are asked for.

        Where ``keys`` may be broadcast, only their rows of the target are shuffled.
        """
        rows = self.read(state)
        return (
            (rows if keys is None else rows.join(keys, "file_key", "left_semi"))
            .groupBy("file_key")
            .agg(F.max(F.struct("run_ix", "version")).alias("s"))
            .select("file_key", F.col("s.version").alias("version"))
        )


def feed_lines(feed: DataFrame) -> DataFrame:
    """Lines that say something: key, content, time of arrival, order among ties."""
    return feed.select(
        file_key(F.col("文件目录"), F.col("文件名")).alias("file_key"),
        content_id(F.col("文件md5")).alias("version"),
        F.col("arrived_at").cast("timestamp_ntz").alias("arrived_at"),
        F.col("feed_id"),
    ).dropna(subset=["file_key", "version", "arrived_at"])


def successful_runs(runs: DataFrame) -> list[tuple]:
    """(started_at, run_no) of the successful runs in order; their number is checked first."""
    ok = runs.filter((F.lower(F.trim("run_status")) == "success") & F.col("started_at").isNotNull())
    rows = ok.select(F.col("started_at").cast("timestamp_ntz").alias("started_at"), "run_no").limit(MOST_RUNS + 1).collect()
    if len(rows) > MOST_RUNS:
        raise ValueError(f"more than {MOST_RUNS} runs")
    return sorted((r["started_at"], r["run_no"]) for r in rows)


def lines_by_run(lines: DataFrame, runs: list[tuple]) -> DataFrame:
    """The lines with the index (run_ix) of the first run that sees them, in a table by that index.

    Lines after the last run wait for the next one and are left out.
    """
    starts = np.array([r[0] for r in runs], dtype="datetime64[us]")

    @F.pandas_udf(T.LongType())
    def run_index(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, at.to_numpy(dtype="datetime64[us]"), side="left"))

    spark, path = lines.sparkSession, work_path(lines.sparkSession, "lines")
    placed = lines.withColumn("run_ix", run_index("arrived_at")).filter(F.col("run_ix") < len(runs))
    placed.repartition("run_ix", F.pmod(F.xxhash64("file_key"), F.lit(spark.sparkContext.defaultParallelism))).write.partitionBy("run_ix").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def advance(target: Target, lines: DataFrame, runs: list[tuple], ix: int, state: dict | None = None, rows: int | None = None) -> dict:
    """Take run ``ix`` into the target: one run, one new version of it.

    Of each key among the run's new lines only the newest line counts. It is due
    unless the target's current version of the key is the same, which the
    anti-join removes. Deliveries again, moved dates and failed runs in between
    change nothing. ``lines``: see lines_by_run; ``rows``: how many of them the
    run has, if that was counted.
    """
    state = state or target.manifest()
    fresh = lines.filter(F.col("run_ix") == ix)
    newest = (
        fresh.groupBy("file_key")
        .agg(F.max(F.struct("arrived_at", "feed_id", "version")).alias("s"))
        .select(F.lit(runs[ix][1]).cast("int").alias("run_no"), F.lit(ix).cast("long").alias("run_ix"), "file_key", F.col("s.version").alias("version"))
    )
    asked = fresh.select("file_key")
    asked = bounded(asked) if rows is None else F.broadcast(asked) if rows <= MOST_ROWS else asked.hint("merge")
    held = target.current(state, asked) if state["parts"] else None
    due = newest if held is None else newest.join(held, ["file_key", "version"], "left_anti")
    return target.publish(due.select(*TARGET.names), ix, state)


def replay(feed: DataFrame, runs: DataFrame, target: Target, upto: int | None = None) -> DataFrame:
    """Bring the target up to the last successful run (or to index ``upto``) and return its rows (run_no, file_key, version).

    Runs are taken one by one; each starts from what the target holds and
    publishes one version of it, so a replay that died goes on where it was.
    No successful run or no lines: an empty target.
    """
    order, state = successful_runs(runs), target.manifest()
    last = len(order) - 1 if upto is None else min(upto, len(order) - 1)
    if state["last_ix"] < last:
        lines = lines_by_run(feed_lines(feed), order)
        rows = {r["run_ix"]: r["count"] for r in lines.groupBy("run_ix").count().collect()}  # one for each run, MOST_RUNS at most
        while state["last_ix"] < last:
            ix = state["last_ix"] + 1
            state = advance(target, lines, order, ix, state, rows.get(ix, 0))
    return target.read(state)
