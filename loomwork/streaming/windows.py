"""Tumbling, hopping and session windows, on streams and on tables alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, at: str, late: str) -> DataFrame:
    """Event time as a timestamp, with a watermark where ``df`` is a stream."""
    out = df.withColumn(at, F.col(at).cast("timestamp"))
    return out.withWatermark(at, late) if df.isStreaming else out


def tumbling(df: DataFrame, at: str, size: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return _counted(event_time(df, at, late), F.window(at, size), keys)


def hopping(df: DataFrame, at: str, size: str, slide: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return _counted(event_time(df, at, late), F.window(at, size, slide), keys)


def sessions(df: DataFrame, at: str, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return _counted(event_time(df, at, late), F.session_window(at, gap), keys)


def _counted(df: DataFrame, window, keys: list[str]) -> DataFrame:
    return df.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total")).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), *keys, "events", "total"
    )


def running_totals(stream: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, total per key and batch, kept as state: a keyed reduce."""
    kind = dict(stream.dtypes)[key]

    def add(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    return stream.groupBy(key).applyInPandasWithState(add, f"{key} {kind}, n long, total double", "n long, total double", "update", "NoTimeout")


def split_side(df: DataFrame, condition: str) -> tuple[DataFrame, DataFrame]:
    """(main, side): rows that meet a condition, and the others (nulls too)."""
    c = F.coalesce(F.expr(condition), F.lit(False))
    return df.filter(c), df.filter(~c)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into Parquet, and return what was written. A run that died goes on from its checkpoint."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path)
