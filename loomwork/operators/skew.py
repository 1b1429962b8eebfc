"""Joins that stay even where one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this many rows, or this share of all rows if that is more: at most 1 / HOT_SHARE keys are hot.
HOT_ROWS, HOT_SHARE = 1000, 0.001
#: Rows up to which a table that was counted is broadcast.
MOST_ROWS = 200_000


def bounded(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``df`` broadcast if it was counted to have at most ``most`` rows, else marked for a sort-merge join.

    ``df`` should be cheap to read twice (a staged table or a literal).
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def hot_bound(per_key: DataFrame, rows: str, hot_rows: int = HOT_ROWS, hot_share: float = HOT_SHARE) -> int:
    """Rows from which a key is hot; ``rows`` names the column with the rows of each key."""
    total = per_key.agg(F.sum(rows)).first()[0] or 0
    return max(hot_rows, int(total * hot_share) + 1)


def join_per_key(df: DataFrame, per_key: DataFrame, key: str, rows: str, hot_rows: int = HOT_ROWS, hot_share: float = HOT_SHARE) -> DataFrame:
    """Inner join of ``df`` with one row per key, where ``rows`` tells how many rows of ``df`` have the key.

    The hot keys, at most 1 / ``hot_share``, meet their rows by broadcast and
    the rows stay where they are; the others are shuffled. ``per_key`` should be
    staged. Null keys meet nothing.
    """
    bound = hot_bound(per_key, rows, hot_rows, hot_share)
    hot = per_key.filter(F.col(rows) >= bound)
    rest = per_key.filter(F.col(rows) < bound)
    far = df.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest.hint("merge"), key)
    return df.join(F.broadcast(hot), key).unionByName(far)
