"""Changes of tables: insert, overwrite of partitions, update, delete, merge, truncate; on frames, and on versioned tables in a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .incremental import Target
from .profile import replace_partition


def _cond(c: str | Column) -> Column:
    """A condition that is false where it is unknown, as in SQL."""
    return F.coalesce(F.expr(c) if isinstance(c, str) else c, F.lit(False))


def _value(v: object) -> Column:
    return v if isinstance(v, Column) else F.expr(v) if isinstance(v, str) else F.lit(v)


def deleted(df: DataFrame, where: str | Column) -> DataFrame:
    """``df`` without the rows that meet a condition; rows for which it is unknown stay."""
    return df.filter(~_cond(where))


def updated(df: DataFrame, values: dict[str, object], where: str | Column = "true") -> DataFrame:
    """``df`` with new values (SQL text, columns or literals) in the rows that meet a condition; all values see the old row."""
    hit = _cond(where)
    return df.withColumns({c: F.when(hit, _value(v)).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items()})


def merged(target: DataFrame, source: DataFrame, keys: list[str], update: dict[str, object] | None = None, insert: bool = True, delete: str | Column | None = None) -> DataFrame:
    """MERGE INTO by equal keys: matched rows are deleted if ``delete`` holds, else updated; source rows without a match are inserted.

    Columns of the source are named ``s_column`` in conditions and values; with
    ``update`` None every column that both have takes the source's value. Null
    keys match nothing. Two source rows for one target row raise, when rows are
    read. One full join.
    """
    s = source.select(*(F.col(c).alias(f"s_{c}") for c in source.columns), F.lit(True).alias("_s"))
    once = source.groupBy(*keys).agg(F.count("*").alias("_times")).filter("_times > 1").select(*(F.col(k).alias(f"s_{k}") for k in keys), F.lit(True).alias("_twice"))
    s = s.join(once, [f"s_{k}" for k in keys], "left")
    both = target.withColumn("_t", F.lit(True)).join(s, [F.col(k) == F.col(f"s_{k}") for k in keys], "full_outer")
    matched = F.col("_t").isNotNull() & F.col("_s").isNotNull()
    both = both.withColumn("_ok", F.when(matched & F.col("_twice").isNotNull(), F.raise_error(F.lit("two source rows match one target row"))).otherwise(F.lit(True))).filter("_ok")
    both = both.filter(F.col("_t").isNotNull() | F.lit(insert))
    if delete is not None:
        both = both.filter(~(matched & _cond(delete)))
    new = {c: F.col(f"s_{c}") for c in target.columns if c in source.columns} if update is None else {c: _value(v) for c, v in update.items()}
    inserted = lambda c: F.col(f"s_{c}") if c in source.columns else F.lit(None)
    return both.select(
        *(F.when(F.col("_t").isNull(), inserted(c)).when(matched, new.get(c, F.col(c))).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c) for c in target.columns)
    )


class Table(Target):
    """A table in a folder whose every change is one new version, published like a run's rows; older versions stay readable."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        super().__init__(spark, path)
        self.schema = schema

    @classmethod
    def create_as(cls, df: DataFrame, path: str) -> Table:
        """CREATE TABLE AS SELECT; raises if the table has a version already."""
        t = cls(df.sparkSession, path, df.schema)
        t.publish(df, 0, {"version": 0, "parts": [], "last_ix": -1})
        return t

    def read(self, state: dict | None = None) -> DataFrame:
        parts = (state or self.manifest())["parts"]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{p}" for p in parts])

    def as_of(self, version: int) -> DataFrame:
        state = self._text(version)
        if state is None:
            raise LookupError(f"no version {version}")
        return self.read(state)

    def insert(self, rows: DataFrame) -> dict:
        state = self.manifest()
        return self.publish(rows.select(*self.schema.names), state["version"] + 1, state)

    def _replace(self, rows: DataFrame, state: dict) -> dict:
        return self.publish(rows.select(*self.schema.names), state["version"] + 1, {**state, "parts": []})

    def overwrite(self, rows: DataFrame) -> dict:
        return self._replace(rows, self.manifest())

    def truncate(self) -> dict:
        return self._replace(self.spark.createDataFrame([], self.schema), self.manifest())

    def overwrite_partitions(self, rows: DataFrame, key: str) -> dict:
        """INSERT OVERWRITE with dynamic partitions: keys that ``rows`` bring are replaced."""
        state = self.manifest()
        return self._replace(replace_partition(self.read(state), rows, key), state)

    def delete(self, where: str | Column) -> dict:
        state = self.manifest()
        return self._replace(deleted(self.read(state), where), state)

    def update(self, values: dict[str, object], where: str | Column = "true") -> dict:
        state = self.manifest()
        return self._replace(updated(self.read(state), values, where), state)

    def merge(self, source: DataFrame, keys: list[str], **how) -> dict:
        state = self.manifest()
        return self._replace(merged(self.read(state), source, keys, **how), state)

    def add_column(self, name: str, kind: T.DataType) -> None:
        """ALTER TABLE ADD COLUMN: rows written before have nulls."""
        self.schema = T.StructType([*self.schema.fields, T.StructField(name, kind)])

    def drop(self) -> None:
        self._fs.delete(self._at(self.path), True)
