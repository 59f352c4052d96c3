"""Table access and the query registry shared by the workload modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridpress.session import configure, stage

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The given tables of one scale folder, read lazily by attribute."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = configure(spark)
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def even(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` as a table of its own whose rows lie evenly over the session's shuffle partitions.

    Text is printed from tables that may be one row group, thus one task. A
    hash of the key deals the rows out; their number of parts is the session's
    setting, so it grows with the cluster.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(df.repartition(parts, *keys), "even")


class Registry:
    """Named queries and, where SQL can express them, their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def register(fn: Callable[[Tables], DataFrame]):
            name = fn.__name__
            self.queries[name] = lambda spark, folder: fn(Tables(spark, folder))
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register

    def merge(self, other: Registry) -> None:
        self.queries.update(other.queries)
        self.sql.update(other.sql)
