"""Named queries with the SQL that asks the same question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; results carry 64-bit integers and plain columns only."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return widen(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def widen(df: DataFrame) -> DataFrame:
    narrow = (T.IntegerType, T.ShortType, T.ByteType)
    if not any(isinstance(f.dataType, narrow) for f in df.schema.fields):
        return df
    return df.select(
        *[
            F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, narrow) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
